import json

from logloom import sinks
from logloom.config import Dataset, PipelineConfig, datasets
from logloom.plans import cli, pipeline
from logloom.sources import completed_partitions, csv_tuples, dataset_tuples, log_lines, log_tuples, network_path, numbered_lines, opened, read_intermediate, read_json_store
from logloom.sources.logs import csv_lines
from logloom.streaming import distinct_tuples, store_sink

GOOD = '{} - - [10/Oct/2000:13:55:36 -0700] "GET / HTTP/1.0" 200 5\n'


def write_logs(root):
    for site, ips in (("portal", ["1.1.1.1", "1.1.1.1", "2.2.2.2"]), ("news", ["2.2.2.2", "3.3.3.3"]), ("shop", ["9.9.9.9"])):
        (root / f"{site}_access.log").write_text("".join(GOOD.format(i) for i in ips) + "\nnone here\n")


def test_log_scan_with_missing_file(spark, tmp_path):
    write_logs(tmp_path)
    lines = log_lines(spark, datasets(str(tmp_path))["balanced"].files)
    assert lines.count() == 12
    assert sorted(tuple(r) for r in log_tuples(lines).collect()) == [("1.1.1.1", 1), ("1.1.1.1", 1), ("2.2.2.2", 1), ("2.2.2.2", 2), ("3.3.3.3", 2), ("9.9.9.9", 3)]
    assert log_lines(spark, {1: str(tmp_path / "gone.log")}).count() == 0


def test_line_ends(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"1.1.1.1 a\r\n2.2.2.2 b\r3.3.3.3 c\n\xff4.4.4.4 d")
    assert {r.ip for r in log_tuples(log_lines(spark, {1: str(tmp_path / "a.log")})).collect()} == {"1.1.1.1", "2.2.2.2", "3.3.3.3", "4.4.4.4"}


def test_csv_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_text('ip,site,raw_line\n 5.6.7.8 ,shop,"a ""b"" c"\n,shop,z\nabc,shop,"two\nlines"\n')
    rows = csv_lines(spark, {3: str(tmp_path / "a.csv")})
    assert rows.count() == 3 and {r.raw_line for r in rows.collect()} == {'a "b" c', "z", "two\nlines"}
    assert {tuple(r) for r in csv_tuples(rows).collect()} == {("5.6.7.8", 3), ("abc", 3)}
    (tmp_path / "raw.csv").write_text("site,file,line_no,raw_line\nx,y,1,1.2.3.4 z\n")
    assert csv_tuples(csv_lines(spark, {1: str(tmp_path / "raw.csv")})).count() == 0
    (tmp_path / "b.log").write_text(GOOD.format("8.8.8.8"))
    mixed = Dataset("log", {1: str(tmp_path / "a.csv"), 2: str(tmp_path / "b.log")})
    assert {r.ip for r in dataset_tuples(spark, mixed).collect()} == {"5.6.7.8", "abc", "8.8.8.8"}


def test_numbered_lines(spark, tmp_path):
    for name, n in (("portal", 50), ("news", 3)):
        (tmp_path / f"{name}_access.log").write_text("".join(f"{name} line {i}\n" for i in range(1, n + 1)))
    got = numbered_lines(spark, [str(tmp_path / f"{n}_access.log") for n in ("portal", "news")]).collect()
    assert len(got) == 53 and all(r.raw_line == f"{r.site} line {r.line_no}" and r.file == f"{r.site}_access.log" for r in got)


def test_intermediate_files_skip_what_is_broken(spark, tmp_path):
    record = {"ip": "1.1.1.1", "country": "A", "city": "B", "latitude": 1.0, "longitude": 2.0, "source_sites": [1]}
    (tmp_path / "reducer_0.json").write_text(json.dumps([record]))
    (tmp_path / "reducer_1.json").write_text("")
    (tmp_path / "reducer_2.json").write_text('[{"ip": ')
    got = read_intermediate(spark, [str(tmp_path / f"reducer_{i}.json") for i in range(4)]).collect()
    assert [(r.ip, r.rid, r.source_sites) for r in got] == [("1.1.1.1", 0, [1])]
    assert [r.done for r in completed_partitions(spark, f"{tmp_path}/reducer_*.json", 4).orderBy("rid").collect()] == [True, False, True, False]
    (tmp_path / "reducer_9.tmp").write_text("x")
    assert sinks.clean_orphans(spark, str(tmp_path)) == 3 and not list(tmp_path.glob("reducer_*"))


def test_json_store_both_forms(spark, tmp_path):
    records = pipeline.store(spark.createDataFrame([("1.1.1.1", 2), ("1.1.1.1", 1)], "ip string, site_id int"))
    sinks.write_json_object(records, str(tmp_path / "o"))
    assert [tuple(r) for r in read_json_store(spark, str(tmp_path / "o")).collect()] == [tuple(r) for r in records.collect()]
    (tmp_path / "list.json").write_text('[{"ip": "7.7.7.7"}, {"ip": ""}, {"city": "x"}]')
    assert [r.ip for r in read_json_store(spark, str(tmp_path / "list.json")).collect()] == ["7.7.7.7"]
    (tmp_path / "bad.json").write_text("nonsense")
    assert read_json_store(spark, str(tmp_path / "bad.json")).count() == 0


def test_runs_and_validation(spark, tmp_path):
    write_logs(tmp_path)
    dataset = datasets(str(tmp_path))["balanced"]
    for strategy in ("hash", "range"):
        to = str(tmp_path / strategy)
        for _ in range(2):  # again over what is there
            figures = pipeline.run(spark, dataset, to, pipeline.PipelineConfig(strategy=strategy))
        assert (figures["rows_read"], figures["ip_local"], figures["ip_global"], figures["skipped"]) == (12, 5, 4, 1)
        assert pipeline.validated(spark, dataset, to).first().passed
        assert {r.ip: r.source_sites for r in spark.read.parquet(f"{to}/store").collect()} == {"1.1.1.1": [1], "2.2.2.2": [1, 2], "3.3.3.3": [2], "9.9.9.9": [3]}


def test_command_line(spark, tmp_path, capsys):
    write_logs(tmp_path)
    assert cli.main([str(tmp_path), "-o", str(tmp_path / "out"), "--validate", "-r", "2"], spark) == 0
    assert '"passed": true' in capsys.readouterr().out
    assert cli.main([str(tmp_path), "-o", str(tmp_path / "none"), "--validation-only"], spark) == 1


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    to = str(tmp_path / "store")

    def push(name, rows):
        spark.createDataFrame(rows, "site_id int, raw_line string").coalesce(1).write.parquet(str(folder / name))
        lines = spark.readStream.schema("site_id int, raw_line string").parquet(f"{folder}/*")
        store_sink(distinct_tuples(lines), to, str(tmp_path / "checkpoint")).awaitTermination()

    push("a", [(1, "1.1.1.1 x"), (1, "1.1.1.1 y"), (2, "none")])
    push("b", [(2, "1.1.1.1 x"), (1, "1.1.1.1 z"), (3, "2.2.2.2 x")])
    last = max(p.name for p in (tmp_path / "store").glob("v*"))
    assert {r.ip: r.source_sites for r in spark.read.parquet(f"{to}/{last}").collect()} == {"1.1.1.1": [1, 2], "2.2.2.2": [3]}


def test_run_samples_only_lines_that_the_sampler_reads(spark, tmp_path, monkeypatch):
    write_logs(tmp_path)
    with open(tmp_path / "news_access.log", "a") as f:
        f.write("7.7.7.7 broken\n")
    drawn = []
    weighted = pipeline.partitioning.weighted_sample
    monkeypatch.setattr(pipeline.partitioning, "weighted_sample", lambda rows, *a: drawn.extend((r.ip, r.n) for r in rows.collect()) or weighted(rows, *a))
    figures = pipeline.run(spark, datasets(str(tmp_path))["balanced"], str(tmp_path / "out"), PipelineConfig(strategy="range"))
    assert sorted(drawn) == [("1.1.1.1", 2), ("2.2.2.2", 1), ("2.2.2.2", 1), ("3.3.3.3", 1), ("9.9.9.9", 1)]
    assert figures["ip_global"] == 5 and figures["boundaries"].startswith("R0:")  # the line is processed all the same


def test_equal_names_in_different_folders(spark, tmp_path):
    for name, ip in (("a", "1.1.1.1"), ("b", "2.2.2.2")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "access.log").write_text(GOOD.format(ip) * 2)
    files = {1: str(tmp_path / "a" / "access.log"), 2: str(tmp_path / "b" / "access.log"), 3: str(tmp_path / "a")}
    assert sorted(tuple(r) for r in log_tuples(log_lines(spark, files)).distinct().collect()) == [("1.1.1.1", 1), ("1.1.1.1", 3), ("2.2.2.2", 2)]
    numbered = numbered_lines(spark, [files[1], files[2]]).collect()
    assert sorted((r.raw_line[0], r.line_no) for r in numbered) == [("1", 1), ("1", 2), ("2", 1), ("2", 2)]


def lines_scanned(spark, first, after):
    """Records that the stages of a range of numbers have read from files."""
    store, total = spark.sparkContext._jsc.sc().statusStore(), 0
    for k in range(first, after):
        try:
            total += store.lastStageAttempt(k).inputRecords()
        except Exception:  # a stage that was skipped
            continue
    return total


def test_a_run_reads_its_input_once(spark, tmp_path):
    (tmp_path / "portal_access.log").write_text("".join(GOOD.format(f"1.1.1.{i % 50}") for i in range(20_000)))
    dataset = datasets(str(tmp_path))["balanced"]
    stages = spark.sparkContext._jsc.sc().dagScheduler().nextStageId
    for strategy in ("hash", "range"):
        first = stages()
        figures = pipeline.run(spark, dataset, str(tmp_path / strategy), PipelineConfig(strategy=strategy))
        assert figures["rows_read"] == 20_000 <= lines_scanned(spark, first, stages()) < 30_000


def test_networks_are_found_and_read_with_a_way_back(spark, tmp_path):
    assert network_path(spark, str(tmp_path)) is None and opened(spark, None) is None and opened(spark, str(tmp_path / "no.csv")) is None
    (tmp_path / "broken.parquet").write_text("nonsense")
    assert opened(spark, str(tmp_path / "broken.parquet")) is None
    (tmp_path / "data").mkdir()
    (tmp_path / "networks.csv").write_text("lo,hi,country\n0,1,A\n")
    assert network_path(spark, str(tmp_path / "x"), str(tmp_path)) == f"{tmp_path}/networks.csv"
    (tmp_path / "data" / "networks.csv").write_text("network,country,city,latitude,longitude\n1.0.0.0/8,Oneland,,1.5,\n1.2.3.77/24,,Town,,2\n1.2.3.4,X,,,\n0.0.0.0/0,All,,,\n")
    path = network_path(spark, str(tmp_path))
    assert path == f"{tmp_path}/data/networks.csv"
    assert sorted((r.lo, r.hi, r.country) for r in opened(spark, path).collect() if r.country) == [(0, 2**32 - 1, "All"), (1 << 24, (2 << 24) - 1, "Oneland")]
    write_logs(tmp_path)
    figures = pipeline.run(spark, datasets(str(tmp_path))["balanced"], str(tmp_path / "out"), PipelineConfig(networks=path))
    got = {r.ip: (r.country, r.city, r.latitude, r.longitude) for r in spark.read.parquet(str(tmp_path / "out" / "store")).collect()}
    assert figures["geo_mode"] == "networks" and got["1.1.1.1"] == ("Oneland", "Unknown", 1.5, 0.0) and got["9.9.9.9"] == ("All", "Unknown", 0.0, 0.0)


def test_recovery_computes_only_what_is_missing(spark, tmp_path):
    write_logs(tmp_path)
    dataset, to = datasets(str(tmp_path))["balanced"], str(tmp_path / "out")
    config = PipelineConfig(rebalance=False)
    pipeline.run(spark, dataset, to, config)
    local = pipeline.routed(dataset_tuples(spark, dataset).distinct(), config)
    rid = local.where("ip = '1.1.1.1'").first().rid
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "intermediate").glob("rid=*/*.parquet") if f"rid={rid}" not in str(p)}
    for p in (tmp_path / "out" / "intermediate" / f"rid={rid}").iterdir():
        p.unlink()
    assert rid in pipeline.recovered(spark, local, to, config)
    assert {p: p.stat().st_mtime_ns for p in kept} == kept and spark.read.parquet(f"{to}/store").count() == 4
    assert rid not in pipeline.missing_partitions(spark, to, config.n_reducers)
