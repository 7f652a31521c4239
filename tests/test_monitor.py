import json
import time

import pytest

from logloom.config import datasets
from logloom.plans import monitor, sweeps

from .test_files import write_logs


def test_phases_memory_and_failures(spark):
    m = monitor.Monitor(memory_threshold=-1)
    for name in ("a", "b"):
        with m.phase(name):
            time.sleep(0.01)
    rows = m.latencies(spark).collect()
    assert {r.phase for r in rows} == {"a", "b"} == set(m.over_threshold) and sum(r.bottleneck for r in rows) == 1
    assert abs(sum(r.percent for r in rows) - 100) < 0.01 and m.recovery_rate == 1.0
    calls = []

    def task():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 1

    assert m.failure_report() == "" and m.retried(task) == 1 and (len(m.failures), m.recovered, m.retries, m.recovery_rate) == (1, 1, 2, 1.0)
    with pytest.raises(ZeroDivisionError):
        m.retried(lambda: 1 / 0, part="reduce")
    assert m.recovery_rate == 0.5 and str(m.failures[1]) == "reduce: exception at attempt 3, not recovered"
    assert len(m.failure_report().splitlines()) == 3 and len(m.memory_report().splitlines()) == 2


def test_reasons():
    errors = [monitor.PartTimeout("x"), RuntimeError("job cancelled"), MemoryError(), RuntimeError("java.lang.OutOfMemoryError"), RuntimeError("ExecutorLostFailure"), ValueError("x")]
    assert [monitor.reason_of(e) for e in errors] == ["timeout", "timeout", "OOM", "OOM", "signal", "exception"]


def test_timeout_cancels_jobs(spark):
    assert monitor.with_timeout(spark, lambda: spark.range(5).count(), 60) == 5
    with pytest.raises(monitor.PartTimeout, match="cancel"):
        monitor.with_timeout(spark, lambda: spark.range(10**13).selectExpr("sum(sqrt(id))").collect(), 1.5)


def test_sweep(spark, tmp_path):
    write_logs(tmp_path)
    rows = sweeps.sweep(spark, datasets(str(tmp_path))["balanced"], str(tmp_path / "out"), "n_reducers", [1, 0, 3])
    assert [r["ok"] for r in rows] == [True, False, True] and rows[0]["ip_global"] == rows[2]["ip_global"] == 4
    sweeps.write_sweeps(spark, {"speedup": rows}, ["balanced"], {"n": 1}, str(tmp_path / "sweep"))
    assert json.loads(spark.read.text(str(tmp_path / "sweep")).first().value)["sweeps"]["speedup"][1]["ok"] is False


def test_all_sweeps(spark, tmp_path, monkeypatch):
    write_logs(tmp_path)
    for name, values in (("REDUCERS", [1, 2]), ("MEMORY_THRESHOLDS", [70.0]), ("SKEW_THRESHOLDS", [0.1])):
        for f, at in ((sweeps.speedup_sweep, "REDUCERS"), (sweeps.memory_sweep, "MEMORY_THRESHOLDS"), (sweeps.skew_sweep, "SKEW_THRESHOLDS")):
            if at == name:
                monkeypatch.setattr(f, "__defaults__", (values, *f.__defaults__[1:]))
    found = sweeps.all_sweeps(spark, {"log": datasets(str(tmp_path))["balanced"]}, str(tmp_path / "out"))
    assert [len(found[f"log_{k}"]) for k in ("speedup", "memory", "skew")] == [2, 1, 1]
    assert found["log_speedup"][0]["speedup"] == 1.0 and found["log_skew"][0]["skew_warning_triggered"] in (True, False)
    assert sweeps.speedup_sweep(spark, datasets(str(tmp_path))["balanced"], str(tmp_path / "out"), [2], check=True)[0]["counts_match"]
    assert sweeps.counts_match(spark, datasets(str(tmp_path))["balanced"], str(tmp_path / "out"))


def test_public_names():
    import logloom

    assert all(getattr(logloom, name) is not None for name in logloom.__all__)
    with pytest.raises(AttributeError):
        logloom.nothing_of_the_kind
