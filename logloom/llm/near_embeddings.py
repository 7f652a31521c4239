"""Embedding near-duplicates: an exact metric range join.

Unit vectors with a cosine of t or more lie within r = sqrt(2 - 2t) of each
other.  Vectors with one label are dealt to the cells of their nearest pivots.
If y, in the cell of p, lies within r of x, in the cell of q, the triangle
inequality gives d(x, p) <= d(x, q) + 2r, and as the distance is Euclidean x
also lies within r of the plane half-way between p and q.  So x is copied to
just those cells p, and to the later one of two cells only, so that each pair
meets in exactly one cell.  A cell that is still large is dealt anew by pivots
of its own, as long as that leaves few copies; two vectors that are guests of
one cell met at home.  Cells then join on their own, block by block.

Equal vectors are one node with a multiplicity, so a vector that a third of the
rows share costs as much as any other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .forest import block_tasks, united
from .graph import components
from .runtime import dropped, shared_dir, ship, stored

#: Vectors that a cell should hold; a label of fewer is one cell.
CELL = 2000
#: Most pivots of a cell and most components of all pivots of a level (8 MB); levels of cells.
MAX_PIVOTS, ALL_COMPONENTS, LEVELS = 64, 1 << 20, 4
#: Most cells that a vector may visit on average at one level; with more, fewer pivots are taken.
COPIES = 4.0
#: Components that a task takes of one block, and the block's vectors at most; larger cells are split.
BLOCK_COMPONENTS, BLOCK = 1 << 21, 1 << 15
_KEYS = ["label", "dim", "cell"]


def _farthest(sample: np.ndarray, k: int) -> np.ndarray:
    """k of the sampled unit vectors, each the farthest from those before it."""
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(k, len(sample)) and near.max() > 1e-12:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _pivots(rows: DataFrame, cell: int, r: float, total: int) -> dict[tuple[str, int, int], np.ndarray]:
    """Pivots of each cell that is too large and can be split.

    They come from a sample by hash, which only steers the work: any pivots give
    the same pairs.  So does the sample's judgement of how many cells a vector
    would visit: pivots are halved until it is COPIES at most, and a cell left
    with one stays whole.  Sizes are kept in check here: cells count as large
    beyond N / 100,000 vectors, so at most 100,000 rows of counts come to the
    driver for each level, and pivots are dealt out within ALL_COMPONENTS, with
    a sample of four times as many.
    """
    large = max(2 * cell, total // 100_000)
    counts = rows.groupBy(*_KEYS).count().where(F.col("count") > large).collect()
    wanted = {(c.label, c.dim, c.cell): min(MAX_PIVOTS, -(-c["count"] // cell)) for c in counts}
    share = min(1.0, ALL_COMPONENTS / max(1, sum(n * key[1] for key, n in wanted.items())))
    wanted = {k: int(v * share) for k, v in wanted.items()}
    rates = [(*key, min(1.0, 4 * wanted[key] / c["count"])) for c in counts if wanted[key := (c.label, c.dim, c.cell)] > 1]
    if not rates:
        return {}
    rate = rows.sparkSession.createDataFrame(rates, "label string, dim int, cell long, rate double")
    drawn = rows.where("mask = 0 or home").join(F.broadcast(rate), _KEYS).where(F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(1 << 40)) < F.col("rate") * float(1 << 40))
    found = drawn.select(*_KEYS, "node", "vec").orderBy(*_KEYS, "node").toArrow()
    names = list(zip(*(found.column(c).to_pylist() for c in _KEYS), strict=True))
    out = {}
    for key in sorted(set(names)):
        x = _matrix(found.column("vec").take(pa.array([i for i, n in enumerate(names) if n == key])), key[1])
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        k = wanted[key]
        while k > 1:
            p = _farthest(unit, k)
            if len(p) > 1 and len(_reached(x, p, r)[0]) <= COPIES * len(x):
                out[key] = p
                break
            k = min(k, len(p)) // 2
    return out


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _reached(x: np.ndarray, pivots: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell and whether the cell is the row's own, for every cell that a row must visit."""
    slack = 1e-9
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    square = np.maximum(2 - 2 * unit @ pivots.T, 0)
    d = np.sqrt(square)
    own = d.argmin(1)
    at = np.arange(len(x))
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 1e-18))[own]
    near = (d <= d[at, own][:, None] + 2 * r + slack) & (square - square[at, own][:, None] <= (2 * r + slack) * between)
    near &= np.arange(len(pivots)) > own[:, None]
    near[at, own] = True
    row, cell = np.nonzero(near)
    return row, cell, cell == own[row]


def _dealt(rows: DataFrame, pivots: dict, r: float, level: int) -> DataFrame:
    """The rows of split cells, in the cells of their pivots, and all others as they are.

    home says whether the row is at home in its cell at this level, and bit
    ``level`` of mask that it isn't.
    """
    sent = rows.sparkSession.sparkContext.broadcast(pivots)
    schema = rows.schema
    names = schema.names
    at = {n: names.index(n) for n in names}

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            label, dim, cell, mask = (np.array(batch.column(at["label"]).to_pylist(), object), *(batch.column(at[c]).to_numpy() for c in ("dim", "cell", "mask")))
            keys = list(zip(label.tolist(), dim.tolist(), cell.tolist(), strict=True))
            rows_, cells, homes = [], [], []
            code = {k: i for i, k in enumerate(sorted(set(keys)))}
            own = np.array([code[k] for k in keys])
            for key, i in code.items():
                mine = np.flatnonzero(own == i)
                if (p := sent.value.get(key)) is None:
                    rows_.append(mine), cells.append(cell[mine]), homes.append(mask[mine] & (1 << level) == 0)
                    continue
                for a in range(0, len(mine), 4096):
                    row, to, home = _reached(_matrix(batch.column(at["vec"]).take(pa.array(mine[a : a + 4096])), key[1]), p, r)
                    rows_.append(mine[a : a + 4096][row]), cells.append(key[2] * (MAX_PIVOTS + 1) + to + 1), homes.append(home)
            take, cells, homes = np.concatenate(rows_), np.concatenate(cells), np.concatenate(homes)
            masks = mask[take] | np.where(homes, 0, 1 << level)
            for a in range(0, len(take), 10_000):
                part, s = pa.array(take[a : a + 10_000]), slice(a, a + 10_000)
                new = {"cell": pa.array(cells[s].astype(np.int64)), "home": pa.array(homes[s]), "mask": pa.array(masks[s].astype(np.int32))}
                yield pa.RecordBatch.from_arrays([new.get(n, batch.column(at[n]).take(part)) if n in new else batch.column(at[n]).take(part) for n in names], names=names)

    return rows.mapInArrow(run, schema)


def links(nodes: DataFrame, threshold: float, folder: str, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """For every node with a link: node, links (weighted by m), root (least node it reaches in its task); several rows a node.

    nodes: node long, label string, dim int, m long, vec array; folder: where what the levels write goes.
    """
    spark = nodes.sparkSession
    ship(spark)
    r = math.sqrt(max(0.0, 2 - 2 * threshold))
    total = nodes.count()
    rows = nodes.select("label", "dim", F.lit(0).cast("long").alias("cell"), F.lit(True).alias("home"), F.lit(0).alias("mask"), "node", "m", "vec")
    for level in range(LEVELS):
        pivots = _pivots(rows, cell, r, total)
        if not pivots:
            break
        rows = stored(_dealt(rows, pivots, r, level), f"{folder}/cells-{level}")
        dropped(spark, f"{folder}/cells-{level - 1}")
    # a cell's rows without a mark are at home in it at every level; two rows with a mark in common met elsewhere
    home, most = F.col("mask") == 0, F.greatest(F.least(F.lit(block), (F.lit(BLOCK_COMPONENTS) / F.col("dim")).cast("int")), F.lit(1))
    sizes = rows.groupBy(*_KEYS).agg(F.count_if(home).alias("n"), F.count_if(~home).alias("g"))
    sizes = sizes.select(*_KEYS, F.ceil(F.col("n") / most).alias("nb"), F.ceil(F.col("g") / most).alias("gb"))
    spread = F.xxhash64(F.lit(2), "node")
    own = F.when(home, F.pmod(spread, F.greatest("nb", F.lit(1)))).otherwise(F.col("nb") + F.pmod(spread, F.greatest("gb", F.lit(1)))).cast("int")
    tasks = rows.join(sizes, _KEYS).withColumn("b", own).withColumn("task", F.explode(block_tasks(F.col("nb") + F.col("gb"), F.col("b"))))
    tasks = tasks.select(*_KEYS, "task.bi", "task.bj", "b", "mask", "node", "m", "vec")
    out = T.StructType([T.StructField("node", T.LongType()), T.StructField("links", T.LongType()), T.StructField("root", T.LongType())])

    def join(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        b = table.column("b").to_numpy()
        order = np.argsort(table.column("node").to_numpy(), kind="stable")  # so that roots are least nodes
        node, b, m, mask = (table.column(c).to_numpy()[order] for c in ("node", "b", "m", "mask"))
        x = _matrix(table.column("vec"), dim)[order]
        bi, bj = table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
        left = np.flatnonzero(b == bi)
        right = left if bi == bj else np.flatnonzero(b == bj)
        norm = np.sqrt((x * x).sum(1))
        count, parent = np.zeros(len(x), np.int64), np.arange(len(x))
        apart = len(left) and len(right) and np.bitwise_and.reduce(mask[left]) & np.bitwise_and.reduce(mask[right])
        if len(left) and len(right) and not apart:
            # |d(x, c) - d(y, c)| <= d(x, y) for any centre c: sorted by that distance, a row meets only a window
            unit = x / norm[:, None]
            far = np.sqrt(np.maximum(2 - 2 * unit @ unit[left[0]], 0))
            left, right = left[np.argsort(far[left], kind="stable")], right[np.argsort(far[right], kind="stable")]
            step = max(1, (1 << 21) // len(right))
            for a in range(0, len(left), step):
                rows = left[a : a + step]
                lo, hi = np.searchsorted(far[right], [far[rows[0]] - r - 1e-6, far[rows[-1]] + r + 1e-6])
                cols = right[lo:hi]
                cosine = (x[rows] @ x[cols].T) / (norm[rows][:, None] * norm[cols])
                i, j = np.nonzero((cosine >= threshold) & (mask[rows][:, None] & mask[cols] == 0))
                i, j = rows[i], cols[j]
                if bi == bj:
                    i, j = i[i != j], j[i != j]
                    np.add.at(count, i, m[j])  # the other direction comes with the other row
                else:
                    np.add.at(count, i, m[j])
                    np.add.at(count, j, m[i])
                united(parent, i, j)
        with_link = np.flatnonzero(count)
        return pa.table([pa.array(node[with_link]), pa.array(count[with_link]), pa.array(node[parent[with_link]])], names=out.names)

    return tasks.groupBy(*_KEYS, "bi", "bj").applyInArrow(join, out)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two rows are linked if their labels are equal and not null, their vectors
    have equal length and their cosine in double precision is ``threshold`` or
    more.  Vectors that are null, empty, all zero or hold null or non-finite
    components, and vectors without a label, link with nothing.  component_id is
    the least vec_id in reach, itself included; kept says it is the row's own.
    Rows that repeat a vec_id stay separate vectors: each counts as a link of
    the others.  An empty table gives an empty result.  Further columns are
    left out.
    """
    spark = vectors.sparkSession
    folder = shared_dir(spark)
    vec = F.col(f"`{embedding}`")
    if not isinstance(vectors.schema[embedding].dataType.elementType, (T.FloatType, T.DoubleType)):
        vec = vec.cast("array<double>")
    limit = float("inf")
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").cast("string").alias("label"), vec.alias("vec"))
    good = F.col("label").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < limit)) & F.exists("vec", lambda v: v != 0)
    rows = rows.withColumn("node", F.when(F.coalesce(good, F.lit(False)), F.xxhash64("label", "vec")))
    grouped = rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("lo"), F.count("*").alias("m"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    nodes = stored(grouped.select("node", "lo", "m", "label", F.size("vec").alias("dim"), "vec"), f"{folder}/nodes")
    found = stored(links(nodes, threshold, folder, cell, block), f"{folder}/links")
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    total = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "lo", "m").join(total, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("lo").alias("component_id"))
    known = known.join(least, "root").select("node", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    alone = rows.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return rows.where("node is not null").select("vec_id", "node").join(known, "node").select("vec_id", "n_links", "component_id").unionByName(alone).withColumn("kept", kept)
