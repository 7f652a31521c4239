"""N-gram Jaccard join over size-banded tiles with bitmap signatures.

Each text is the set of its distinct five-word shingles, as sorted 64-bit
hashes.  Two sets of Jaccard similarity 4/5 or more share one of each other's
n - ceil(4n/5) + 1 rarest shingles, so texts are dealt by those.  Texts that
meet at a shingle and lie in one band of sizes (no two neighbours in size
further apart than 4/5) join the tile of the band's first text; a group of
copies that meets at many shingles thus lands in few tiles rather than in pairs
for each shingle.  Texts that share a shingle with very many others are tiled by
shingle and band without meeting in one place.  In a large tile every text is
first settled against a few of its texts, the pivots; what is connected to them
needs no more comparison with each other, so a group of near copies costs as
much as its size.  A tile compares the rest by bitmap, block by block: every shingle flips
one of at least as many bits, so the bits in which two bitmaps differ bound the
difference of the sets from below and the overlap from above.  Only texts with
a partner that may still reach the threshold go on, in groups that such pairs
connect (a group found in several tiles goes on once).  There the texts
themselves meet, and pairs not yet connected are settled by intersecting the
sorted arrays.

"Rarest" goes by a fixed-size table of hashed document counts over the whole
corpus.  It only sets the order of shingles, the same for all texts, so it
steers work but never the result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .forest import block_tasks, united
from .graph import components
from .runtime import dropped, shared_dir, ship, stored
from .textarrays import SPACED, blocks, mix, ngram_hashes, words

#: Hashed document counts (4 bytes each) and the parts in which tasks send them.
SLOTS, PARTS = 1 << 22, 16
#: Most bits of a text's bitmap (the least are 64; in between twice the number of shingles).
MAX_BITS = 4096
#: Most bits of the table that tells which texts are wanted again (16 MB).
WANTED_BITS = 27
#: Texts of a block within a tile, and their shingles; larger tiles are split.
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
#: Pivots of a tile that has more texts than a block.
PIVOTS = 8
#: A shingle is hot if its hashed count is this and 16 times the mean of all counts; its texts are dealt over SALTS tasks.
HOT, SALTS = 1 << 16, 64


def _sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending, one text after another, and where each text's begin."""
    h, first = ngram_hashes(words(data, offsets, SPACED), n, short=True)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(first)))


def _node(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(0x51ED270B0A1F39C1)))])
    return mix((total[first[1:]] - total[first[:-1]]) + np.diff(first).astype(np.uint64)).view(np.int64)


def _row_bitmaps(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    """A bitmap of each set in which every element flips one bit; its size depends on the set's alone."""
    size = np.diff(first)
    bits = _bits(size)
    at = np.cumsum(bits) - bits
    text = np.repeat(np.arange(len(size)), size)
    flips = np.bincount(at[text] + (h >> np.uint64(20) & (bits[text] - 1).astype(np.uint64)).astype(np.int64), minlength=int(bits.sum())).astype(np.uint8) & 1
    raw = np.packbits(flips, bitorder="little").tobytes()
    return [raw[a // 8 : (a + b) // 8] for a, b in zip(at.tolist(), bits.tolist(), strict=True)]


def _bits(size: np.ndarray) -> np.ndarray:
    return np.left_shift(1, np.clip(np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64), 6, MAX_BITS.bit_length() - 1))


def _scan(docs: DataFrame, text: str, n: int) -> DataFrame:
    """Of each row its name (null if it has no words), size and bitmap; and the corpus's hashed counts as rows with a part."""
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema if f.name != text), T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bitmap", T.BinaryType()), T.StructField("part", T.IntegerType()), T.StructField("counts", T.BinaryType())])
    kept = [i for i, c in enumerate(docs.columns) if c != text]
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, like = np.zeros(SLOTS, np.uint32), None
        for batch in batches:
            like, names, sizes, maps = batch, [], [], []
            for _, _, data, offsets in blocks(batch.column(at)):
                h, first = _sets(data, offsets, n)
                counts += np.bincount((h & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS).astype(np.uint32)
                names.append(_node(h, first))
                sizes.append(np.diff(first))
                maps += _row_bitmaps(h, first)
            if names:
                size = np.concatenate(sizes)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(np.concatenate(names), mask=size == 0), pa.array(size), pa.array(maps, pa.binary()), pa.nulls(len(size), pa.int32()), pa.nulls(len(size), pa.binary())], names=schema.names)
        if like is not None:
            sent = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, PARTS)]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(PARTS, like.column(i).type) for i in kept), pa.nulls(PARTS, pa.int64()), pa.nulls(PARTS, pa.int64()), pa.nulls(PARTS, pa.binary()), pa.array(range(PARTS), pa.int32()), pa.array(sent, pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def _summed(counts: DataFrame) -> np.ndarray:
    """The corpus's counts: PARTS rows, 16 MB in all, whatever the corpus's size."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS // PARTS, np.uint64)
        for batch in batches:
            for x in batch.column(1):
                total += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], names=["part", "counts"])

    def pre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # what one task has of a part, as one row
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held[p] = held.get(p, 0) + np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
        for p, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([zlib.compress(x.astype(np.uint32).tobytes(), 1)], pa.binary())], names=["part", "counts"])

    kind = "part int, counts binary"
    parts = counts.mapInArrow(pre, kind).groupBy("part").applyInArrow(add, kind).collect()
    out = np.zeros(SLOTS, np.uint32)
    for p in parts:
        out[p["part"] * (SLOTS // PARTS) : (p["part"] + 1) * (SLOTS // PARTS)] = np.frombuffer(p["counts"], np.uint32)
    return out


def _postings(docs: DataFrame, counts, n: int, hot: int) -> DataFrame:
    """Of each distinct set, as far as a task sees, its rarest shingles: h, n, node, salt.

    A row of a hot shingle bears a salt, and for h the shingle mixed with a band
    of sizes, once for each of two bands: sizes within 4/5 share one of theirs.
    """
    schema = "h long, n int, node long, salt int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        least = max(hot, 16 * int(counts.value.mean(dtype=np.float64)))
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(0)):
                h, first = _sets(data, offsets, n)
                size, name = np.diff(first), _node(h, first)
                new = np.zeros(b - a, bool)
                for i in np.flatnonzero(size).tolist():
                    if (x := int(name[i])) not in seen:
                        seen.add(x)
                        new[i] = True
                if not new.any():
                    continue
                text = np.repeat(np.arange(b - a), size)
                keep = new[text]
                h, text = h[keep], text[keep]
                count = counts.value[(h & np.uint64(SLOTS - 1)).astype(np.int64)]
                order = np.lexsort((h, count, text))
                h, text, count = h[order], text[order], count[order]
                begin = np.searchsorted(text, text, "left")
                prefix = size - (-(-4 * size // 5)) + 1
                keep = np.arange(len(h)) - begin < prefix[text]
                h, text, many = h[keep], text[keep], count[keep] >= least
                salt = np.full(len(h), -1, np.int32)
                if many.any():
                    # sizes of one band differ by less than 5/4, so equal or neighbouring bands hold all that may link
                    band = np.floor(np.log(size[text[many]]) / np.log(1.25) + 1e-9).astype(np.uint64)
                    shared = [mix(h[many] + mix(band + np.uint64(k))) for k in (0, 1)]
                    h, text = np.concatenate([h[~many], *shared]), np.concatenate([text[~many], text[many], text[many]])
                    salt = np.full(len(h), -1, np.int32)
                    salted = slice(len(h) - 2 * int(many.sum()), None)
                    salt[salted] = (name[text[salted]].view(np.uint64) >> np.uint64(7)).astype(np.int64) % SALTS
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(size[text], pa.int32()), pa.array(name[text]), pa.array(salt)], names=["h", "n", "node", "salt"])

    return docs.mapInArrow(run, schema)


def _tiles(postings: DataFrame) -> DataFrame:
    """Tile (its first text's name) and member for all texts that meet another at a shingle within a band of sizes; and whether the shingle is hot.

    One sorted pass with a state of one row: the first text of a band is the
    tile, so a shingle of any number of texts needs no memory.  Rows of hot
    shingles go through as they are: h is their tile.
    """
    kind = "tile long, node long, hot boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # shingle, size, tile, name of the row before, and whether the tile's first row has been sent
        for batch in batches:
            h, n, node = (batch.column(i).to_numpy() for i in range(3))
            hot = batch.column(3).to_numpy() >= 0
            if hot.any():
                yield pa.RecordBatch.from_arrays([pa.array(h[hot]), pa.array(node[hot]), pa.array(hot[hot])], names=["tile", "node", "hot"])
                h, n, node = h[~hot], n[~hot], node[~hot]
            if not len(h):
                continue
            ph, pn, pnode = np.empty_like(h), np.empty_like(n), np.empty_like(node)
            ph[1:], pn[1:], pnode[1:] = h[:-1], n[:-1], node[:-1]
            ph[0], pn[0], pnode[0] = last[:3] if last else (~h[0], 0, 0)
            goes_on = (ph == h) & (5 * pn.astype(np.int64) >= 4 * n)
            if not last:
                goes_on[0] = False
            again = goes_on & (pnode == node)
            start = np.where(~goes_on, np.arange(len(h)), -1)
            start = np.maximum.accumulate(start)
            tile = np.where(start >= 0, node[np.maximum(start, 0)], last[3] if last else 0)
            member = goes_on & ~again & (tile != node)
            tiles, members = [tile[member]], [node[member]]
            heads = np.unique(tile[member])  # a tile's first text is a member too
            tiles.append(heads)
            members.append(heads)
            t, m = np.concatenate(tiles), np.concatenate(members)
            if len(t):
                pair = np.unique(np.stack([t, m]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array(np.zeros(pair.shape[1], bool))], names=["tile", "node", "hot"])
            last = (h[-1], n[-1], node[-1], tile[-1])

    return postings.repartition("h", "salt").sortWithinPartitions("h", "n", "node").select("h", "n", "node", "salt").mapInArrow(run, kind).distinct()


def _named(tiles: DataFrame) -> DataFrame:
    """Tile and member, tiles of hot shingles too by their least text: those that hold the same texts become one."""
    hot = tiles.where("hot")
    least = hot.groupBy("tile").agg(F.min("node").alias("least"), F.count("*").alias("c")).where("c > 1").select("tile", "least")
    return tiles.where("not hot").select("tile", "node").unionByName(hot.join(least, "tile").select(F.col("least").alias("tile"), "node")).distinct()


def _bitmaps(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each set a bitmap in which every element flips one bit."""
    most = int(np.diff(first).max())
    bits = min(1 << 16, max(256, 2 << (most - 1).bit_length()))
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = (mix(h) >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)
    flips = np.bincount(row * bits + at, minlength=(len(first) - 1) * bits).astype(np.uint8) & 1 if (len(first) - 1) * bits <= 1 << 22 else None
    if flips is not None:
        return np.packbits(flips.reshape(-1, bits), axis=1).view(np.uint64)
    out = np.zeros((len(first) - 1, bits // 64), np.uint64)
    np.bitwise_xor.at(out, (row, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return out


def connected(h: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> np.ndarray:
    """Roots of the sets under links between left and right (within left if right is None).

    h, first: sorted distinct elements of each set; left, right: numbers of sets.
    """
    size = np.diff(first)
    parent = np.arange(len(size))
    if not len(left) or (right is not None and not len(right)):
        return parent
    maps = _bitmaps(h, first)
    left = left[np.argsort(size[left], kind="stable")]
    right_ = left if right is None else right[np.argsort(size[right], kind="stable")]
    step = max(1, min(64, (1 << 21) // max(1, len(right_) * maps.shape[1])))
    for a in range(0, len(left), step):
        rows = left[a : a + step]
        lo = a if right is None else int(np.searchsorted(size[right_], -(-4 * size[rows[0]] // 5)))
        hi = int(np.searchsorted(size[right_], 5 * size[rows[-1]] // 4, "right"))
        for c in range(lo, hi, 1 << 14):
            cols = right_[c : min(hi, c + (1 << 14))]
            both = size[rows][:, None] + size[cols]
            differ = np.zeros((len(rows), len(cols)), np.int64)
            for k in range(maps.shape[1]):
                differ += np.bitwise_count(maps[rows, k][:, None] ^ maps[cols, k])
            may = 9 * ((both - differ) // 2) >= 4 * both
            may &= parent[rows][:, None] != parent[cols]
            for k in np.flatnonzero(may.any(1)).tolist():
                i, js = rows[k], cols[may[k]]
                js = js[(parent[js] != parent[i]) & (js != i)]
                for at in range(0, len(js), 256):
                    part = js[at : at + 256]
                    part = part[parent[part] != parent[i]]
                    if len(part):
                        linked = part[_links(h, first, i, part)]
                        united(parent, np.full(len(linked), i), linked)
    return parent


def _links(h: np.ndarray, first: np.ndarray, i: int, js: np.ndarray) -> np.ndarray:
    """Whether set i links with each set of js, by intersecting the sorted arrays."""
    own, size = h[first[i] : first[i + 1]], (first[1:] - first[:-1])[js]
    other = np.concatenate([h[first[j] : first[j + 1]] for j in js])
    spot = np.minimum(np.searchsorted(own, other), len(own) - 1)
    shared = np.concatenate([[0], np.cumsum(own[spot] == other)])[np.concatenate([[0], np.cumsum(size)])]
    return 9 * np.diff(shared) >= 4 * (len(own) + size)


def _read_sets(table: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements and begins of the sets of a table's texts, and which texts are those that their row's node names."""
    hs, sizes, names = [], [], []
    for _, _, data, offsets in blocks(table.column("text").combine_chunks()):
        h, first = _sets(data, offsets, n)
        hs.append(h), sizes.append(np.diff(first)), names.append(_node(h, first))
    return np.concatenate(hs), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(names) == table.column("node").to_numpy()


def _pivoted(tiles: DataFrame, nodes: DataFrame, source: DataFrame, n: int, block: int, folder: str) -> DataFrame | None:
    """For tiles of more than ``block`` texts the links of each text with the tile's pivots: tile, node, pivot, main.

    main: the text belongs to the class of pivots with the most of them, whose
    texts are thus all connected.  A tile's texts are dealt over tasks of at
    most about ``block`` texts, and each task gets the pivots.  None if no tile
    is as large.
    """
    picks = [F.min(F.struct(F.xxhash64(F.lit(k), "node").alias("h"), "node"))["node"] for k in range(PIVOTS)]
    large = tiles.join(nodes.select("node", "n"), "node").groupBy("tile").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.array_sort(F.array_distinct(F.array(*picks))).alias("pivots")).where(F.col("c") > block)
    large = stored(large.select("tile", F.greatest(F.ceil(2 * F.col("c") / block), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("salts"), "pivots"), f"{folder}/large")
    if large.isEmpty():
        return None
    own = tiles.join(large, "tile")
    wanted = stored(own.select("node").distinct().join(nodes.select("node", "loc"), "node"), f"{folder}/pivot-wanted")
    rows = own.select("tile", F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"), "node", F.lit(False).alias("pivot"))
    everywhere = large.withColumn("node", F.explode("pivots")).select("tile", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "node", F.lit(True).alias("pivot"))
    rows = rows.unionByName(everywhere).join(_fetched(source, wanted), "node")

    def run(table: pa.Table) -> pa.Table:
        h, first, fits = _read_sets(table, n)
        node, size, is_pivot = table.column("node").to_numpy(), np.diff(first), table.column("pivot").to_numpy()
        pivots = np.flatnonzero(fits & is_pivot)
        pivots = pivots[np.argsort(node[pivots])]  # the same order in every task of the tile
        others = np.flatnonzero(fits & ~is_pivot)
        parent = connected(h, first, pivots, None)
        classes, votes = np.unique(parent[pivots], return_counts=True)
        main = min(classes[votes == votes.max()], key=lambda r: node[pivots[parent[pivots] == r]].min())
        met = np.full(len(node), -1)
        met[pivots] = parent[pivots]
        for p in sorted(pivots.tolist(), key=lambda p: (parent[p] != main, node[p])):
            js = others[(met[others] < 0) & (5 * np.minimum(size[others], size[p]) >= 4 * np.maximum(size[others], size[p]))]
            for at in range(0, len(js), 256):
                part = js[at : at + 256]
                met[part[_links(h, first, p, part)]] = p
        some = np.flatnonzero(met >= 0)
        return pa.table([table.column("tile").take(pa.array(some)), pa.array(node[some]), pa.array(node[met[some]]), pa.array(parent[met[some]] == main)], names=["tile", "node", "pivot", "main"])

    return stored(rows.groupBy("tile", "salt").applyInArrow(run, "tile long, node long, pivot long, main boolean").distinct(), f"{folder}/pivoted")


def _may_link(n: np.ndarray, maps: list[bytes], side: np.ndarray | None) -> np.ndarray:
    """Roots of the texts under pairs, of different sides if given, whose bitmaps leave them a chance to link; n ascends."""
    parent = np.arange(len(n))
    bits = _bits(n)
    kinds = np.unique(bits)
    table = {k: np.frombuffer(b"".join(maps[i] for i in np.flatnonzero(bits == k).tolist()), np.uint64).reshape(-1, k // 64) for k in kinds.tolist()}
    for k in kinds.tolist():
        rows = np.flatnonzero(bits == k)
        _compare(n, parent, side, rows, table[k], rows, table[k])
        if 2 * k in table:  # the larger bitmaps fold onto the smaller size
            _compare(n, parent, side, rows, table[k], np.flatnonzero(bits == 2 * k), table[2 * k][:, : k // 64] ^ table[2 * k][:, k // 64 :])
    return parent


def _compare(n, parent, side, left, left_maps, right, right_maps) -> None:
    step = max(1, min(64, (1 << 20) // max(1, len(right))))
    for a in range(0, len(left), step):
        rows = left[a : a + step]
        hi = int(np.searchsorted(n[right], 5 * n[rows[-1]] // 4, "right"))
        lo = int(np.searchsorted(n[right], -(-4 * n[rows[0]] // 5) if side is not None and left is right else n[rows[0]]))
        cols = right[lo:hi]
        if not len(cols):
            continue
        differ = np.zeros((len(rows), len(cols)), np.int32)
        for k in range(left_maps.shape[1]):
            differ += np.bitwise_count(left_maps[a : a + step, k][:, None] ^ right_maps[lo:hi, k])
        both = n[rows][:, None] + n[cols]
        may = (9 * ((both - differ) // 2) >= 4 * both) & (rows[:, None] != cols)
        if side is not None:
            may &= side[rows][:, None] != side[cols]
        i, j = np.nonzero(may)
        united(parent, rows[i], cols[j])


def _groups_to_settle(members: DataFrame, block: int) -> DataFrame:
    """Group and node of the texts that may link in some tile; members: tile, node, n, bitmap, main.

    A block of a tile's texts meets every block of the tile but those of main
    texts, which are connected, among each other.
    """
    cells = [F.greatest(F.ceil(F.count_if(on) / block), F.ceil(F.sum(F.when(on, F.col("n"))) / BLOCK_SHINGLES)) for on in (~F.col("main"), F.col("main"))]
    sizes = members.groupBy("tile").agg(cells[0].alias("nb"), F.coalesce(cells[1], F.lit(0)).alias("gb")).where("nb > 0")
    spread = F.xxhash64("node")
    own = F.when(F.col("main"), F.col("nb") + F.pmod(spread, F.greatest("gb", F.lit(1)))).otherwise(F.pmod(spread, "nb")).cast("int")
    rest = block_tasks(F.col("nb") + F.col("gb"), F.col("b"))
    guest = F.transform(F.sequence(F.lit(0), F.col("nb").cast("int") - 1), lambda o: F.struct(o.alias("bi"), F.col("b").alias("bj")))
    tasks = members.join(sizes, "tile").withColumn("b", own).withColumn("task", F.explode(F.when(F.col("main"), guest).otherwise(rest)))

    def run(table: pa.Table) -> pa.Table:
        n, node, b = table.column("n").to_numpy(), table.column("node").to_numpy(), table.column("b").to_numpy()
        order = np.lexsort((node, n))
        maps = table.column("bitmap").to_pylist()
        node = node[order]
        root = _may_link(n[order], [maps[i] for i in order.tolist()], None if (b == b[0]).all() else b[order])
        some = np.bincount(root, minlength=len(root))[root] > 1
        total = np.zeros(len(root), np.uint64)
        np.add.at(total, root[some], mix(node[some].view(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D)))
        return pa.table([pa.array(mix(total)[root[some]].view(np.int64)), pa.array(node[some])], names=["tile", "node"])

    return tasks.select("tile", "task.bi", "task.bj", "b", "node", "n", "bitmap").groupBy("tile", "bi", "bj").applyInArrow(run, "tile long, node long").distinct()


def _settled(members: DataFrame, n: int) -> DataFrame:
    """Edges (a, b) that connect the linked texts of each group: one for each text that isn't its component's first."""

    def run(table: pa.Table) -> pa.Table:
        want = table.column("node").to_numpy()
        h, first, fits = _read_sets(table, n)
        _, one = np.unique(want[fits], return_index=True)
        rows = np.flatnonzero(fits)[one]
        parent = connected(h, first, rows, None)
        moved = rows[parent[rows] != rows]
        return pa.table([pa.array(want[moved]), pa.array(want[parent[moved]])], names=["a", "b"])

    return members.groupBy("tile").applyInArrow(run, "a long, b long")


def _fetched(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and text of the wanted texts (loc, node), one row each.

    A table of at most 2**WANTED_BITS bits of hashed locators, broadcast in rows
    of 4 KB, keeps most other texts out of the exchange; the join on the
    locator itself then decides.
    """
    bits = 1 << min(WANTED_BITS, max(16, (16 * wanted.count()).bit_length()))
    bit = F.pmod(F.xxhash64(F.lit(5), "loc"), F.lit(bits))
    row, at = (bit / 32768).cast("int"), (bit % 32768).cast("int")
    marks = wanted.select(row.alias("row"), at.cast("long").alias("at")).groupBy("row").agg(F.bitmap_construct_agg("at").alias("marks"))
    byte = F.conv(F.hex(F.expr("substring(marks, at div 8 + 1, 1)")), 16, 10).cast("int")
    likely = source.withColumns({"row": row, "at": at}).join(F.broadcast(marks), "row").where(F.getbit(byte, F.col("at") % 8) == 1)
    return likely.select("loc", "text").join(wanted, "loc").dropDuplicates(["loc"]).select("node", "text")


def groups(docs: DataFrame, shingle: int = 5, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable by links, itself included).

    Documents link when the Jaccard similarity of their shingle sets is 4/5 or
    more.  Words are runs of anything but ASCII white space, A-Z lower-cased; a
    text of fewer words than a shingle is one shingle, and one without words
    (null, empty, blank) links with nothing.  Equal sets are one node in all
    that follows the first scan, so copies cost no more than one text.  Rows
    that repeat a doc_id stay documents of their own.  Nodes bear 64-bit hashes
    of their sets.  An empty table gives an empty result; further columns are
    left out.
    """
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    source = source.withColumn("loc", F.xxhash64("doc_id", "text"))
    return _grouped(source, shingle, block, hot).select("doc_id", "n_shingles", "component_id")


def first_rows(docs: DataFrame, shingle: int = 5, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """Of each group of linked documents one row of docs: that with the least doc_id, then the least hash of the row.

    Documents are rows, whether or not their doc_ids repeat or are null; a null
    doc_id comes after all others.  Of equal rows any one stays.  Rows without
    words link with nothing, so all of them stay.  Columns may bear any names;
    an empty table gives one.
    """
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "doc_id", "text")
    source = packed.where(words).withColumn("loc", F.xxhash64(*[x for c in docs.columns for x in (F.col(f"__row.`{c}`"), F.col(f"__row.`{c}`").isNull())]))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "loc"))
    kept = _grouped(source.select("doc_id", "text", "loc"), shingle, block, hot).groupBy("root").agg(least.alias("least")).select("least.loc")
    # joined and told apart by the same key, so rows move once
    return source.join(kept, "loc", "left_semi").dropDuplicates(["loc"]).select("__row.*").unionByName(packed.where(~words).select("__row.*"))


def _grouped(source: DataFrame, shingle: int, block: int, hot: int) -> DataFrame:
    """doc_id, loc, n_shingles, root (null without words) and component_id of each row; source: doc_id, text, loc, a hash by which a text is found again."""
    spark = source.sparkSession
    ship(spark)
    folder = shared_dir(spark)
    scan = stored(_scan(source, "text", shingle), f"{folder}/scan")
    rows = scan.where("part is null").select("doc_id", "loc", "node", "n", "bitmap")
    grouped = rows.where("node is not null").groupBy("node")
    nodes = stored(grouped.agg(F.min("doc_id").alias("lo"), F.min("loc").alias("loc"), F.min("n").alias("n"), F.min("bitmap").alias("bitmap")), f"{folder}/nodes")
    counts = spark.sparkContext.broadcast(_summed(scan.where("part is not null").select("part", "counts")))
    tiles = _named(stored(_tiles(_postings(source.select("text"), counts, shingle, hot)), f"{folder}/tiles"))
    met = tiles.join(nodes.select("node", "n", "bitmap"), "node")
    pivoted = _pivoted(tiles, nodes, source, shingle, block, folder)
    if pivoted is None:
        met = met.withColumn("main", F.lit(False))
    else:
        main = pivoted.where("main").select("tile", "node", "main").distinct()
        met = met.join(main, ["tile", "node"], "left").withColumn("main", F.coalesce("main", F.lit(False)))
    members = stored(_groups_to_settle(met, block), f"{folder}/members")
    wanted = stored(nodes.join(members.select("node").distinct(), "node").select("node", "loc"), f"{folder}/wanted")
    edges = _settled(members.join(_fetched(source, wanted), "node"), shingle)
    if pivoted is not None:
        edges = edges.unionByName(pivoted.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")))
    edges = stored(edges, f"{folder}/edges")
    dropped(spark, *(f"{folder}/{x}" for x in ("tiles", "members", "wanted", "large", "pivot-wanted", "pivoted")))
    known = nodes.select("node", "lo").join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("lo").alias("component_id"))
    known = known.join(least, "root").select("node", "root", "component_id")
    alone = rows.where("node is null").select("doc_id", "loc", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    return rows.where("node is not null").join(known, "node").select("doc_id", "loc", F.col("n").alias("n_shingles"), "root", "component_id").unionByName(alone)
