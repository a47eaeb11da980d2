"""Set pairs of at least a Jaccard similarity, exactly, in blocks of bounded size.

Sets are written once as hashed words, rare ones first, in blocks of like sizes.  A task
holds two blocks, whatever the table's size, and reads them from the shared folder, so no
pair and no copy of a set is shuffled.  All pairs of blocks whose sizes allow the
similarity are visited: the work is quadratic where all sets are of one size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sinks import scratch_folder

#: Hashed words and sets in a block, places of the table of word frequencies, cells of counts at a time, blocks that meet in a task.
BLOCK_WORDS, BLOCK_SETS, PLACES, CELLS, RUN = 4_000_000, 40_000, 1 << 20, 4_000_000, 4
HASHES = (F.xxhash64, *[partial(lambda seed, w: F.xxhash64(F.lit(seed), w), seed) for seed in range(4)])


def _ordered(batches: Iterator[pa.RecordBatch], classes: bytes) -> Iterator[pa.RecordBatch]:
    """Words of every set by rarity of their place, then by hash: one order for all sets."""
    rare = np.frombuffer(classes, np.uint8)
    for b in batches:
        lists = b.column("h")
        h, n = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(n)), n)
        h = h[np.lexsort((h, rare[h & (PLACES - 1)], row))]
        offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(h)) if name == "h" else b.column(name) for name in b.schema.names], names=b.schema.names)


class Block:
    """The sets of one block: keys, sizes, and their words one after another."""

    def __init__(self, at: str, number: int):
        system, path = fs.FileSystem.from_uri(at)
        path = f"{path}/block={number}"
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        tables = [pq.read_table(f.path, filesystem=system, partitioning=None) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".parquet")]
        table = pa.concat_tables(tables).combine_chunks() if tables else None
        self.key = pa.array([]) if table is None else table["key"].combine_chunks()
        self.n = np.zeros(0, np.int64) if table is None else table["n"].to_numpy().astype(np.int64)
        lists = None if table is None else table["h"].combine_chunks()
        self.words = np.zeros(0, np.int64) if lists is None else lists.flatten().to_numpy()
        self.start = np.concatenate([[0], np.cumsum(self.n)])
        self.place = np.arange(len(self.words)) - np.repeat(self.start[:-1], self.n)
        self.row = np.repeat(np.arange(len(self.n)), self.n)

    def prefixes(self, least: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """How many first words of each set must meet how many of those of a similar set of ``least`` words or more."""
        need = np.ceil(threshold / (1 + threshold) * (self.n + np.maximum(least, threshold * self.n)) - 1e-6).astype(np.int64)
        meet = np.clip(np.minimum(4 + self.n // 24, need), 0, None)
        return self.n - need + meet, meet


def _met(a: Block, b: Block, ids: np.ndarray, size: int, inverse: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, ...]:
    """Rows of both blocks whose sets are similar, and how many words they share.

    ``ids`` are a's words as places in b's vocabulary of ``size`` (or -1), ``inverse`` b's own.
    """
    pa_, la = a.prefixes(int(b.n.min()), threshold)
    pb, lb = b.prefixes(int(a.n.min()), threshold)
    held = b.place < pb[b.row]
    words, rows = inverse[held], b.row[held]
    order = np.argsort(words, kind="stable")
    posts = rows[order]
    ends = np.cumsum(np.bincount(words, minlength=size))
    asked = (a.place < pa_[a.row]) & (ids >= 0)
    w, x = ids[asked], a.row[asked]
    first = np.where(w > 0, ends[w - 1], 0)
    many = ends[w] - first
    width, step = len(b.n), max(1, CELLS // len(b.n))
    every = (la.min() == 0) | (lb.min() == 0)
    least = np.minimum(la.min(), lb.min())
    need = threshold / (1 + threshold)
    out = []
    mark = np.zeros(size, bool)
    load = np.concatenate([[0], np.cumsum(np.bincount(x, many, len(a.n)))])
    at = 0
    while at < len(a.n):
        to = min(len(a.n), at + step)
        to = max(at + 1, min(to, int(np.searchsorted(load, load[at] + CELLS, "right")) - 1))
        i, j = np.searchsorted(x, [at, to])
        m = many[i:j]
        total = int(m.sum())
        here = np.repeat(first[i:j] - (np.cumsum(m) - m), m) + np.arange(total)
        cells = np.repeat((x[i:j] - at) * width, m) + posts[here]
        count = np.bincount(cells, minlength=(to - at) * width)
        hit = np.arange(len(count)) if every else np.flatnonzero(count >= least)
        u, v = hit // width + at, hit % width
        ok = count[hit] >= np.minimum(la[u], lb[v])
        ok &= np.minimum(a.n[u], b.n[v]) >= threshold * np.maximum(a.n[u], b.n[v]) - 1e-6
        if same:
            ok &= u > v
        u, v = u[ok], v[ok]
        at = to
        for r, s, e in zip(*np.unique(u, return_index=True), [*np.flatnonzero(np.diff(u)) + 1, len(u)], strict=True) if len(u) else ():
            own = ids[a.start[r] : a.start[r + 1]]
            own = own[own >= 0]
            mark[own] = True
            for q in range(s, e, 10_000):
                some = v[q : min(e, q + 10_000)]
                n = b.n[some]
                flat = np.repeat(b.start[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                shared = np.add.reduceat(mark[inverse[flat]].astype(np.int64), np.cumsum(n) - n)
                good = shared >= need * (a.n[r] + n) - 1e-6
                out.append((np.full(int(good.sum()), r), some[good], shared[good]))
            mark[own] = False
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _meetings(batches: Iterator[pa.RecordBatch], runs: list[tuple[int, list[int]]], left: str, right: str, threshold: float, same: bool) -> Iterator[pa.RecordBatch]:
    """Keys of similar sets, of one block of the right table and a run of blocks of the left one at a time."""
    for batch in batches:
        for number in batch.column(0).to_pylist():
            j, run = runs[number]
            b = Block(right, j)
            if not len(b.n):
                continue
            vocabulary, inverse = np.unique(b.words, return_inverse=True)
            for i in run:
                alike = same and i == j
                a = b if alike else Block(left, i)
                if not len(a.n):
                    continue
                ids = inverse
                if not alike:
                    ids = np.minimum(np.searchsorted(vocabulary, a.words), len(vocabulary) - 1)
                    ids = np.where(vocabulary[ids] == a.words, ids, -1)
                u, v, k = _met(a, b, ids, len(vocabulary), inverse, threshold, alike)
                for q in range(0, len(u), 50_000):
                    x, y = u[q : q + 50_000], v[q : q + 50_000]
                    yield pa.RecordBatch.from_arrays([a.key.take(pa.array(x)), b.key.take(pa.array(y)), pa.array(k[q : q + 50_000]), pa.array(a.n[x] + b.n[y])], names=["a", "b", "shared", "both"])


def _blocks(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(smallest size, first block, blocks) by size: neighbouring sizes fill a block, or one size has several."""
    counts = sorted((r["n"], r["count"]) for r in rows.groupBy("n").count().collect())  # as many rows as there are sizes
    out, block, words, sets = [], 0, 0, 0
    for n, count in counts:
        if words and (words + n * count > BLOCK_WORDS or sets + count > BLOCK_SETS):
            block, words, sets = block + 1, 0, 0
        parts = max(-(-n * count // BLOCK_WORDS), -(-count // BLOCK_SETS))
        out.append((n, block, parts))
        if parts > 1:
            block, words, sets = block + parts, 0, 0
        else:
            words, sets = words + n * count, sets + count
    return out


def similar(left: DataFrame, right: DataFrame | None, key: str, threshold: float) -> DataFrame:
    """a, b, shared, both: keys of all set pairs (``key``, words) of at least ``threshold``, each once; words in common, and of both sizes.

    Words are told apart by 64-bit hashes, by another seed where two words of the tables have one hash.
    """
    spark = left.sparkSession
    root = f"{scratch_folder(spark)}/weftline-sets-{uuid.uuid4().hex}"
    tables = [d.select(F.col(key).alias("key"), F.size("words").alias("n"), "words").where("n > 0") for d in (left, right) if d is not None]
    words = reduce(DataFrame.unionByName, [d.select(F.explode("words").alias("w")) for d in tables])
    for hashed in HASHES:
        # a word's second hash tells whether another one shares its first
        vocabulary = words.select(hashed("w").alias("h"), F.xxhash64("w", F.lit("second")).alias("s")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), (F.min("s") != F.max("s")).alias("two"))
        places = vocabulary.groupBy(F.expr(f"cast(h & {PLACES - 1} as int)").alias("p")).agg(F.sum("n").alias("n"), F.max("two").alias("two")).toArrow()  # one row a place at most
        if not any(places["two"].to_pylist()):
            break
    else:
        raise ValueError("words share every hash")
    seen = np.zeros(PLACES, np.int64)
    seen[places["p"].to_numpy()] = places["n"].to_numpy()
    classes = spark.sparkContext.broadcast(np.minimum(255, 10 * np.log2(seen + 1)).astype(np.uint8).tobytes())
    spans: list[list[tuple[int, int, int]]] = []
    for name, d in zip(("left", "right"), tables, strict=False):
        sizes = _blocks(d)
        groups: dict[int, tuple[int, int]] = {}
        for n, block, parts in sizes:
            for k in range(block, block + parts):
                groups[k] = (min(n, groups.get(k, (n, n))[0]), max(n, groups.get(k, (n, n))[1]))
        spans.append([(k, *v) for k, v in sorted(groups.items())])
        if not sizes:
            continue
        table = spark.createDataFrame(sizes, "n int, first int, parts int")
        placed = d.join(F.broadcast(table), "n").select("key", "n", F.transform("words", lambda w: hashed(w)).alias("h"), (F.col("first") + F.pmod(F.xxhash64("key"), F.col("parts"))).cast("int").alias("block"))
        schema = T.StructType([placed.schema["key"], placed.schema["n"], placed.schema["h"], placed.schema["block"]])
        placed = placed.mapInArrow(lambda batches: _ordered(batches, classes.value), schema)
        placed.repartition(len(groups), "block").write.partitionBy("block").parquet(f"{root}/{name}")
    kind = T.StructType([T.StructField("a", tables[0].schema["key"].dataType), T.StructField("b", tables[-1].schema["key"].dataType), T.StructField("shared", T.LongType()), T.StructField("both", T.LongType())])
    runs: list[tuple[int, list[int]]] = []
    for j, low, high in spans[-1]:
        near = [i for i, lo, hi in spans[0] if hi >= threshold * low - 1 and high >= threshold * lo - 1 and (right is not None or i <= j)]
        runs += [(j, near[k : k + RUN]) for k in range(0, len(near), RUN)]
    if not runs:
        return spark.createDataFrame([], kind)
    known, same = spark.sparkContext.broadcast(runs), right is None
    ends = f"{root}/left", f"{root}/{'left' if same else 'right'}"
    return spark.range(0, len(runs), 1, len(runs)).mapInArrow(lambda batches: _meetings(batches, known.value, *ends, threshold, same), kind)
