"""Exact top-k inner products with block-at-a-time pruning.

Vectors' components are terms with integer weights floor(scale * x).  A task orders its
candidates by their dominant term, so that neighbours resemble one another, and cuts
them into ranges, a block each, with the maximum and minimum of every term.  For a
query, a block's bound is the sum over terms of the larger of weight * maximum and
weight * minimum; blocks are scored in order of falling bounds through their forward
index (a dense matrix, or the terms that aren't 0 where these are few) until the bounds
fall below the k-th best score.  Blocks are taken in windows of doubling size, so that
queries that want the same block share its product.  The k-th best of a bounded sample
of candidates starts each task's threshold; it can't exceed the true one, so pruning by
it loses nothing.  ``pruning`` counts the blocks that each query had scored.

Defined cases: vectors that are null, or hold a null or non-finite component, take
no part, nor do null ids; a shorter vector counts as padded by zeros; rows with the
query's own id aren't candidates; rows that repeat an id are candidates, and
queries, of their own; ties go to the smaller id; fewer than k candidates give all.

Scale: candidates never move.  Queries are broadcast in chunks of at most
``CHUNK_BYTES``, one at a time, with one pass over the candidates for each; the driver
holds one chunk.  Each task returns at most k rows per query, and only those that reach
the sample's threshold.  The work is that of a stated query set against all rows:
where vectors have no structure, as in uniform ones, no bound prunes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, scratch_path

CHUNK_BYTES = 32 << 20
SAMPLE = 2048
BLOCK = 128
#: Share of components other than 0 below which a block keeps these alone.
SPARSE = 0.1


def _matrix(column: pa.Array) -> np.ndarray:
    """rows x dims of int64; shorter vectors are padded by zeros."""
    off = column.offsets.to_numpy().astype(np.int64)
    flat = np.asarray(column.values, np.int64)
    size = np.diff(off)
    dims = int(size.max()) if len(size) else 0
    if len(size) and (size == dims).all():
        return flat[off[0] : off[-1]].reshape(len(size), dims)
    out = np.zeros((len(size), dims), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(off[0], off[-1]) - off[row]] = flat[off[0] : off[-1]]
    return out


def _match(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = max(a.shape[1], b.shape[1])
    grow = lambda x: x if x.shape[1] == d else np.pad(x, ((0, 0), (0, d - x.shape[1])))
    return grow(a), grow(b)


def products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where it is exact."""
    q, d = _match(q, d)
    if not q.size or not d.size:
        return np.zeros((len(q), len(d)), np.int64)
    if d.shape[1] > 256 and np.count_nonzero(d) < SPARSE * d.size:
        row, term = np.nonzero(d)
        weight, first = d[row, term], np.searchsorted(row, np.arange(len(d)))
        full = np.flatnonzero(np.diff(np.concatenate((first, [len(row)]))))
        out = np.zeros((len(q), len(d)), np.int64)
        if len(full):
            out[:, full] = np.add.reduceat(q[:, term] * weight, first[full], 1)
        return out
    reach = float(np.dot(np.abs(q).max(0).astype(float), np.abs(d).max(0).astype(float)))
    if reach < 2.0**53:
        return np.rint(q.astype(float) @ d.astype(float).T).astype(np.int64)
    return q @ d.T


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """queries x blocks: no vector of the block scores more.  Rounded up by more than the sum of its terms' errors."""
    up, down, high, low = (x.astype(float) for x in (np.maximum(q, 0), np.minimum(q, 0), high, low))
    size = up @ np.abs(high).T + -down @ np.abs(low).T  # of the terms, which may cancel
    return up @ high.T + down @ low.T + size * (1e-15 * (q.shape[1] + 8)) + 1e-6


class Best:
    """The k best (score, id) of each query, ties to the smaller id."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor.copy()
        self.q = np.zeros(0, np.int64)
        self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(q):
            return
        q, score, ids = np.concatenate((self.q, q)), np.concatenate((self.score, score)), np.concatenate((self.id, ids))
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        first = np.concatenate(([True], q[1:] != q[:-1]))
        start = np.flatnonzero(first)
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.concatenate((start, [len(q)]))))
        keep = rank < self.k
        full = rank == self.k - 1
        self.floor[q[full]] = np.maximum(self.floor[q[full]], score[full])
        self.q, self.score, self.id = q[keep], score[keep], ids[keep]


def cut_blocks(ids: np.ndarray, v: np.ndarray, size: int = BLOCK) -> list[tuple[np.ndarray, np.ndarray]]:
    """Blocks of vectors with equal or near dominant terms (of largest weight, by sign)."""
    if not len(ids):
        return []
    top = np.abs(v).argmax(1) if v.shape[1] else np.zeros(len(v), np.int64)
    sign = np.take_along_axis(v, top[:, None], 1)[:, 0] > 0 if v.shape[1] else top > 0
    order = np.lexsort((ids, sign, top))
    return [(ids[order[a : a + size]], v[order[a : a + size]]) for a in range(0, len(ids), size)]


def search(q: np.ndarray, own: np.ndarray, floor: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[Best, np.ndarray]:
    """Best candidates of ``blocks`` (ids, vectors) for the queries, none below ``floor``; the blocks that each query had scored."""
    best, scored = Best(floor, k), np.zeros(len(q), np.int64)
    if not blocks or not len(q):
        return best, scored
    dims = max(q.shape[1], *(v.shape[1] for _, v in blocks))
    wide = lambda x: np.pad(x, (0, dims - len(x)))
    high, low = (np.stack([wide(f(v, 0)) for _, v in blocks]) for f in (np.max, np.min))
    q, _ = _match(q, high)
    bound = bounds(q, high, low)
    order = np.argsort(-bound, 1, kind="stable")
    falling = np.take_along_axis(bound, order, 1)
    at, window = 0, 1
    while at < len(blocks):
        who, rank = np.nonzero(falling[:, at : at + window] >= best.floor[:, None])
        if not len(who):
            break  # bounds fall from here on for every query
        which = order[who, at + rank]
        turn = np.argsort(which, kind="stable")
        cuts = np.searchsorted(which[turn], np.arange(len(blocks) + 1))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            mine = who[turn[cuts[b] : cuts[b + 1]]]
            mine = mine[bound[mine, b] >= best.floor[mine]]
            if not len(mine):
                continue
            ids, v = blocks[b]
            score = products(q[mine], v)
            scored[mine] += 1
            hit, col = np.nonzero((score >= best.floor[mine][:, None]) & (ids[None, :] != own[mine][:, None]))
            found.append((mine[hit], score[hit, col], ids[col]))
            if sum(len(x[0]) for x in found) > 4 * k * len(q):
                best.add(*map(np.concatenate, zip(*found, strict=True)))
                found = []
        if found:
            best.add(*map(np.concatenate, zip(*found, strict=True)))
        at, window = at + window, 2 * window
    return best, scored


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: float = 1024.0) -> DataFrame:
    """id, v (array of long) of the rows that take part."""
    v = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(sound).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))


def _sample(candidates: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a bounded sample, spread by hash."""
    some = candidates.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    return (some.column("id").to_numpy(), _matrix(some.column("v").combine_chunks())) if some.num_rows else (np.zeros(0, np.int64), np.zeros((0, 0), np.int64))


def _chunks(queries: DataFrame, chunk_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries, a chunk at a time."""
    size = queries.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    each = max(1, chunk_bytes // max(8 * (size[1] or 1), 1))
    chunks = -(-size[0] // each)
    numbered = queries if chunks <= 1 else saved(queries.withColumn("_c", F.pmod(F.xxhash64("id"), F.lit(chunks))), "queries")
    for c in range(chunks):
        mine = (numbered if chunks <= 1 else numbered.where(F.col("_c") == c).drop("_c")).toArrow()
        if mine.num_rows:
            yield mine.column("id").to_numpy(), _matrix(mine.column("v").combine_chunks())


def _pass(candidates: DataFrame, var, k: int, query_base: int, count: bool) -> DataFrame:
    """One chunk of queries against all candidates: query, query_id, vec_id, score, or with ``count`` the blocks scored and held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q, sample_id, sample_v = var.value
        floor = np.full(len(q), np.iinfo(np.int64).min)
        for a in range(0, len(q), 1024):
            s = products(q[a : a + 1024], sample_v) if len(sample_id) else np.zeros((0, 0))
            if s.size and s.shape[1] > k:
                s[sample_id[None, :] == own[a : a + 1024, None]] = np.iinfo(np.int64).min
                floor[a : a + 1024] = np.partition(s, s.shape[1] - k, 1)[:, s.shape[1] - k]

        def done(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            dims = max((v.shape[1] for _, v in held), default=0)
            v = np.concatenate([np.pad(v, ((0, 0), (0, dims - v.shape[1]))) for _, v in held]) if held else np.zeros((0, 0), np.int64)
            blocks = cut_blocks(np.concatenate([i for i, _ in held]), v) if held else []
            for a in range(0, len(q), 1024):
                b, scored = search(q[a : a + 1024], own[a : a + 1024], floor[a : a + 1024], blocks, k)
                floor[a : a + 1024] = b.floor
                if count:
                    yield pa.RecordBatch.from_arrays([pa.array(own[a : a + 1024]), pa.array(scored), pa.array(np.full(len(scored), len(blocks)))], names=["query_id", "scored", "blocks"])
                elif len(b.q):
                    yield pa.RecordBatch.from_arrays([pa.array((b.q + a) + query_base), pa.array(own[b.q + a]), pa.array(b.id), pa.array(b.score)], names=["query", "query_id", "vec_id", "score"])

        held: list = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(), _matrix(batch.column(1))))
            rows += held[-1][1].size + len(held[-1][0])
            if rows > 16 << 20:  # a task's blocks stay within 128 MB
                yield from done(held)
                held, rows = [], 0
        if held:
            yield from done(held)

    return candidates.mapInArrow(run, "query_id long, scored long, blocks long" if count else "query long, query_id long, vec_id long, score long")


def _passes(candidates: DataFrame, queries: DataFrame, k: int, chunk_bytes: int, count: bool) -> DataFrame | None:
    """All chunks' passes; where there are several, each is written before the next one's broadcast."""
    spark = candidates.sparkSession
    sample = _sample(candidates)
    folder, base, last = None, 0, None
    for own, q in _chunks(queries, chunk_bytes):
        if last is not None:
            folder = folder or scratch_path(spark, "top-k")
            last[0].write.mode("append").parquet(folder)
            last[1].destroy()
        var = spark.sparkContext.broadcast((own, q, *sample))
        last = _pass(candidates, var, k, base, count), var
        base += len(own)
    if folder is None:
        return last and last[0]
    last[0].write.mode("append").parquet(folder)
    last[1].destroy()
    return spark.read.parquet(folder)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score for (id, v) tables; exact."""
    found = _passes(candidates, queries, k, chunk_bytes, False)
    if found is None:
        return candidates.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def pruning(candidates: DataFrame, queries: DataFrame, k: int = 10, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """query_id, scored, blocks: how many of the tasks' blocks each query had scored (rows that repeat an id add up)."""
    found = _passes(candidates, queries, k, chunk_bytes, True)
    if found is None:
        return candidates.sparkSession.createDataFrame([], "query_id long, scored long, blocks long")
    return found.groupBy("query_id").agg(F.sum("scored").alias("scored"), F.sum("blocks").alias("blocks"))
