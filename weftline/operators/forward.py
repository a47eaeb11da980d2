"""BM25 of a stated query set: documents stay in their tasks, which keep the best of every query.

A forward index holds, for every document, its length and the query words in it.  It is made without
a shuffle; scores add up within a task, so of all matches only k rows a query and task leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from ..session import spread

#: (query, token) rows that tasks hold at most; (document, query) cells that are scored at a time.
MOST_ASKED, CELLS = 2_000_000, 2_000_000


def _words(batches: Iterator[pa.RecordBatch], vocabulary: list[str]) -> Iterator[pa.RecordBatch]:
    values = pa.array(vocabulary, pa.string())

    def places(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row and place of every known word."""
        flat = pc.index_in(lists.flatten(), value_set=values)
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        known = flat.is_valid().to_numpy(zero_copy_only=False)
        return row[known], flat.fill_null(0).to_numpy()[known].astype(np.int64)

    for b in batches:
        size = max(1, len(vocabulary))
        row, word = places(b.column("t"))
        cells, tf = np.unique(row * size + word, return_counts=True)
        row, word = places(b.column("title"))
        titled = np.isin(cells, row * size + word)
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(cells // size, minlength=b.num_rows))]), pa.int32())
        listed = lambda x, kind: pa.ListArray.from_arrays(offsets, pa.array(x, kind))
        n = pa.array(np.diff(b.column("t").offsets.to_numpy()), pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("doc"), n, listed(cells % size, pa.int32()), listed(tf, pa.int32()), listed(titled, pa.bool_())], names=["doc", "len", "words", "tf", "titled"])


def forward(docs: DataFrame, doc_key: str, text: str, vocabulary: list[str], title: Column | None, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc, len, words (places in ``vocabulary``), tf, titled: one row a document, written once.

    Null and empty texts are documents without tokens; rows that repeat a key are one document of all their tokens.
    """
    none = F.array().cast("array<string>")
    held = spread(docs).select(F.col(doc_key).alias("doc"), tokens(text).alias("t"), (none if title is None else F.array_distinct(tokens(title))).alias("title"))
    kind = T.StructType([held.schema["doc"], *[T.StructField(n, k) for n, k in (("len", T.IntegerType()), ("words", T.ArrayType(T.IntegerType())), ("tf", T.ArrayType(T.IntegerType())), ("titled", T.ArrayType(T.BooleanType())))]])
    rows = write(held.mapInArrow(lambda batches: _words(batches, vocabulary), kind))
    twice = rows.groupBy("doc").count().where("count > 1").select("doc")
    if twice.isEmpty():
        return rows
    again = rows.join(twice, "doc", "left_semi")
    lengths = again.groupBy("doc").agg(F.sum("len").cast("int").alias("len"))
    cells = again.select("doc", F.explode_outer(F.arrays_zip("words", "tf", "titled")).alias("c")).groupBy("doc", "c.words").agg(F.sum("c.tf").cast("int").alias("tf"), F.max("c.titled").alias("titled")).where("words is not null")
    lists = cells.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("words", "tf", "titled"))).alias("c"))
    lists = lists.select("doc", "c.words", "c.tf", "c.titled")
    merged = lengths.join(lists, "doc", "left").select("doc", "len", *[F.coalesce(n, F.array().cast(kind[n].dataType)).alias(n) for n in ("words", "tf", "titled")])
    return write(rows.join(twice, "doc", "left_anti").unionByName(merged))


def _best(batches: Iterator[pa.RecordBatch], word: np.ndarray, query: np.ndarray, m: np.ndarray, idf: np.ndarray, queries: int, avg_len: float, k: int, k1: float, b: float, bonus: float) -> Iterator[pa.RecordBatch]:
    """The best k (query, doc, score) of every query in a task; ties to the larger doc.  ``word`` is sorted."""
    first, last = np.searchsorted(word, np.arange(len(idf))), np.searchsorted(word, np.arange(len(idf)), "right")
    kept: pa.Table | None = None
    floor = np.zeros(queries)
    for whole in batches:
        step = max(1, CELLS // max(1, queries))
        for at in range(0, whole.num_rows, step):
            part = whole.slice(at, step)
            lists = part.column("words")
            w = lists.flatten().to_numpy()
            row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            tf, titled = part.column("tf").flatten().to_numpy(), part.column("titled").flatten().to_numpy(zero_copy_only=False)
            size = part.column("len").to_numpy()[row]
            weight = idf[w] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / avg_len)) + np.where(titled, bonus * idf[w], 0.0)
            scores = np.zeros(part.num_rows * queries)
            load = np.cumsum(last[w] - first[w])
            cut = 0
            while cut < len(w):  # a bounded number of (word, query) meetings at a time
                to = max(cut + 1, int(np.searchsorted(load, (load[cut - 1] if cut else 0) + 4 * CELLS, "right")))
                x = w[cut:to]
                n = last[x] - first[x]
                meet = np.repeat(first[x] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                scores += np.bincount(np.repeat(row[cut:to] * queries, n) + query[meet], np.repeat(weight[cut:to], n) * m[meet], len(scores))
                cut = to
            scores = np.floor(scores * 1e6 + 0.5) / 1e6
            table = scores.reshape(-1, queries)
            good = table > 0
            if len(table) > k:
                floor = np.maximum(floor, np.partition(table, len(table) - k, axis=0)[len(table) - k])
            d, q = np.nonzero(good & (table >= floor))
            if not len(d):
                continue
            new = pa.table({"q": pa.array(q, pa.int32()), "score": pa.array(table[d, q]), "doc": part.column("doc").take(pa.array(d))})
            both = new if kept is None else pa.concat_tables([kept, new])
            both = both.take(pc.sort_indices(both, [("q", "ascending"), ("score", "descending"), ("doc", "descending")])).combine_chunks()
            qs = both["q"].to_numpy()
            place = np.arange(len(qs)) - np.searchsorted(qs, qs)
            kept = both.filter(pa.array(place < k))
            full = np.flatnonzero(place == k - 1)
            floor[qs[full]] = np.maximum(floor[qs[full]], both["score"].to_numpy()[full])
    if kept is not None:
        yield from kept.combine_chunks().to_batches()


def asked_words(queries: DataFrame, query_key: str, text: str) -> DataFrame:
    """``query_key``, token, m."""
    return queries.select(query_key, F.explode(tokens(text)).alias("token")).groupBy(query_key, "token").agg(F.count(F.lit(1)).alias("m"))


def best(index: DataFrame, vocabulary: list[str], asked: list[tuple[int, str, int]], queries: int, k: int, k1: float, b: float, title_bonus: float) -> DataFrame:
    """q, score, doc: the best k of every task and query over a forward index; ``asked`` has (number of the query, token, m)."""
    spark = index.sparkSession
    n, words = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
    df = np.zeros(len(vocabulary))
    for w, c in index.select(F.explode("words").alias("w")).groupBy("w").count().collect():  # a row a word of the queries
        df[w] = c
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    at = {w: i for i, w in enumerate(vocabulary)}
    rows = sorted((at[t], q, m) for q, t, m in asked)
    word, query, m = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    known = spark.sparkContext.broadcast((word, query, m, idf, queries, words / max(n, 1) or 1.0, k, k1, b, title_bonus))
    kind = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("score", T.DoubleType()), index.schema["doc"]])
    return index.mapInArrow(lambda batches: _best(batches, *known.value), kind)
