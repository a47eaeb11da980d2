"""Lexical and dense ranking of documents for batches of queries.

The inverted index is a table of postings; queries meet it in an equi-join on
tokens.  Only tokens that some query asks for enter the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.citations import alias_regex
from ..functions.text import dot, tokens, unit_vector
from ..session import spread
from . import forward

K1, B, TITLE_BONUS, RRF_C, GUIDANCE_SLOTS = 1.5, 0.75, 0.75, 60, 2


def term_frequencies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, token, tf."""
    return docs.select(key, F.explode(tokens(text)).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(tf: DataFrame, n_docs: DataFrame) -> DataFrame:
    """token, df, idf = ln(1 + (n - df + 0.5) / (df + 0.5)); ``n_docs`` holds one row, n."""
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n_docs)).select("token", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def length_stats(docs: DataFrame, text: str) -> DataFrame:
    """One row: n and avg_len (tokens), at least one document counted."""
    return docs.agg(F.count(F.lit(1)).alias("n"), (F.sum(F.size(tokens(text))) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("avg_len"))


def expand(queries: DataFrame, text: str, synonyms: list[tuple[str, str]]) -> Column:
    """The lower-cased query and the expansion of each phrase in it, in table order.

    ASCII phrases need word borders; others are found anywhere.
    """
    q = F.lower(F.col(text))
    hits = [F.when(q.rlike(alias_regex(p)) if p[:1].isascii() else F.contains(q, F.lit(p)), F.lit(x)) for p, x in synonyms]
    return F.concat_ws(" ", q, F.array_join(F.array_compact(F.array(*hits)), " ")) if hits else q


def bm25(queries: DataFrame, docs: DataFrame, query_key: str, doc_key: str, query_text: str, doc_text: str, title: Column | None = None, k: int | None = None, k1: float = K1, b: float = B, title_bonus: float = TITLE_BONUS) -> DataFrame:
    """``query_key``, ``doc_key``, score, rank: all matches, or the best ``k``; ties to the larger ``doc_key``.

    Query tokens count as often as they occur.  With ``title``, a query token that it
    holds adds ``title_bonus`` times its idf.  Scores are rounded before ranking.
    """
    asked = queries.select(query_key, F.explode(tokens(query_text)).alias("token")).groupBy(query_key, "token").agg(F.count(F.lit(1)).alias("m"))
    vocabulary = asked.select("token").distinct()
    words = docs.select(doc_key, tokens(doc_text).alias("_t"), *([F.array_distinct(tokens(title)).alias("_title")] if title is not None else []))
    held = words.select(doc_key, F.size("_t").alias("len"), F.explode("_t").alias("token"), *(["_title"] if title is not None else []))
    in_title = F.array_contains("_title", F.col("token")) if title is not None else F.lit(False)
    held = held.select(doc_key, "len", "token", in_title.alias("in_title"))
    tf = held.join(vocabulary, "token").groupBy(doc_key, "token").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"), F.first("in_title").alias("in_title"))
    stats = length_stats(docs, doc_text)
    idf = document_frequencies(tf.select(doc_key, "token"), stats.select("n"))
    return _scored(asked, tf.join(idf, "token"), stats.select("avg_len"), query_key, doc_key, k, k1, b, title_bonus)


def _scored(asked: DataFrame, postings: DataFrame, avg_len: DataFrame, query_key: str, doc_key: str, k: int | None, k1: float, b: float, title_bonus: float) -> DataFrame:
    """Ranks by query tokens (token, m) over postings (token, idf, tf, len, in_title)."""
    # postings are spread by document before queries multiply them: scores add up where they are, without a
    # shuffle of all matches, and the fixed number keeps small postings from ending in one task
    n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = postings.crossJoin(F.broadcast(avg_len)).repartition(n, doc_key)  # one row of statistics
    found = postings.join(asked, "token")
    body = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    score = F.sum(F.col("m") * (body + F.when(F.col("in_title"), title_bonus * F.col("idf")).otherwise(0.0)))
    scored = found.groupBy(query_key, doc_key).agg(F.round(score, 6).alias("score")).where("score > 0")
    return ranked(scored, [query_key], [F.col("score").desc(), F.col(doc_key).desc()], k)


def build_index(docs: DataFrame, doc_key: str, text: str, path: str, title: Column | None = None, shards: int = 64) -> None:
    """Write an inverted index once: postings by token (sharded and sorted by it), and the collection's statistics.

    Searches read only the shards of their tokens, and Parquet's statistics skip within them.
    Null and empty texts count as documents without tokens; rows that repeat a key are one
    document of all their tokens; an empty table gives an empty index.
    """
    scan = spread(docs)
    words = scan.select(F.col(doc_key).alias("doc"), tokens(text).alias("_t"), (F.array_distinct(tokens(title)) if title is not None else F.array().cast("array<string>")).alias("_title"))
    held = words.select("doc", F.size("_t").alias("len"), "_title", F.explode("_t").alias("token"))
    held = held.select("doc", "len", "token", F.array_contains("_title", F.col("token")).alias("in_title"))
    tf = held.groupBy("doc", "token").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"), F.first("in_title").alias("in_title"))
    shard = F.pmod(F.xxhash64("token"), F.lit(shards)).cast("int")
    tf.withColumn("shard", shard).repartition("shard", F.pmod(F.xxhash64("token"), F.lit(shards * 16))).sortWithinPartitions("shard", "token").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/postings")
    kept = docs.sparkSession.read.parquet(f"{path}/postings")
    # the texts are tokenised once: lengths are sums of what is stored
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    stats = kept.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("_all")).crossJoin(n).select("n", (F.col("_all") / F.greatest("n", F.lit(1))).alias("avg_len"))
    document_frequencies(kept.select("doc", "token"), stats.select("n")).withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard", "token").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/tokens")
    stats.withColumn("shards", F.lit(shards)).write.mode("overwrite").parquet(f"{path}/stats")


def search_index(spark, path: str, queries: DataFrame, query_key: str, text: str, k: int | None = None, k1: float = K1, b: float = B, title_bonus: float = TITLE_BONUS) -> DataFrame:
    """``query_key``, doc, score, rank from a stored index; ranks equal those of ``bm25``."""
    stats = spark.read.parquet(f"{path}/stats")
    shards = stats.first()["shards"]
    asked = queries.select(query_key, F.explode(tokens(text)).alias("token")).groupBy(query_key, "token").agg(F.count(F.lit(1)).alias("m"))
    asked = asked.withColumn("shard", F.pmod(F.xxhash64("token"), F.lit(shards)).cast("int"))
    idf = spark.read.parquet(f"{path}/tokens").join(asked.select("shard", "token").distinct(), ["shard", "token"], "left_semi").select("shard", "token", "idf")
    postings = spark.read.parquet(f"{path}/postings").join(idf, ["shard", "token"]).drop("shard")
    return _scored(asked.drop("shard"), postings, stats.select("avg_len"), query_key, "doc", k, k1, b, title_bonus)


def search_forward(index: DataFrame, vocabulary: list[str], queries: DataFrame, query_key: str, text: str, k: int, k1: float = K1, b: float = B, title_bonus: float = 0.0) -> DataFrame:
    """``query_key``, doc, score, rank from a forward index (``forward.forward``) of a vocabulary that holds all words of the queries; ranks equal those of ``bm25``."""
    asked = forward.asked_words(queries, query_key, text).collect()
    keys = sorted({r[query_key] for r in asked})
    number = {key: i for i, key in enumerate(keys)}
    names = queries.sparkSession.createDataFrame(list(enumerate(keys)), T.StructType([T.StructField("_q", T.IntegerType()), queries.schema[query_key]]))
    if not keys:
        return names.where("false").select(query_key, F.lit(None).cast(index.schema["doc"].dataType).alias("doc"), F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    found = forward.best(index, vocabulary, [(number[r[query_key]], r["token"], r["m"]) for r in asked], len(keys), k, k1, b, title_bonus)
    out = ranked(found.withColumnRenamed("q", "_q"), ["_q"], [F.col("score").desc(), F.col("doc").desc()], k)
    return out.join(F.broadcast(names), "_q").select(query_key, "doc", "score", "rank")


def ranked(rows: DataFrame, by: list[str], order: list[Column], k: int | None = None) -> DataFrame:
    """Adds rank from 1; with ``k``, only the first ``k`` of each group."""
    out = rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("int"))
    return out if k is None else out.where(F.col("rank") <= k)


def dense(queries: DataFrame, docs: DataFrame, query_key: str, doc_key: str, query_vector: str, doc_vector: str, k: int | None = None, cosine: bool = True) -> DataFrame:
    """``query_key``, ``doc_key``, score, rank by inner product (of unit vectors); ties to the larger key.

    A stated query set against all documents: documents stay where they are, queries are the
    side that travels, and with ``k`` each task keeps its best k before the shuffle.
    """
    q = queries.select(query_key, (unit_vector(query_vector) if cosine else F.col(query_vector)).alias("_q"))
    d = docs.select(doc_key, (unit_vector(doc_vector) if cosine else F.col(doc_vector)).alias("_d"))
    scored = d.crossJoin(q).select(query_key, doc_key, F.round(dot("_q", "_d"), 9).alias("score"))
    return ranked(scored, [query_key], [F.col("score").desc(), F.col(doc_key).desc()], k)


def fuse(rankings: list[DataFrame], query_key: str, doc_key: str, c: int = RRF_C, k: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of rankings (with rank from 1); ties to the first appearance."""
    every = None
    for i, r in enumerate(rankings):
        part = r.select(query_key, doc_key, "rank", F.lit(i).alias("_list"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy(query_key, doc_key).agg(F.round(F.sum(1.0 / (c + F.col("rank"))), 12).alias("score"), F.min(F.struct("_list", "rank")).alias("_first"))
    return ranked(fused, [query_key], [F.col("score").desc(), F.col("_first").asc()], k).drop("_first")


def compose(exact: DataFrame, ranking: DataFrame, query_key: str, doc_key: str, is_guidance: Column, k: int = 4, guidance_slots: int = GUIDANCE_SLOTS) -> DataFrame:
    """``query_key``, ``doc_key``, pool, slot: exact references, then documents, then a guidance appendix.

    ``exact`` (ord) and ``ranking`` (rank, and what ``is_guidance`` needs).  References
    and documents fill k slots together; at most ``guidance_slots`` guidance rows
    follow, or k if nothing else was found.
    """
    e = exact.select(query_key, doc_key, F.row_number().over(W.partitionBy(query_key).orderBy("ord")).alias("_n")).where(F.col("_n") <= k)
    counts = e.groupBy(query_key).agg(F.count(F.lit(1)).alias("_picked"))
    rest = ranking.withColumn("_guide", is_guidance).join(e.select(query_key, doc_key), [query_key, doc_key], "left_anti")
    rest = rest.join(counts, query_key, "left").withColumn("_picked", F.coalesce("_picked", F.lit(0)))
    rest = rest.withColumn("_n", F.row_number().over(W.partitionBy(query_key, "_guide").orderBy("rank")))
    any_doc = F.max(F.when(~F.col("_guide"), 1).otherwise(0)).over(W.partitionBy(query_key))
    rest = rest.withColumn("_none", (F.col("_picked") == 0) & (any_doc == 0))
    slots = F.when(~F.col("_guide"), k - F.col("_picked")).when(F.col("_none"), k).otherwise(guidance_slots)
    rest = rest.where(F.col("_n") <= slots)
    out = e.select(query_key, doc_key, F.lit(0).alias("pool"), "_n").unionByName(rest.select(query_key, doc_key, F.when(F.col("_guide"), 2).otherwise(1).alias("pool"), "_n"))
    return out.withColumn("slot", F.row_number().over(W.partitionBy(query_key).orderBy("pool", "_n")).cast("int")).drop("_n")


def rerank(candidates: DataFrame, scores: DataFrame, query_key: str, doc_key: str, depth: int = 50, k: int | None = None) -> DataFrame:
    """Reorder the first ``depth`` candidates by ``scores`` (query_key, doc_key, model_score); ties keep their rank."""
    cut = candidates.where(F.col("rank") <= depth).withColumnRenamed("rank", "first_rank")
    s = cut.join(scores.select(query_key, doc_key, "model_score"), [query_key, doc_key])
    return ranked(s, [query_key], [F.col("model_score").desc(), F.col("first_rank").asc()], k)


def cache_key(model: str, query: Column, passage: Column) -> Column:
    return F.sha1(F.concat_ws("\x00", F.lit(model), query, passage).cast("binary"))


def cached_scores(pairs: DataFrame, cache: DataFrame, score: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All pairs' scores by ``pair_key``, and the new ones to append: ``score`` sees only misses."""
    misses = pairs.join(cache.select("pair_key"), "pair_key", "left_anti").dropDuplicates(["pair_key"])
    new = score(misses).select("pair_key", "model_score")
    hits = pairs.join(cache, "pair_key").select("pair_key", "model_score").distinct()
    return hits.unionByName(new), new


def pair_scorer(fn: Callable[[list[str], list[str]], list[float]], query: str, passage: str, batch: int = 16) -> Callable[[DataFrame], DataFrame]:
    """A batched model hook (texts, texts) -> scores as a step for ``cached_scores``."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, p in batches:
            out: list[float] = []
            for a in range(0, len(q), batch):
                out += [float(x) for x in fn(q.iloc[a : a + batch].tolist(), p.iloc[a : a + batch].tolist())]
            yield pd.Series(out, dtype="float64")

    return lambda df: df.withColumn("model_score", run(F.col(query), F.col(passage)))


def embed(df: DataFrame, text: str, fn: Callable[[list[str]], list[list[float]]], prefix: str = "", batch: int = 64, into: str = "embedding") -> DataFrame:
    """A batched model hook texts -> vectors; ``prefix`` marks queries or passages."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out: list = []
            for a in range(0, len(s), batch):
                out += [list(map(float, v)) for v in fn([prefix + (x or "") for x in s.iloc[a : a + batch]])]
            yield pd.Series(out)

    return df.withColumn(into, run(F.col(text)))


def generate(df: DataFrame, prompt: str, fn: Callable[[list[str]], list[str]], batch: int = 8, into: str = "response") -> DataFrame:
    """A batched model hook prompts -> answers.  A batch that runs out of memory is halved; a single failure gives ""."""

    def safe(xs: list[str]) -> list[str]:
        try:
            return list(fn(xs))
        except MemoryError:
            if len(xs) == 1:
                return [""]
            return safe(xs[: len(xs) // 2]) + safe(xs[len(xs) // 2 :])

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out: list[str] = []
            for a in range(0, len(s), batch):
                out += safe(s.iloc[a : a + batch].tolist())
            yield pd.Series(out, dtype="object")

    return df.withColumn(into, run(F.col(prompt)))
