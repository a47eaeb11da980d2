"""Gates and deduplication of training records."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import DEVANAGARI, similarity_normal, split_words, word_count
from .setjoin import similar

JACCARD_FLOOR = 0.35


def reasons(checks: list[tuple[str, Column]], early: list[tuple[str, Column]] | None = None) -> Column:
    """Names of all failed checks, in order; an ``early`` failure alone if there is one.

    Each check is (reason, condition that fails).
    """
    late = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks]))
    out = late
    for name, bad in reversed(early or []):
        out = F.when(F.coalesce(bad, F.lit(True)), F.array(F.lit(name))).otherwise(out)
    return out


def validation(roles: Column, contents: Column, question: Column, answer: Column, language: Column, task_type: Column, sections: Column, cited_ok: Column, leaked: Column, least: dict[str, int], min_words: int = 80, max_words: int = 600, grounded: tuple[str, ...] = ("grounded_qa",)) -> Column:
    """The gate of a record: schema first, then all other failures."""
    n = word_count(answer)
    low = F.lit(min_words)
    for name, m in least.items():
        low = F.when(task_type == name, F.lit(m)).otherwise(low)
    schema = (F.slice(roles, 1, 3) != F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))) | F.exists(F.slice(contents, 1, 3), lambda c: F.coalesce(F.trim(c), F.lit("")) == "")
    return reasons(
        [
            ("source_sections", task_type.isin(*grounded) & (F.size(sections) <= 0)),
            ("citation", ~cited_ok),
            ("language", F.when(language == "hindi", ~answer.rlike(DEVANAGARI)).when(language == "hinglish", question.rlike(DEVANAGARI)).otherwise(False)),
            ("length", (n < low) | (n > max_words)),
            ("leakage", leaked),
        ],
        [("schema", schema)],
    )


def prefix_counts(rows: DataFrame, reasons_col: str, mark: str = ":") -> DataFrame:
    """reason (its part before the mark), n."""
    flat = rows.select(F.explode(reasons_col).alias("reason")).select(F.substring_index("reason", mark, 1).alias("reason"))
    return flat.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def token_sets(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, words (distinct), and normal: the normalised text."""
    normal = similarity_normal(F.coalesce(F.col(text), F.lit("")))
    return rows.select(key, normal.alias("normal")).withColumn("words", F.array_distinct(split_words("normal")))


def jaccard_pairs(left: DataFrame, right: DataFrame | None, key: str, threshold: float = JACCARD_FLOOR) -> DataFrame:
    """a, b, jaccard for token sets (key, words) of at least ``threshold``; a > b within one table.

    Blocks of sets meet in ``setjoin.similar``, which counts shared words exactly.

    Sets without words meet none; a key is one row's; repeated sets are sets of their own.
    """
    pairs = similar(left, right, key, threshold)
    if right is None:
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "shared", "both").where("a > b")
    return pairs.withColumn("jaccard", F.col("shared") / (F.col("both") - F.col("shared"))).where(F.col("jaccard") >= threshold).select("a", "b", "jaccard")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """difflib's ratio of (first, second); not symmetric, with its default heuristics."""
    for a, b in batches:
        yield pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def near_pairs(left: DataFrame, right: DataFrame | None, key: str, text: str, threshold: float = 0.92) -> DataFrame:
    """a, b of near duplicates: equal normalised texts, or similar words and a sequence ratio above ``threshold``.

    ``a`` is the later row.  Equal texts are joined by their digest to the first of them alone within one table.
    """
    x = token_sets(left, key, text)
    y = None if right is None else token_sets(right, key, text)
    second = x if y is None else y
    # rows of equal text meet through their first one, so that a big group costs one row each
    heads = second.groupBy(F.sha2("normal", 256).alias("_h")).agg(F.min(key).alias("b"))
    same = x.select(F.col(key).alias("a"), F.sha2("normal", 256).alias("_h")).join(heads, "_h")
    same = same.where("a > b") if right is None else same
    firsts = x if right is not None else x.join(heads.select(F.col("b").alias(key)), key, "left_semi")
    pairs = jaccard_pairs(firsts.where(F.size("words") > 0).select(key, "words"), None if y is None else y.where(F.size("words") > 0).select(key, "words"), key)
    t = pairs.join(x.select(F.col(key).alias("a"), F.col("normal").alias("_x")), "a").join(second.select(F.col(key).alias("b"), F.col("normal").alias("_y")), "b")
    # the ratio can't exceed twice the shorter length over the sum of both
    la, lb = F.length("_x"), F.length("_y")
    t = t.where((F.col("_x") != F.col("_y")) & (2 * F.least(la, lb) > threshold * (la + lb)))
    t = t.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")  # the ratio is what costs
    near = t.withColumn("_r", sequence_ratio("_x", "_y")).where(F.col("_r") > threshold)
    return near.select("a", "b").unionByName(same.select("a", "b")).distinct()


def greedy_keep(rows: DataFrame, pairs: DataFrame, key: str, write) -> DataFrame:
    """Rows that stay if each row, in key order, is dropped just when a kept earlier row is its pair.

    Rounds: rows without an undecided earlier partner stay, and their later partners go.  ``write``
    (DataFrame -> DataFrame) saves a round's table, which cuts lineage.
    """
    edges = write(pairs.select("a", "b"))  # a later than b
    gone = None
    while True:
        later, earlier = edges.select(F.col("a").alias("v")).distinct(), edges.select(F.col("b").alias("v")).distinct()
        sure = earlier.join(later, "v", "left_anti")  # no earlier partner is undecided: they stay
        new = edges.join(sure.withColumnRenamed("v", "b"), "b", "left_semi").select(F.col("a").alias("v")).distinct()
        new = write(new)
        gone = new if gone is None else gone.unionByName(new)
        lost = new.select("v")
        # a dropped row drops nothing, and pairs with a row that surely stays are settled
        edges = write(edges.join(lost.withColumnRenamed("v", "a"), "a", "left_anti").join(lost.withColumnRenamed("v", "b"), "b", "left_anti"))
        if not edges.limit(1).count():
            break
    return rows.join(gone.select(F.col("v").alias(key)).distinct(), key, "left_anti")


def exact_first(rows: DataFrame, text: str, order: str) -> DataFrame:
    """The first row of every distinct text."""
    h = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    first = rows.groupBy(h.alias("_h")).agg(F.min(order).alias(order))
    return rows.join(first.select(order), order, "left_semi")


def bounded_history_dedup(rows: DataFrame, order: str, text: str, same, history: int = 200) -> DataFrame:
    """Sequential dedup against the last ``history`` kept rows of each group ``g``; ``same(a, b)`` decides."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[str] = []
        stay = []
        for t in pdf.sort_values(order)[text]:
            ok = not any(same(t, k) for k in kept[-history:])
            stay.append(ok)
            if ok:
                kept.append(t)
        return pdf.sort_values(order)[stay]

    return rows.groupBy("g").applyInPandas(run, rows.schema)


def assert_share(rows: DataFrame, bad: Column, most: float, what: str) -> DataFrame:
    """``rows``, whose reading fails if more than ``most`` of them are bad."""
    share = rows.agg(F.avg(F.when(bad, 1.0).otherwise(0.0)).alias("_share"))
    ok = F.assert_true(F.coalesce(F.col("_share"), F.lit(0.0)) <= most, F.lit(f"too many: {what}"))
    return rows.crossJoin(F.broadcast(share.select(ok.alias("_ok")))).where("_ok is null").drop("_ok")
