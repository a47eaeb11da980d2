"""Splits, caps and samples that depend on keys and not on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import hash_order


def hash_rank(rows: DataFrame, key: str, into: str, seed: str = "") -> DataFrame:
    """Place of each row, from 1, in the seeded order of a key: no task orders all rows.

    Buckets are the first four digits of the hash; their counts add up to what precedes a
    bucket, and each bucket is ordered alone.
    """
    r = rows.withColumn("_h", hash_order(key, seed=seed)).withColumn("_b", F.substring("_h", 1, 4))
    per = r.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))  # 65536 rows at most
    base = per.select("_b", F.coalesce(F.sum("_c").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inner = F.row_number().over(W.partitionBy("_b").orderBy("_h", key))
    return r.withColumn(into, inner).join(base, "_b").withColumn(into, F.col(into) + F.col("_base")).drop("_h", "_b", "_base")


def grouped_split(rows: DataFrame, group: Column, test: float = 0.1, val: float = 0.1, holdout: Column | None = None, seed: str = "") -> DataFrame:
    """Adds split: whole groups go to test, then validation, by a seeded order; held-out groups to test.

    Sizes are rounded half to even.  Only the distinct groups are ordered.
    """
    r = rows.withColumn("_g", group)
    held = F.max(holdout if holdout is not None else F.lit(False)).alias("_held")
    groups = r.groupBy("_g").agg(held)
    free = groups.where("not _held")
    total = free.agg(F.count(F.lit(1)).alias("_all"))
    free = hash_rank(free, "_g", "_n", seed).crossJoin(F.broadcast(total))  # one row
    free = free.withColumn("_t", F.bround(F.col("_all") * test).cast("long")).withColumn("_v", F.bround(F.col("_all") * val).cast("long"))
    name = F.when(F.col("_n") <= F.col("_t"), "test").when(F.col("_n") <= F.col("_t") + F.col("_v"), "val").otherwise("train")
    named = free.select("_g", name.alias("split")).unionByName(groups.where("_held").select("_g", F.lit("test").alias("split")))
    return r.join(named, "_g").drop("_g")


def straddling(rows: DataFrame, item: str, split: str = "split") -> DataFrame:
    """Items that more than one split holds, with their number of splits."""
    return rows.groupBy(item).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def stratified_split(rows: DataFrame, strata: list[str], key: str, share: float = 0.6, names: tuple[str, str] = ("public", "private"), seed: str = "") -> DataFrame:
    """Adds visibility: the first round(share * n) of each stratum by a seeded order."""
    w = W.partitionBy(*strata)
    n = F.row_number().over(w.orderBy(hash_order(key, seed=seed), key))
    return rows.withColumn("visibility", F.when(n <= F.bround(F.count(F.lit(1)).over(w) * share), names[0]).otherwise(names[1]))


def cap_per_group(rows: DataFrame, group: str, order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each group; Spark prunes before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")


def cap_before(rows: DataFrame, group: str, order: list[Column], size: str, cap: int) -> DataFrame:
    """Rows whose group had emitted fewer than ``cap`` before them: the last one may overshoot."""
    before = F.coalesce(F.sum(size).over(W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_b", before).where(F.col("_b") < cap).drop("_b")


def byte_cap(listing: DataFrame, order: str, size: str, cap: int, done: DataFrame | None = None, buckets: int = 64) -> DataFrame:
    """Entries up to the first that would pass the cap; those in ``done`` count but aren't returned.

    ``order`` is a number.  The running sum goes over equal ranges of it and then
    within a range, so no task orders all entries.
    """
    ends = listing.agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    ranged = listing.crossJoin(F.broadcast(ends))
    place = F.floor((F.col(order) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * buckets)
    ranged = ranged.withColumn("_p", place).drop("_lo", "_hi")
    per = ranged.groupBy("_p").agg(F.sum(size).alias("_s"))
    base = per.select("_p", F.coalesce(F.sum("_s").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    run = F.sum(size).over(W.partitionBy("_p").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    kept = ranged.withColumn("_run", run).join(F.broadcast(base), "_p")  # ``buckets`` rows
    kept = kept.where(F.col("_base") + F.col("_run") <= cap).drop("_p", "_run", "_base")
    return kept if done is None else kept.join(done, order, "left_anti")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: str = "") -> DataFrame:
    """``n`` rows by a seeded order."""
    return rows.orderBy(hash_order(key, seed=seed), key).limit(n)


def matches_any(key: str | Column, prefixes: tuple[str, ...], contains: tuple[str, ...] = ()) -> Column:
    """Begins with one of the prefixes and, if any are given, contains one of the parts."""
    c = F.col(key) if isinstance(key, str) else key
    out = F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(c, p))
    return out & F.exists(F.array(*[F.lit(p) for p in contains]), lambda p: F.contains(c, p)) if contains else out
