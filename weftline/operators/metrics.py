"""Evaluation metrics: buckets, errors, recall, order statistics, paired comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_dimensions(rows: DataFrame, dims: list[str], aggs: list[Column], total: bool = True) -> DataFrame:
    """dim, value and the aggregates: one grouping-sets pass for all dimensions, and the whole if ``total``."""
    sets = [[d] for d in dims] + ([[]] if total else [])
    out = rows.groupingSets([[F.col(d) for d in s] for s in sets], *[F.col(d) for d in dims]).agg(F.grouping_id().alias("_g"), *aggs)
    name, value = F.lit("all"), F.lit("all")
    for i, d in enumerate(dims):
        on = F.col("_g").bitwiseAND(1 << (len(dims) - 1 - i)) == 0
        name, value = F.when(on, F.lit(d)).otherwise(name), F.when(on, F.col(d).cast("string")).otherwise(value)
    return out.withColumn("dim", name).withColumn("value", value).drop("_g", *dims)


def rate(good: Column, digits: int = 4) -> Column:
    """Rounded share of rows; 0 of none."""
    return F.round(F.coalesce(F.avg(F.when(good, 1.0).otherwise(0.0)), F.lit(0.0)), digits)


def mean(x: str | Column, digits: int = 4) -> Column:
    """Rounded mean of what isn't null; 0 of nothing."""
    return F.round(F.coalesce(F.avg(x), F.lit(0.0)), digits)


def strict_metrics(judged: DataFrame, dims: list[str]) -> DataFrame:
    """Totals and strict accuracy; safety rows count in buckets but not in accuracy overall."""
    scored = ~F.col("is_safety_row")
    aggs = [
        F.count(F.lit(1)).alias("total"), F.count(F.when(scored, 1)).alias("scored_total"),
        F.count(F.when(F.col("auto_strict_correct"), 1)).alias("auto_strict_correct"),
        F.round(F.coalesce(F.count(F.when(F.col("auto_strict_correct") & scored, 1)) / F.nullif(F.count(F.when(scored, 1)), F.lit(0)), F.lit(0.0)), 4).alias("auto_strict_accuracy"),
        F.count(F.when(F.size("forbidden_facts_violated") > 0, 1)).alias("forbidden_violations"), rate(F.col("abstained")).alias("abstention_rate"),
    ]
    return by_dimensions(judged, dims, aggs)


def graded_metrics(scored: DataFrame, dims: list[str]) -> DataFrame:
    """Means over rows that aren't safety rows; recalls over those that have facts of the kind."""
    aggs = [
        F.count(F.lit(1)).alias("n"), mean("fact_recall").alias("fact_recall"), mean("citation_recall").alias("citation_accuracy"),
        F.count("citation_recall").alias("citation_rows"), mean("substance_recall").alias("substance_recall"),
        rate(F.col("all_facts")).alias("all_facts"), rate(F.size("forbidden_violated") > 0).alias("forbidden_violation_rate"),
    ]
    return by_dimensions(scored.where(~F.col("is_safety_row")), dims, aggs)


def error_modes(judged: DataFrame) -> DataFrame:
    """mode, n: a failure may have several modes."""
    missing, cited = F.size("required_facts_missing") > 0, F.size("extracted_citations") > 0
    modes = F.array_compact(F.array(
        F.when(F.size("forbidden_facts_violated") > 0, F.lit("stale_cited")),
        F.when(F.col("abstained") & missing, F.lit("over_abstention")),
        F.when(missing & cited, F.lit("wrong_or_incomplete_citation")),
        F.when(missing & ~cited, F.lit("no_citation")),
    ))
    failed = judged.where(~F.col("is_safety_row") & ~F.col("auto_strict_correct"))
    return failed.select(F.explode(modes).alias("mode")).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


def top_items(rows: DataFrame, items: str, order: str, k: int = 25) -> DataFrame:
    """item, n of the most common items of an array column; ties by first appearance."""
    flat = rows.select(F.col(order).alias("_o"), F.posexplode(items).alias("_i", "item"))
    n = flat.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_o", "_i")).alias("_first"))
    return n.orderBy(F.col("n").desc(), "_first", "item").limit(k).select("item", "n")


def recall_at(hits: DataFrame, key: str, gold: str, found: str, ks: tuple[int, ...], dims: list[str]) -> DataFrame:
    """dim, value, k, n, any_hit, full_hit of the gold keys among the first k found; rows without gold are left out."""
    rows = hits.where(F.size(gold) > 0).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    head = F.slice(F.col(found), F.lit(1), F.col("k"))
    rows = rows.withColumn("_any", F.arrays_overlap(F.col(gold), head)).withColumn("_full", F.size(F.array_except(F.col(gold), head)) == 0)
    aggs = [F.count(F.lit(1)).alias("n"), rate(F.coalesce("_any", F.lit(False))).alias("any_hit"), rate(F.col("_full")).alias("full_hit")]
    dims = [*dims, "k"]
    out = rows.groupingSets([[F.col(d), F.col("k")] for d in dims[:-1]] + [[F.col("k")]], *[F.col(d) for d in dims]).agg(F.grouping_id().alias("_g"), *aggs)
    name, value = F.lit("all"), F.lit("all")
    for i, d in enumerate(dims[:-1]):
        on = F.col("_g").bitwiseAND(1 << (len(dims) - 1 - i)) == 0
        name, value = F.when(on, F.lit(d)).otherwise(name), F.when(on, F.col(d).cast("string")).otherwise(value)
    return out.select(name.alias("dim"), value.alias("value"), "k", "n", "any_hit", "full_hit")


def retrieval_bucket(gold: str, context: str) -> Column:
    """no_gold, gold_in_context or gold_missing."""
    return F.when(F.size(gold) <= 0, "no_gold").when(F.size(F.array_except(F.col(gold), F.col(context))) == 0, "gold_in_context").otherwise("gold_missing")


def order_statistics(rows: DataFrame, group: str | None, x: str, points: dict[str, float]) -> DataFrame:
    """The element floor(share * n) of the sorted values (counted from 0), for each name; exact.

    Values are counted first, so that the sort is over distinct ones.
    """
    keys = [group] if group else []
    n = rows.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_c"))
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    n = n.withColumn("_to", F.sum("_c").over(part.orderBy(x).rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum("_c").over(part))
    picks = []
    for name, share in points.items():
        at = F.least(F.floor(F.col("_all") * share), F.col("_all") - 1)
        picks.append(F.max(F.when((F.col("_to") > at) & (F.col("_to") - F.col("_c") <= at), F.col(x))).alias(name))
    return n.groupBy(*keys).agg(F.max("_all").alias("n"), *picks)


#: Draws that one row of a bootstrap expands to.
DRAWS = 1024


def bootstrap_ci(diffs: DataFrame, key: str, diff: str, rounds: int = 10_000, low: float = 0.025, high: float = 0.975, seed: str = "") -> DataFrame:
    """n, mean, lo, hi: percentile interval of the mean by resampling.

    Draw j of round r takes the row whose number is a hash of (seed, r, j) modulo n, so
    every engine can repeat it.  Rows are numbered once, and the draws are counted
    per (round, row) before they meet the values.
    """
    spark = diffs.sparkSession
    rows = diffs.select(diff, (F.row_number().over(W.orderBy(key)) - 1).cast("long").alias("_i"))
    n = rows.count()
    per = -(-n // DRAWS)  # tasks' rows hold at most DRAWS draws of a round
    draws = spark.range(rounds * per).select(F.expr(f"id div {max(per, 1)}").alias("_r"), (F.col("id") % max(per, 1) * DRAWS).alias("_from"), F.lit(n).cast("long").alias("_n"))
    draws = draws.select("_r", "_n", F.explode(F.sequence("_from", F.least(F.col("_from") + DRAWS, "_n") - 1)).alias("_j"))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("_r").cast("string"), F.col("_j").cast("string")).cast("binary")), 1, 12), 16, 10).cast("long") % F.col("_n")
    means = draws.select("_r", pick.alias("_i")).join(rows, "_i").groupBy("_r").agg(F.round(F.avg(diff), 9).alias("_m"))
    place = F.row_number().over(W.orderBy("_m", "_r")) - 1
    ends = means.withColumn("_p", place).agg(F.max(F.when(F.col("_p") == int(rounds * low), F.col("_m"))).alias("lo"), F.max(F.when(F.col("_p") == min(int(rounds * high), rounds - 1), F.col("_m"))).alias("hi"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(diff), 6).alias("mean")).crossJoin(ends)


def paired(a: DataFrame, b: DataFrame, key: str, metric: str) -> DataFrame:
    """``key``, a, b, diff of rows that both runs have, nulls dropped."""
    x, y = a.select(key, F.col(metric).alias("a")), b.select(key, F.col(metric).alias("b"))
    return x.join(y, key).where("a is not null and b is not null").withColumn("diff", F.col("b") - F.col("a"))


def paired_summary(pairs: DataFrame) -> DataFrame:
    """n, mean_a, mean_b, delta, better, worse, tied."""
    count = lambda c: F.count(F.when(c, 1))
    d = F.col("diff")
    return pairs.agg(F.count(F.lit(1)).alias("n"), mean("a", 6).alias("mean_a"), mean("b", 6).alias("mean_b"), mean("diff", 6).alias("delta"), count(d > 0).alias("better"), count(d < 0).alias("worse"), count(d == 0).alias("tied"))


def proportion_gap(n1: Column, p1: Column, n2: Column, p2: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """Difference of two shares with its normal interval."""
    se = F.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)
    return p2 - p1, p2 - p1 - z * se, p2 - p1 + z * se


def generalisation(before: DataFrame, after: DataFrame, key: str, group: str, flag: str, least: float = 0.03) -> DataFrame:
    """grp, n, before, after, delta, generalises: hit rates of one flag in two measurements, per group and over all."""
    both = before.select(key, group, F.col(flag).alias("_x")).join(after.select(key, F.col(flag).alias("_y")), key)
    out = by_dimensions(both, [group], [F.count(F.lit(1)).alias("n"), rate(F.col("_x")).alias("before"), rate(F.col("_y")).alias("after")])
    delta = F.round(F.col("after") - F.col("before"), 4)
    return out.select(F.when(F.col("dim") == "all", "overall").otherwise(F.col("value")).alias("grp"), "n", "before", "after", delta.alias("delta"), (delta >= least).alias("generalises"))


def mean_nll(rows: DataFrame, nll: str, n_tokens: str) -> DataFrame:
    """loss, perplexity, tokens: the token-weighted mean."""
    loss = F.sum(nll) / F.sum(n_tokens)
    return rows.agg(F.round(loss, 4).alias("loss"), F.round(F.exp(loss), 4).alias("perplexity"), F.sum(n_tokens).alias("tokens"))


def preference_loss(pc: Column, rc: Column, pr: Column, rr: Column, beta: float = 0.1) -> tuple[Column, Column]:
    """(margin, loss) of policy and reference log probabilities: chosen pc, rc; rejected pr, rr.  Stable for any margin."""
    m = beta * ((pc - rc) - (pr - rr))
    return m, F.greatest(-m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m)))


def sequence_logprob(token_logprobs: str | Column, completion: str | Column) -> Column:
    """Sum of log probabilities over the positions that the mask array marks."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (token_logprobs, completion))
    return F.aggregate(F.zip_with(a, b, lambda x, m: F.when(m, x).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)


def best_run(rows: DataFrame, name: str, score: str, penalty: str, order: str) -> DataFrame:
    """The run of the highest score, then the fewest violations, then the earliest."""
    return rows.orderBy(F.col(score).desc(), F.col(penalty).asc(), F.col(order).asc()).limit(1).select(name, score, penalty)
