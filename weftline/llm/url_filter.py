"""URL filters: explicit rules, and a tree of path templates for the rest.

A url's host is what lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end,
A-Z lower-cased; its path runs on to ``?``, ``#`` or the end.  A rule ``host/path``
fits its host and all subdomains if the path starts with ``/path``; the longest wins.

Per host, paths form a tree of segments.  Level by level, a segment that looks
variable (digits, hex, very long) becomes a class token; a literal becomes ``*`` if
too few pages have it, or if its share of blocked labels doesn't differ from that
of its siblings by ``z`` standard errors: similar branches merge.  Branches without
labels can't be tested: they merge among themselves as ``*``, and the labelled ones
beside them that merge are ``?``.  Labels are the rules' own verdicts.  A template is
blocked if its purity, the share of blocked labels smoothed towards its host's and
that towards the overall share, reaches ``cut``.

Defined cases: a null url, or one without ``://``, has empty host and path; pages
without any label near them get the overall share, so ``allow`` unless most labels
block; rows that repeat repeat their verdict; an empty table gives an empty result.

Scale: pages are aggregated to (host, path classes) before the tree is grown, so
each level works on distinct shapes.  A shape alone in its node has no siblings to be
tested against, so all its further segments are named at once: there are as many levels
as shapes of one host share templates, not as the longest path has segments.  Lookups by a hot host or path go through
``salted_lookup``.  Rules are a list of at most ``MOST_RULES``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_lookup, saved

MOST_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def host_of(url: str | Column) -> Column:
    u = F.col(url) if isinstance(url, str) else url
    return F.translate(F.coalesce(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str | Column) -> Column:
    u = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; nulls if none fits."""
    if len(rules) > MOST_RULES:
        raise ValueError("too many rules for one expression")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(action)).otherwise(verdict)
    return name, verdict


def _segment(s: Column) -> Column:
    """A class token for what looks variable, else the segment itself."""
    ext = F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1)
    stem = F.regexp_replace(s, r"\.[A-Za-z]{1,5}$", "")
    return (
        F.when(stem.rlike(r"^[0-9]+$"), F.concat(F.lit("<n>"), ext))
        .when(stem.rlike(r"^[0-9]{1,4}[-_.][0-9]{1,2}([-_.][0-9]{1,4})?$"), F.concat(F.lit("<date>"), ext))
        .when(stem.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), F.concat(F.lit("<hex>"), ext))
        .when(F.length(s) > 48, F.concat(F.lit("<long>"), ext))
        .otherwise(s)
    )


def shape_of(path: Column) -> Column:
    """The path's non-empty segments, each generalised alone, joined by ``/``."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.array_join(F.transform(parts, _segment), "/")


def _token(segment: Column) -> Column:
    return segment.rlike(r"^<\w+>")


def template_tree(shapes: DataFrame, min_pages: int = 5, z: float = 2.58, weight: float = 4.0) -> DataFrame:
    """host, shape, n, template, purity for ``shapes`` (host, shape, n, labelled, blocked), unique by host and shape."""
    rows = shapes.withColumn("_parts", F.filter(F.split("shape", "/"), lambda x: x != "")).withColumn("template", F.lit(""))
    rows = saved(rows, "shapes")
    total = rows.count()
    sums = [F.sum(c).alias(f"_{c}") for c in ("n", "labelled", "blocked")]
    level = 0
    while (rows.agg(F.max(F.size("_parts"))).first()[0] or 0) > level:
        rows = rows.withColumn("_seg", F.get("_parts", F.lit(level)))
        inner = rows.where("_seg is not null")
        child = inner.groupBy("host", "template", "_seg").agg(*sums, F.count(F.lit(1)).alias("_rows"))
        token = _token(F.col("_seg"))
        unknown = F.max(~token & (F.col("_labelled") == 0)).alias("_unknown")
        node = child.groupBy("host", "template").agg(*[F.sum(f"_{c}").alias(f"_all_{c}") for c in ("labelled", "blocked", "rows")], unknown)
        child = child.join(node, ["host", "template"])
        rest, rest_blocked = F.col("_all_labelled") - F.col("_labelled"), F.col("_all_blocked") - F.col("_blocked")
        pooled = (F.col("_all_blocked") + 0.5) / (F.col("_all_labelled") + 1)
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("_labelled") + 1 / rest))
        apart = (F.col("_labelled") > 0) & (rest > 0) & (F.abs(F.col("_blocked") / F.col("_labelled") - rest_blocked / rest) >= z * error)
        merged = F.when((F.col("_labelled") > 0) & F.col("_unknown"), "?").otherwise("*")  # no segment holds a "?"
        name = F.when(token, F.col("_seg")).when((F.col("_n") >= min_pages) & apart, F.col("_seg")).otherwise(merged)
        child = child.select("host", "template", "_seg", "_rows", name.alias("_name"), (F.col("_all_rows") == 1).alias("_alone"))
        done = rows.where("_seg is null").drop("_seg")
        moved = salted_lookup(inner, child, ["host", "template", "_seg"], "_rows", total)
        tail = F.array_join(F.transform(F.slice("_parts", level + 1, F.size("_parts")), lambda x: F.when(_token(x), x).otherwise("*")), "/")
        moved = moved.withColumn("template", F.concat("template", F.lit("/"), F.when(F.col("_alone"), tail).otherwise(F.col("_name"))))
        moved = moved.withColumn("_parts", F.when(F.col("_alone"), F.slice("_parts", 1, level + 1)).otherwise(F.col("_parts")))
        rows = saved(done.unionByName(moved.drop("_seg", "_name", "_alone")), f"level-{level}")
        level += 1
    leaf = rows.groupBy("host", "template").agg(*sums, F.count(F.lit(1)).alias("_rows"))
    host = leaf.groupBy("host").agg(F.sum("_labelled").alias("_hl"), F.sum("_blocked").alias("_hb"))
    whole = host.agg((F.coalesce(F.sum("_hb"), F.lit(0)) / F.greatest(F.coalesce(F.sum("_hl"), F.lit(0)), F.lit(1))).alias("p")).first()[0] or 0.0
    own = (F.col("_hb") + weight * whole) / (F.col("_hl") + weight)
    leaf = leaf.join(host, "host").select("host", "template", "_rows", ((F.col("_blocked") + weight * own) / (F.col("_labelled") + weight)).alias("purity"))
    return salted_lookup(rows.select("host", "shape", "n", "template"), leaf, ["host", "template"], "_rows", total)


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, cut: float = 0.5, **options) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity: one row per row of ``pages``."""
    host, path = host_of("url"), path_of("url")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("_ruled", verdict).withColumn("shape", shape_of(F.col("path")))
    rows = saved(rows, "pages")
    shapes = rows.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("_ruled").alias("labelled"), F.count(F.when(F.col("_ruled") == "block", 1)).alias("blocked"))
    tree = template_tree(shapes, **options)
    out = salted_lookup(rows, tree, ["host", "shape"], "n", rows.count())
    by_tree = F.when(F.col("purity") >= cut, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("_ruled", by_tree).alias("verdict"), "template", "purity")
