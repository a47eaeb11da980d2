"""Citations of numbered provisions: extraction, spans, resolution, verification.

``Aliases`` names the families of acts and their surface forms; it is an input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_WORD = r"[\p{L}\p{N}_]"
_MARKER = r"sec(?:tions?|\.)?|art(?:icles?|\.)?|dhara|अनुच्छेद|धारा"
#: Java form; a number must end at a word border, sub-numbers in parentheses follow.
CITATION = rf"(?i)((?:(?<!{_WORD})(?:{_MARKER})\s+|§\s*)[0-9]+[a-zA-Z]{{0,2}}(?!{_WORD})(?:\({_WORD}+\))*)"
_PY_CITATION = re.compile(rf"(?:(?<!\w)(?:{_MARKER})\s+|§\s*)\d+[a-zA-Z]{{0,2}}(?!\w)(?:[(]\w+[)])*", re.I)
#: A section-like number anywhere in a fact, glued or not.
FACT_NUMBER = rf"(?i)(?:art(?:icle|\.)?|sec(?:tion|\.)?|dhara|अनुच्छेद|धारा|§)\s*([0-9]+[a-zA-Z]{{0,2}}(?:\({_WORD}+\))*)"


@dataclass(frozen=True)
class Aliases:
    """``families``: family to its lower-case names; ``acts``: family to act id; ``successors``: repealed family to family."""

    families: dict[str, tuple[str, ...]]
    acts: dict[str, str] = field(default_factory=dict)
    successors: dict[str, str] = field(default_factory=dict)


#: A small demonstration set.
DEMO = Aliases(
    {"alpha": ("alpha", "alpha act"), "beta": ("beta", "beta code"), "old": ("old", "old code"), "charter": ("charter",)},
    {"alpha": "alpha_2023", "beta": "beta_2019", "charter": "charter_1950"},
    {"old": "alpha"},
)


def extract(text: str | Column) -> Column:
    """All citations in a text, in order."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CITATION), F.lit(1))


def number(citation: str | Column) -> Column:
    """The section number, upper-case, without sub-numbers."""
    c = F.col(citation) if isinstance(citation, str) else citation
    return F.upper(F.regexp_extract(c, r"([0-9]+[a-zA-Z]{0,2})", 1))


def is_citation_fact(fact: str | Column) -> Column:
    c = F.col(fact) if isinstance(fact, str) else fact
    return c.rlike(FACT_NUMBER)


def alias_regex(name: str) -> str:
    """Java form, with word borders for ASCII names only; next to vowel signs they would never match."""
    return rf"(?<!{_WORD}){re.escape(name)}(?!{_WORD})" if name.isascii() else re.escape(name)


def _python_alias(name: str) -> str:
    return rf"(?<!\w){re.escape(name)}(?!\w)" if name.isascii() else re.escape(name)


def families_in(text: str | Column, aliases: Aliases = DEMO) -> Column:
    """The families that a text names, in the table's order."""
    c = F.lower(F.col(text) if isinstance(text, str) else text)
    hits = [F.when(_any([c.rlike(alias_regex(n)) for n in names]), F.lit(f)) for f, names in aliases.families.items()]
    return F.array_compact(F.array(*hits))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


SPANS = "array<struct<start: int, end: int, family: string, text: string>>"


def spans(text: Column, aliases: Aliases = DEMO) -> Column:
    """Spans of citations (family null) and of act names; an Arrow UDF, as the JVM has no all-positions regex."""
    compiled = [(f, n, re.compile(_python_alias(n))) for f, names in aliases.families.items() for n in names]

    @F.arrow_udf(SPANS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            at, rows = [0], []
            for t in column.to_pylist():
                t = t or ""
                low = t.lower()
                rows += [(m.start(), m.end(), None, m[0]) for m in _PY_CITATION.finditer(t)]
                rows += [(m.start(), m.end(), f, m[0]) for f, n, p in compiled if n in low for m in p.finditer(low)]
                at.append(len(rows))
            flat = list(zip(*rows, strict=True)) or [(), (), (), ()]
            types = (pa.int32(), pa.int32(), pa.string(), pa.string())
            struct = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(flat, types, strict=True)], names=["start", "end", "family", "text"])
            yield pa.ListArray.from_arrays(pa.array(at, pa.int32()), struct)

    return find(text)


def resolve(rows: DataFrame, key: str, text: str, whitelist: DataFrame, aliases: Aliases = DEMO, window: int = 140) -> DataFrame:
    """``key``, ord, citation, section, act, resolved: every citation and the act it belongs to.

    The act is the family whose name begins within ``window`` characters and is the
    nearest to the citation; without one, the only family that the whole text
    names.  ``whitelist`` (act, section) holds what exists.
    """
    s = rows.select(F.col(key), spans(F.col(text), aliases).alias("_s"))
    cited, named = F.filter("_s", lambda x: x["family"].isNull()), F.filter("_s", lambda x: x["family"].isNotNull())
    s = s.select(key, cited.alias("_c"), named.alias("_n"), F.array_distinct(F.transform(named, lambda x: x["family"])).alias("_f"))
    sole = F.when(F.size("_f") == 1, F.get("_f", F.lit(0)))

    def attributed(c: Column) -> Column:
        near = F.filter("_n", lambda a: (a["start"] >= c["start"] - window) & (a["start"] <= c["end"] + window))
        distance = lambda a: F.greatest(c["start"] - a["start"], a["start"] - c["end"], F.lit(0))
        best = F.array_min(F.transform(near, lambda a: F.struct(distance(a).alias("d"), a["start"].alias("p"), a["family"].alias("family"))))
        return F.struct(c["text"].alias("citation"), number(c["text"]).alias("section"), F.coalesce(best["family"], sole).alias("act"))

    # all of a text's spans meet within its row: the whitelist is the only join
    out = s.select(key, F.posexplode(F.transform("_c", attributed)).alias("ord", "r")).select(key, "ord", "r.*")
    known = whitelist.select("act", F.upper("section").alias("section"), F.lit(True).alias("resolved")).distinct()
    return out.join(known, ["act", "section"], "left").select(key, "ord", "citation", "section", "act", F.coalesce("resolved", F.lit(False)).alias("resolved"))


def verify(rows: DataFrame, key: str, text: str, whitelist: DataFrame, aliases: Aliases = DEMO, window: int = 140) -> DataFrame:
    """``key``, n_citations, verified: whether all citations resolve; true where there are none."""
    r = resolve(rows, key, text, whitelist, aliases, window).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("resolved").alias("ok"))
    return rows.select(key).join(r, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n_citations"), F.coalesce("ok", F.lit(True)).alias("verified"))


def whitelist(statutes: DataFrame, mappings: DataFrame | None = None, act_families: dict[str, str] | None = None, guidance: str = "guidance") -> DataFrame:
    """act, section of citable provisions; with ``mappings``, repealed ones too.  Guidance isn't citable."""
    names = {a.rsplit("_", 1)[0]: f for f, a in DEMO.acts.items()} if act_families is None else act_families
    family = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.regexp_replace("act_id", "_[^_]*$", ""))
    out = statutes.where(F.col("act_id") != guidance).select(family.alias("act"), F.upper("section").alias("section")).where("act is not null")
    if mappings is not None:
        out = out.unionByName(mappings.select(F.lower("old_act").alias("act"), F.upper("old_section").alias("section")))
    return out.distinct()


def within_context(text: str | Column, context_keys: str | Column) -> Column:
    """Whether every cited number is one of the context's (act:section keys)."""
    keys = F.col(context_keys) if isinstance(context_keys, str) else context_keys
    allowed = F.transform(keys, lambda k: F.upper(F.element_at(F.split(k, ":"), -1)))
    return F.forall(extract(text), lambda c: F.array_contains(allowed, number(c)))


def reference_keys(rows: DataFrame, key: str, text: str, statutes: DataFrame, mappings: DataFrame, aliases: Aliases = DEMO, idf: DataFrame | None = None, postings: DataFrame | None = None, domain: str | None = None, domain_acts: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``key``, ref, ord: index keys that a text refers to, in order of mention.

    Every cited number is tried against every family named anywhere in the text, and
    repealed families map on.  With no family named, articles try the charter family
    and others try all; a number that several acts have is then narrowed to the
    domain's acts, then to the one whose content the text describes (idf overlap), else dropped.
    """
    from .text import tokens

    carried = ["_t"] if idf is not None and postings is not None else []  # texts travel only where their words decide
    base = rows.select(key, F.col(text).alias("_t"), (F.col(domain) if domain else F.lit(None).cast("string")).alias("_domain"))
    base = base.withColumn("_families", families_in("_t", aliases)).withColumn("_named", F.size("_families") > 0)
    cites = base.select("*", F.posexplode(extract("_t")).alias("_ord", "_c"))
    cites = cites.withColumn("_section", number("_c")).withColumn("_article", F.contains(F.lower("_c"), F.lit("art")) | F.contains(F.col("_c"), F.lit("अनुच्छेद")))
    every = F.array(*[F.lit(f) for f in aliases.acts])
    tried = F.when(F.col("_named"), F.col("_families")).when(F.col("_article"), F.array(F.lit("charter"))).otherwise(every)
    probes = cites.select(key, *carried, "_domain", "_named", "_article", "_ord", "_section", F.posexplode(tried).alias("_f_ord", "_family"))
    acts = F.create_map(*[F.lit(x) for kv in aliases.acts.items() for x in kv])
    known = statutes.select(F.col("act_id").alias("_act"), F.upper("section").alias("_sec")).distinct()
    direct = probes.withColumn("_act", F.element_at(acts, F.col("_family"))).join(known.withColumnRenamed("_sec", "_section"), ["_act", "_section"])
    direct = direct.select(key, "_ord", "_f_ord", F.lit(1).alias("_kind"), F.concat("_act", F.lit(":"), "_section").alias("ref"), "_section", "_named", "_article", "_domain", *carried)
    moved = mappings.select(F.lower("old_act").alias("_family"), F.upper("old_section").alias("_section"), F.element_at(acts, F.lower("new_act")).alias("_new"), F.upper("new_section").alias("_new_section")).where("_new is not null")
    via = probes.where(F.col("_family").isin(*aliases.successors or ["-"])).join(moved, ["_family", "_section"])
    via = via.select(key, "_ord", "_f_ord", F.lit(0).alias("_kind"), F.concat("_new", F.lit(":"), "_new_section").alias("ref"), F.col("_new_section").alias("_section"), "_named", "_article", "_domain", *carried)
    # one shuffle: all groups below lie within a key
    found = direct.unionByName(via).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    loose = ~F.col("_named") & ~F.col("_article")
    if domain_acts:
        pairs = [(d, list(v)) for d, v in domain_acts.items()]
        lookup = F.create_map(*[x for d, v in pairs for x in (F.lit(d), F.array(*[F.lit(a) for a in v]))])
        found = found.withColumn("_in", F.coalesce(F.array_contains(F.element_at(lookup, F.col("_domain")), F.element_at(F.split("ref", ":"), 1)), F.lit(False)))
    else:
        found = found.withColumn("_in", F.lit(False))
    group = W.partitionBy(key, "_section")
    found = found.withColumn("_n", F.size(F.collect_set("ref").over(group))).withColumn("_any_in", F.max("_in").over(group))
    found = found.where(~loose | (F.col("_n") == 1) | ~F.col("_any_in") | F.col("_in"))
    found = found.withColumn("_n", F.size(F.collect_set("ref").over(group)))
    if idf is not None and postings is not None:
        q = found.where(loose & (F.col("_n") > 1)).select(key, "ref", "_section", F.explode(F.array_distinct(tokens("_t"))).alias("token")).distinct()
        overlap = q.join(postings.select(F.col("ref"), "token"), ["ref", "token"]).join(idf.select("token", "idf"), "token").groupBy(key, "_section", "ref").agg(F.round(F.sum("idf"), 9).alias("_score"))
        top = overlap.withColumn("_best", F.max("_score").over(group)).where("_score = _best and _score > 0").withColumn("_ties", F.count(F.lit(1)).over(group)).where("_ties = 1")
        found = found.join(top.select(key, "_section", F.col("ref").alias("_winner")), [key, "_section"], "left")
        found = found.where(~loose | (F.col("_n") == 1) | (F.col("ref") == F.col("_winner")))
    else:
        found = found.where(~loose | (F.col("_n") == 1))
    first = found.groupBy(key, "ref").agg(F.min(F.struct("_ord", "_f_ord", "_kind")).alias("_at"))
    return first.withColumn("ord", F.row_number().over(W.partitionBy(key).orderBy("_at", "ref"))).select(key, "ref", "ord")
