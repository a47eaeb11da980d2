"""Plans and rule-based records: what to ask a teacher, what to derive from texts, what to leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import grading as G
from ..functions.text import UNITS, hash_order, reference_similarity, tokens, word_count
from .context import prompt
from .curation import near_pairs
from .records import allocate, gold_keys, is_miss, round_robin, task_id

Synonyms = list[tuple[str, str]]
BARE = r"(?i)(?<![\p{L}\p{N}_])(?:(ABBR)\s+([0-9]+[a-zA-Z]{0,2})|([0-9]+[a-zA-Z]{0,2})[\s]+(ABBR))(?![\p{L}\p{N}_])"
YEARS = r"(?i)may extend to ([a-z0-9-]+(?: [a-z0-9-]+)?) years?"
LEAST_YEARS = r"(?i)not be less than ([a-z0-9-]+(?: [a-z0-9-]+)?) years?"
FINE = r"(?i)fine which may extend to ([a-z0-9,]+(?: [a-z]+){0,3}) rupees"
DAYS = r"(?i)within ([a-z0-9-]+(?: [a-z0-9-]+)?) days"
TEACHER = "From the section below alone, write four questions of a citizen and their answers as a JSON list.\n\n{context}\n\n{question}"


def searchable(act: Column, title: Column, text: Column, summary: Column, tags: Column) -> Column:
    """All that the index searches of a row; nulls are left out."""
    return F.concat_ws(" ", act, title, text, summary, F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " "))


def title_tokens(title: Column, tags: Column) -> Column:
    """Tokens that earn the title bonus: those of the title and of the tags."""
    return F.array_union(tokens(title), tokens(F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " ")))


def section_group(sections: Column) -> Column:
    """The sorted sections as one group key; all records without any share a group."""
    s = F.sort_array(F.coalesce(sections, F.array().cast("array<string>")))
    return F.when(F.size(s) == 0, F.array(F.lit("_none"))).otherwise(s)


def context_gate(answer: Column, context_keys: Column, sections: Column, miss: Column) -> Column:
    """ok or what is wrong, in this order: a miss that cites, gold without a citation, a citation from outside."""
    cited = F.size(C.extract(answer)) > 0
    return (
        F.when(miss, F.when(cited, "miss_task_cited").otherwise("ok"))
        .when((F.size(sections) > 0) & ~cited, "no_citation")
        .when(cited & ~C.within_context(answer, context_keys), "citation_outside_context")
        .otherwise("ok")
    )


def bare_references(text: str | Column, abbreviations: tuple[str, ...]) -> Column:
    """Array of (family, section) for "ABC 12" and "12 ABC", in order."""
    c = F.col(text) if isinstance(text, str) else text
    pattern = BARE.replace("ABBR", "|".join(abbreviations))
    hits = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    number = lambda h: F.upper(F.regexp_extract(h, r"([0-9]+[a-zA-Z]{0,2})(?![\p{L}\p{N}_])", 1))
    family = lambda h: F.lower(F.regexp_extract(h, rf"(?i)(?<![\p{{L}}\p{{N}}_])({'|'.join(abbreviations)})(?![\p{{L}}\p{{N}}_])", 1))
    return F.transform(hits, lambda h: F.struct(family(h).alias("family"), number(h).alias("section")))


def excluded_keys(texts: DataFrame, key: str, text: str, statutes: DataFrame, mappings: DataFrame, aliases: C.Aliases = C.DEMO) -> DataFrame:
    """ref: every section that some text reaches, by a citation or by a bare reference to repealed law."""
    direct = C.reference_keys(texts, key, text, statutes, mappings, aliases).select("ref")
    bare = texts.select(F.explode(bare_references(text, tuple(aliases.successors))).alias("b")).select("b.family", "b.section")
    acts = F.create_map(*[F.lit(x) for kv in aliases.acts.items() for x in kv])
    m = mappings.select(F.lower("old_act").alias("family"), F.upper("old_section").alias("section"), F.concat(F.element_at(acts, F.lower("new_act")), F.lit(":"), F.upper("new_section")).alias("ref"))
    return direct.unionByName(bare.join(m, ["family", "section"]).select("ref")).where("ref is not null").distinct()


def gold(records: DataFrame, key: str, facts: str, statutes: DataFrame, mappings: DataFrame, aliases: C.Aliases = C.DEMO) -> DataFrame:
    """``key``, gold (sorted keys), unresolved (facts that cite what doesn't exist)."""
    flat = records.select(key, F.posexplode(facts).alias("_i", "_f")).withColumn("_k", F.concat_ws("\x00", F.col(key).cast("string"), F.col("_i").cast("string")))
    refs = C.reference_keys(flat, "_k", "_f", statutes, mappings, aliases).groupBy("_k").agg(F.collect_set("ref").alias("_r"))
    j = flat.join(refs, "_k", "left").withColumn("_lost", F.col("_r").isNull() & (F.size(C.extract("_f")) > 0))
    got = j.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_r")))).alias("gold"), F.array_sort(F.collect_list(F.when(F.col("_lost"), F.col("_f")))).alias("unresolved"))
    none = F.array().cast("array<string>")
    return records.select(key).join(got, key, "left").select(key, F.coalesce("gold", none).alias("gold"), F.coalesce("unresolved", none).alias("unresolved"))


def word_number(word: Column) -> Column:
    """The number that a word or two joined by a hyphen spell; null if none."""
    units = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    parts = F.split(F.lower(F.trim(word)), "-")
    both = F.element_at(units, F.get(parts, F.lit(0))) + F.element_at(units, F.get(parts, F.lit(1)))
    return F.coalesce(word.try_cast("int"), F.when(F.size(parts) == 1, F.element_at(units, F.get(parts, F.lit(0)))).when(F.size(parts) == 2, both))


def rule_questions(rows: DataFrame, key: str, act: str, section: str, title: str, text: str) -> DataFrame:
    """``key``, subtype, question, answer: one row for each value that a section states just once, and one for the section itself."""
    t = F.regexp_replace(F.trim(F.col(title)), r"\.+$", "")
    bare = F.regexp_replace(t, r"(?i)^punishment for\s+", "")
    subject = F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, F.lit(2), F.length(bare)))
    cite = F.concat(F.lit("Section "), F.col(section), F.lit(" of the "), F.col(act))

    def row(subtype: str, found: Column, question: Column, answer: Column) -> Column:
        return F.when(found.isNotNull(), F.struct(F.lit(subtype).alias("subtype"), question.alias("question"), answer.alias("answer")))

    one = lambda p: G.unique_match(text, p)
    low = F.lower(t)
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    made = F.array_compact(F.array(
        row("max_years", one(YEARS), say("How long can one be imprisoned for ", low, "?"), say(subject, ": up to ", one(YEARS), " years, by ", cite, ".")),
        row("min_years", one(LEAST_YEARS), say("How long must one be imprisoned for ", low, "?"), say(subject, ": at least ", one(LEAST_YEARS), " years, by ", cite, ".")),
        row("fine", one(FINE), say("What is the fine for ", low, "?"), say(subject, ": up to ", one(FINE), " rupees, by ", cite, ".")),
        row("deadline", one(DAYS), say("By when must one act on ", low, "?"), say("Within ", one(DAYS), " days, by ", cite, ".")),
        row("which_section", F.lit(1), say("Where does the law treat ", low, "?"), say(subject, " is treated in ", cite, ".")),
    ))
    return rows.where(t != "").select(key, F.explode(made).alias("q")).select(key, "q.*")


def grounding_skips(rows: DataFrame, excluded: Column, in_context: Column, hits: Column, answer: Column, most: int = 60) -> DataFrame:
    """``rows`` with reason: why a derived record is left out, the first that applies; null for those kept."""
    why = F.when(excluded, "eval_reachable").when(~in_context, "gold_not_retrieved").when(hits < 2, "no_distractors").when(word_count(answer) > most, "answer_too_long")
    return rows.withColumn("reason", why)


def generation_plan(sections: DataFrame, slices: list[tuple[str, int]], key: str, act: str, text: str, least: int = 200, seed: str = "42") -> DataFrame:
    """task_id, task_type, source_act, source_sections, prompt: sections dealt to slices, acts taking turns."""
    usable = sections.where(F.length(text) >= least)
    dealt = allocate(round_robin(usable, act, [hash_order(key, seed=seed), F.col(key)]), slices)
    p = prompt(F.col(text), F.concat(F.lit("Kind: "), F.col("task_type")), TEACHER)
    out = dealt.withColumn("prompt", p).withColumn("task_id", task_id("gen", F.col("turn"), F.col("prompt")))
    return out.select("task_id", "task_type", F.col(act).alias("source_act"), F.array(F.col(key).cast("string")).alias("source_sections"), "prompt", "turn")


def raft_plan(records: DataFrame, key: str, question: str, sections: str, context: Column, fraction: float = 0.1, seed: str = "7") -> DataFrame:
    """``key``, miss, source_sections, user_prompt, task_id: one task a record, some shown without their gold.

    ``context`` is the formatted context that goes with ``miss``.
    """
    g = records.withColumn("_gold", gold_keys(F.coalesce(F.col(sections), F.array().cast("array<string>"))))
    g = g.withColumn("miss", is_miss("_gold", key, fraction, seed)).withColumn("user_prompt", prompt(context, F.col(question)))
    shown = F.when(F.col("miss"), F.array().cast("array<string>")).otherwise(F.col("_gold"))
    name = F.concat(F.lit("raft_"), F.col(key).cast("string"), F.lit("_"), F.substring(F.sha1(F.col("user_prompt").cast("binary")), 1, 8))
    return g.select(key, "miss", shown.alias("source_sections"), "user_prompt", name.alias("task_id"))


def dataset_scores(rows: DataFrame, key: str, answer: str, reference: str, language: str, whitelist: DataFrame, aliases: C.Aliases = C.DEMO) -> DataFrame:
    """``key``, has_citations, citation_ok, old_law_cited, language_ok, reference_similarity of an answer."""
    old = F.max(F.col("act").isin(*aliases.successors or ["-"]))
    r = C.resolve(rows, key, answer, whitelist, aliases).groupBy(key).agg(F.min("resolved").alias("ok"), old.alias("old"), F.count(F.lit(1)).alias("n"))
    j = rows.join(r, key, "left")
    return j.select(
        key, (F.coalesce("n", F.lit(0)) > 0).alias("has_citations"), F.coalesce("ok", F.lit(True)).alias("citation_ok"), F.coalesce("old", F.lit(False)).alias("old_law_cited"),
        G.script_matches(language, answer).alias("language_ok"), F.round(reference_similarity(answer, reference), 4).alias("reference_similarity"),
    )


def category(language: Column, task_type: Column, domain: Column) -> Column:
    """Language before safety before domain."""
    return F.when(language.isin("hindi", "hinglish"), language).when(task_type == "safety_abstention", "safety").otherwise(domain)


def curation_report(curated: DataFrame, domain: str, quarantined: str = "quarantined_facts", mark: str = ":") -> DataFrame:
    """dim, value, n: quarantined facts by the start of their reason and by domain."""
    flat = curated.select(F.col(domain).alias("domain"), F.explode(quarantined).alias("q")).select("domain", F.substring_index("q.reason", mark, 1).alias("reason"))
    g = flat.groupingSets([[F.col("domain")], [F.col("reason")]], F.col("domain"), F.col("reason")).agg(F.grouping("domain").alias("_g"), F.count(F.lit(1)).alias("n"))
    return g.select(F.when(F.col("_g") == 0, "domain").otherwise("reason").alias("dim"), F.coalesce("domain", "reason").alias("value"), "n")


def joined_whole(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on a key that every left row must find: reading fails at one that doesn't."""
    j = left.join(right.withColumn("_there", F.lit(True)), key, "left")
    lost = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no record for "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return j.where(lost).drop("_there")


def leaking(examples: DataFrame, key: str, texts: list[tuple[str, str]], evals: DataFrame, eval_key: str, threshold: float = 0.85) -> DataFrame:
    """``key`` of examples a text of which nearly equals the eval column that goes with it: (example column, eval column)."""
    out = None
    for mine, theirs in texts:
        a = examples.select(F.col(key).alias("_k"), F.col(mine).alias("_t"))
        b = evals.select(F.col(eval_key).alias("_k"), F.col(theirs).alias("_t"))
        hit = near_pairs(a, b, "_k", "_t", threshold).select(F.col("a").alias(key))
        out = hit if out is None else out.unionByName(hit)
    return out.distinct()


def positions(rows: DataFrame, by: str, order: str) -> DataFrame:
    """``rows`` with pos: their place within a group as a share in [0, 1)."""
    w = W.partitionBy(by)
    return rows.withColumn("pos", (F.row_number().over(w.orderBy(order)) - 1) / F.count(F.lit(1)).over(w))


def pick_synonyms(synonyms: DataFrame, version: str) -> Synonyms:
    """One version's (phrase, expansion) in order, for ``index.expand``; a later duplicate keeps the first one's place.

    A synonym table is a configuration: it must have fewer than 100,000 rows.
    """
    w = W.partitionBy("phrase")
    s = synonyms.where(F.col("version") == version).withColumn("_first", F.min("ord").over(w)).withColumn("_last", F.max("ord").over(w)).where("ord = _last")
    rows = s.orderBy("_first").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("too many synonyms for one expression")
    return [(r["phrase"], r["expansion"]) for r in rows]
