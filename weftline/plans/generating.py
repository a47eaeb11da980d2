"""Queries of generation plans, rule-based records and behavioural scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import grading as G
from ..operators import generation as N
from ..operators import records as R
from .base import Tables, query
from .retrieving import _CITED, _cited, _laws


def _statutes(t: Tables):
    """Parts as sections of acts, with durations in their texts."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("Whoever does so is liable to a term that may extend to "), F.when(k % 3 == 0, "seven").otherwise("ten"), F.lit(" years"), F.when(k % 4 == 0, ", and in default, may extend to two years").otherwise(""),
                    F.when(k % 5 == 0, ", with a fine which may extend to five thousand rupees").otherwise(""), F.when(k % 2 == 0, ", if tried within sixty days").otherwise(""), F.lit("."))
    return t.part.select("p_partkey", F.col("p_brand").alias("act"), k.cast("string").alias("section"), F.concat(F.lit("Punishment for "), F.col("p_name"), F.lit(".")).alias("title"), text.alias("text"))


_RULES = """s AS (SELECT p_partkey, 'Section ' || p_partkey || ' of the ' || p_brand AS cite, p_name, upper(p_name[1]) || p_name[2:] AS subj, CASE WHEN p_partkey % 3 = 0 THEN 'seven' ELSE 'ten' END AS y FROM part),
q AS (SELECT p_partkey, 'max_years' AS subtype, subj || ': up to ' || y || ' years, by ' || cite || '.' AS answer FROM s WHERE p_partkey % 4 <> 0
 UNION ALL SELECT p_partkey, 'fine', subj || ': up to five thousand rupees, by ' || cite || '.' FROM s WHERE p_partkey % 5 = 0
 UNION ALL SELECT p_partkey, 'deadline', 'Within sixty days, by ' || cite || '.' FROM s WHERE p_partkey % 2 = 0
 UNION ALL SELECT p_partkey, 'which_section', subj || ' is treated in ' || cite || '.' FROM s)"""


@query(f"WITH {_RULES} SELECT * FROM q")
def rule_qa(t: Tables):
    return N.rule_questions(_statutes(t), "p_partkey", "act", "section", "title", "text").drop("question")


@query(f"WITH {_RULES} SELECT subtype, coalesce(CASE WHEN p_partkey % 7 = 0 THEN 'eval_reachable' WHEN p_partkey % 11 = 0 THEN 'gold_not_retrieved' END, 'kept') AS reason, count(*) AS n FROM q GROUP BY ALL")
def grounding_counts(t: Tables):
    q = N.rule_questions(_statutes(t), "p_partkey", "act", "section", "title", "text")
    k = F.col("p_partkey")
    got = N.grounding_skips(q, k % 7 == 0, k % 11 != 0, F.lit(5), F.col("answer"))
    return got.groupBy("subtype", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'seven' ELSE 'ten' END END AS years, CASE WHEN p_partkey % 4 <> 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 7 ELSE 10 END END AS n, CASE WHEN p_partkey % 2 = 0 THEN 60 END AS days FROM part")
def unique_match_extract(t: Tables):
    y = G.unique_match("text", N.YEARS)
    return _statutes(t).select("p_partkey", y.alias("years"), N.word_number(y).alias("n"), N.word_number(G.unique_match("text", N.DAYS)).alias("days"))


@query("""WITH u AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY sha256('42' || doc_id), doc_id) AS n FROM documents WHERE length(text) >= 200),
r AS (SELECT *, row_number() OVER (ORDER BY n, source) AS turn FROM u),
p AS (SELECT *, CASE WHEN turn <= 300 THEN 'grounded_qa' ELSE 'terminology' END AS task_type FROM r WHERE turn <= 400)
SELECT 'gen_' || lpad(CAST(turn AS VARCHAR), 6, '0') || '_' || substr(sha256('From the section below alone, write four questions of a citizen and their answers as a JSON list.' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'Kind: ' || task_type), 1, 8) AS task_id, task_type, source AS source_act, CAST(doc_id AS VARCHAR) AS section FROM p""")
def generation_plan(t: Tables):
    plan = N.generation_plan(t.documents.select("doc_id", "source", "text"), [("grounded_qa", 300), ("terminology", 100)], "doc_id", "source", "text")
    return plan.select("task_id", "task_type", "source_act", F.get("source_sections", F.lit(0)).alias("section"))


@query("""WITH g AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN lower(source) || ':' || upper(lang) END AS k, CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM documents)
SELECT doc_id, k IS NOT NULL AND u < 0.1 AS miss, CASE WHEN k IS NULL OR u < 0.1 THEN '' ELSE k END AS shown FROM g""")
def raft_plan(t: Tables):
    d = t.documents.select("doc_id", "text", F.when(F.col("doc_id") % 3 > 0, F.array(F.concat(F.upper("source"), F.lit(":"), "lang"))).otherwise(F.array().cast("array<string>")).alias("sections"))
    got = N.raft_plan(d, "doc_id", "text", "sections", F.lit("(context)"))
    return got.select("doc_id", "miss", F.array_join("source_sections", ",").alias("shown"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 9 = 0 THEN CASE WHEN o_custkey % 4 = 0 THEN 'ok' ELSE 'miss_task_cited' END
 WHEN o_custkey % 4 = 0 THEN CASE WHEN o_custkey % 2 = 1 THEN 'ok' ELSE 'no_citation' END WHEN o_orderkey % 5 <> o_orderkey % 3 THEN 'citation_outside_context' ELSE 'ok' END AS verdict FROM orders""")
def context_gate(t: Tables):
    o, k = t.orders, F.col("o_orderkey")
    answer = F.when(F.col("o_custkey") % 4 == 0, "nothing cited").otherwise(F.concat(F.lit("By Section "), (k % 5).cast("string"), F.lit(" it is so.")))
    key = F.array(F.concat(F.lit("alpha_2023:"), (k % 3).cast("string")))
    rows = o.select("o_orderkey", answer.alias("answer"), key.alias("keys"), (F.col("o_custkey") % 9 == 0).alias("miss"))
    return rows.select("o_orderkey", N.context_gate(F.col("answer"), F.col("keys"), F.col("keys"), F.col("miss")).alias("verdict"))


@query(f"""WITH {_CITED}, k AS (SELECT 'alpha_2023:' || x AS ref FROM c WHERE x < 40 UNION ALL SELECT 'alpha_2023:' || (x + 1) FROM c WHERE x < 50 UNION ALL SELECT 'alpha_2023:' || y FROM c WHERE sfx = '' AND y < 40
 UNION ALL SELECT 'alpha_2023:' || (y + 1) FROM c WHERE sfx = '' AND y < 50) SELECT DISTINCT ref FROM k""")
def excluded_keys(t: Tables):
    statutes, mappings = _laws(t)
    return N.excluded_keys(_cited(t), "o_orderkey", "text", statutes, mappings)


@query("SELECT * FROM (VALUES (1, 'old:124A,old:7'), (2, ''), (3, 'old:498A')) v(id, refs)")
def bare_references(t: Tables):
    df = t.spark.createDataFrame([(1, "OLD 124A and old 7."), (2, "bold 7, old7, older 9"), (3, "under 498a OLD only")], "id int, text string")
    return df.select("id", F.array_join(F.transform(N.bare_references("text", ("old",)), lambda r: F.concat(r["family"], F.lit(":"), r["section"])), ",").alias("refs"))


@query("SELECT * FROM (VALUES (1, 'alpha_2023:9', 0), (2, '', 1), (3, '', 0)) v(id, gold, n_unresolved)")
def gold_section_keys(t: Tables):
    statutes, mappings = _laws(t)
    df = t.spark.createDataFrame([(1, ["Section 9 alpha", "pay"]), (2, ["Section 99 alpha"]), (3, [])], "id int, facts array<string>")
    return N.gold(df, "id", "facts", statutes, mappings).select("id", F.array_join("gold", ",").alias("gold"), F.size("unresolved").alias("n_unresolved"))


@query(f"""WITH {_CITED} SELECT o_orderkey, TRUE AS has_citations, x < 40 AND sfx = '' AND y < 40 AS citation_ok, TRUE AS old_law_cited, TRUE AS language_ok, 1.0 AS reference_similarity FROM c""".replace("y < 40 AS citation_ok", "y < 50 AS citation_ok"))
def dataset_behaviour(t: Tables):
    statutes, mappings = _laws(t)
    rows = _cited(t).withColumn("reference", F.col("text")).withColumn("language", F.lit("english"))
    return N.dataset_scores(rows, "o_orderkey", "text", "reference", "language", C.whitelist(statutes, mappings))


@query("SELECT CASE WHEN lang IN ('fr', 'de') THEN CASE lang WHEN 'fr' THEN 'hindi' ELSE 'hinglish' END WHEN n_chars < 300 THEN 'safety' ELSE source END AS category, count(*) AS n FROM documents GROUP BY 1")
def category_counts(t: Tables):
    lang = F.when(F.col("lang") == "fr", "hindi").when(F.col("lang") == "de", "hinglish").otherwise("english")
    return t.documents.select(N.category(lang, F.when(F.col("n_chars") < 300, "safety_abstention").otherwise("qa"), F.col("source")).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH q AS (SELECT source AS domain, CASE WHEN n_chars % 2 = 0 THEN 'below floor' ELSE 'no tokens' END AS reason FROM documents WHERE n_chars % 3 = 0)
SELECT 'domain' AS dim, domain AS value, count(*) AS n FROM q GROUP BY ALL UNION ALL SELECT 'reason', reason, count(*) FROM q GROUP BY ALL""")
def curation_counts(t: Tables):
    why = F.when(F.col("n_chars") % 2 == 0, F.lit("below floor: 1/3")).otherwise("no tokens")
    facts = F.when(F.col("n_chars") % 3 == 0, F.array(F.struct(why.alias("reason")))).otherwise(F.array().cast("array<struct<reason: string>>"))
    return N.curation_report(t.documents.select("source", facts.alias("quarantined_facts")), "source")


@query("SELECT doc_id, quality, lang FROM labels JOIN documents USING (doc_id)")
def joined_records(t: Tables):
    """Predictions with their records; one without a record is an error."""
    return N.joined_whole(t.labels.select("doc_id", "quality"), t.documents.select("doc_id", "lang"), "doc_id")


@query()
def leaking_turns(t: Tables):
    """Conversation turns that nearly equal an item."""
    c = t.conversations.select(F.struct("conv_id", "turn").alias("id"), "text")
    return N.leaking(c, "id", [("text", "text")], t.benchmark, "item_id")


@query("SELECT conv_id, list_aggregate(list_distinct(list(role ORDER BY turn)), 'count') AS n_roles, coalesce(min(CASE WHEN role = 'system' THEN 1 END), 0) AS has_system FROM conversations GROUP BY conv_id")
def record_shapes(t: Tables):
    m = R.messages(t.conversations, "conv_id", "turn")
    roles = F.transform("messages", lambda x: x["role"])
    return m.select("conv_id", F.size(F.array_distinct(roles)).cast("long").alias("n_roles"), F.when(F.array_contains(roles, "system"), 1).otherwise(0).alias("has_system"))
