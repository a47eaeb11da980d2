"""Queries of fact matching, metrics, recall and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grading as G
from ..functions.text import STOPWORDS, STRICT_NUMERALS, UNITS, split_words
from ..operators import metrics as M
from ..operators import records as R
from .curating import _STRICT
from .base import Tables, query
from .retrieving import _bm25_sql, bm25, few

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
_NUM = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in STRICT_NUMERALS.items()) + "}"
_UNITS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in UNITS.items()) + "}"


def _strict(c: str) -> str:
    """SQL of a text's strict tokens."""
    return f"list_filter(list_transform(string_split({_STRICT.format(c=c)}, ' '), lambda w: coalesce(map_extract({_NUM}, w)[1], w)), lambda w: w <> '' AND NOT list_contains({_STOP}, w))"


def _stem(w: str) -> str:
    n = f"length({w})"
    cut = lambda s, k="": f"WHEN {w} LIKE '%{s}' AND {n} >= {len(s) + 3} THEN substr({w}, 1, {n} - {len(s)}) || '{k}'"
    return f"CASE WHEN NOT regexp_full_match({w}, '[\\x00-\\x7f]*') OR regexp_full_match({w}, '[0-9]+') OR {n} <= 3 THEN {w} {cut('ies', 'y')} {cut('ing')} {cut('edly')} {cut('ed')} {cut('es')} WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' AND {n} >= 4 THEN substr({w}, 1, {n} - 1) ELSE {w} END"


def _graded(c: str) -> str:
    """SQL of a text's graded tokens, for texts without compound numerals."""
    t = _STRICT.format(c=c).replace("><}{", "><()}{")
    return f"list_transform(list_filter(list_transform(string_split({t}, ' '), lambda w: coalesce(map_extract({_UNITS}, w)[1], w)), lambda w: w <> '' AND NOT list_contains({_STOP}, w)), lambda w: {_stem('w')})"


_WS = "list_filter(string_split_regex({c}, '\\s+'), lambda x: x <> '')"
_PAIRS = f"""m AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS q, arg_min(text, turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, q, a, array_to_string({_WS.format(c='a')}[3:5], ' ') AS f1, array_to_string({_WS.format(c='q')}[1:3], ' ') AS f2 FROM m WHERE q IS NOT NULL AND a IS NOT NULL)"""


def _pairs(t: Tables):
    """Questions and answers with two facts: three words of the answer, three of the question."""
    m = R.messages(t.conversations, "conv_id", "turn").select("conv_id", R.first_content("user").alias("q"), R.first_content("assistant").alias("a")).where("q is not null and a is not null")
    cut = lambda c, i, n: F.array_join(F.slice(split_words(c), i, n), " ")
    return m.withColumn("f1", cut("a", 3, 3)).withColumn("f2", cut("q", 1, 3))


@query(f"WITH {_PAIRS}, x AS (SELECT conv_id, array_to_string({_strict('a')}, ' ') AS r, array_to_string({_strict('f1')}, ' ') AS s1, array_to_string({_strict('f2')}, ' ') AS s2 FROM p) SELECT conv_id, contains(r, s1) AS own, contains(r, s2) AS other FROM x")
def fact_strict(t: Tables):
    return _pairs(t).select("conv_id", G.fact_present("f1", "a").alias("own"), G.fact_present("f2", "a").alias("other"))


@query(f"WITH {_PAIRS}, x AS (SELECT conv_id, {_strict('a')} AS r, {_strict('f1')} AS s1, {_strict('f2')} AS s2 FROM p) SELECT conv_id, len(s1) > 0 AND list_has_all(r, s1) AS own, len(s2) > 0 AND list_has_all(r, s2) AS other FROM x")
def fact_lenient(t: Tables):
    return _pairs(t).select("conv_id", G.fact_tokens_present("f1", "a").alias("own"), G.fact_tokens_present("f2", "a").alias("other"))


_SCORED = f"""{_PAIRS}, g AS (SELECT conv_id, list_distinct({_graded('a')}) AS r, list_distinct({_graded('f1')}) AS s1, list_distinct({_graded('q')}) AS s2 FROM p),
h AS (SELECT conv_id, len(s1) AS n1, len(list_intersect(s1, r)) AS k1, len(s2) AS n2, len(list_intersect(s2, r)) AS k2 FROM g)"""


@query(f"""WITH {_SCORED} SELECT conv_id, CASE WHEN n1 > 0 AND k1 = n1 THEN 1.0 WHEN n1 > 0 AND k1 / n1 >= 0.6 THEN round(k1 / n1, 4) ELSE 0.0 END AS own,
 CASE WHEN n2 > 0 AND k2 = n2 THEN 1.0 WHEN n2 > 0 AND k2 / n2 >= 0.6 THEN round(k2 / n2, 4) ELSE 0.0 END AS question FROM h""")
def fact_partial_credit(t: Tables):
    return _pairs(t).select("conv_id", G.score_fact("f1", "a")["score"].alias("own"), G.score_fact("q", "a")["score"].alias("question"))


@query("""SELECT * FROM (VALUES (1, FALSE), (2, FALSE), (3, FALSE), (4, TRUE), (5, TRUE), (6, TRUE), (7, TRUE), (8, FALSE)) v(id, violated)""")
def forbidden_framing(t: Tables):
    rows = [
        (1, "Section 154 old code as current law", "Use Section 154 of the old code today."),
        (2, "Section 154 old code as current law", "Section 173 alpha act replaced Section 154 of the old code."),
        (3, "Section 154 old code as current law", "Nothing of the kind."),
        (4, "pay cash", "You should pay cash at once."),
        (5, "Section 154 old code still applies", "Section 154 old code was repealed. But file under Section 154 old code now."),
        (6, "Section 154 old code as current law", "Use Section 154 old code today."),
        (7, "Section 154 old code अभी भी लागू", "File under Section 154 old code."),
        (8, "Section 154 old code is enforceable", "धारा 154 old code अब निरस्त है।"),
    ]
    df = t.spark.createDataFrame(rows, "id int, fact string, response string")
    return df.select("id", G.forbidden_present("fact", "response").alias("violated"))


@query(f"WITH {_SCORED} SELECT conv_id, CAST(CASE WHEN n1 > 0 AND k1 = n1 THEN 1 ELSE 0 END + CASE WHEN n2 > 0 AND k2 = n2 THEN 1 ELSE 0 END AS INT) AS n_kept FROM h")
def curate_facts(t: Tables):
    """How many of a record's facts its own gold answer satisfies."""
    c = G.curate_columns(F.array("f1", "q"), F.array().cast("array<string>"), "a")
    return _pairs(t).select("conv_id", F.size(c["kept_facts"]).alias("n_kept"))


_LABELLED = "l AS (SELECT d.doc_id, lang, source, l.quality, l.toxic, n_chars FROM labels l JOIN documents d USING (doc_id))"


def _judged(t: Tables):
    d = t.labels.join(t.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id")
    none = F.array().cast("array<string>")
    return d.select("doc_id", "lang", "source", (F.col("toxic") == 1).alias("is_safety_row"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("auto_strict_correct"),
                    F.when(F.col("n_chars") % 5 == 0, F.array("lang")).otherwise(none).alias("forbidden_facts_violated"), (F.col("n_chars") % 3 == 0).alias("abstained"),
                    F.when(F.col("quality") == 0, F.array("source")).otherwise(none).alias("required_facts_missing"), F.when(F.col("n_chars") % 2 == 0, F.array("lang")).otherwise(none).alias("extracted_citations"))


@query(f"""WITH {_LABELLED}, j AS (SELECT lang, source, toxic = 1 AS safe, quality = 1 AND toxic = 0 AS ok, n_chars % 5 = 0 AS bad, n_chars % 3 = 0 AS ab FROM l),
u AS (SELECT 'all' AS dim, 'all' AS value, * FROM j UNION ALL SELECT 'lang', lang, * FROM j UNION ALL SELECT 'source', source, * FROM j)
SELECT dim, value, count(*) AS total, count(*) FILTER (NOT safe) AS scored_total, count(*) FILTER (ok) AS auto_strict_correct,
 round(coalesce(count(*) FILTER (ok AND NOT safe) / nullif(count(*) FILTER (NOT safe), 0), 0), 4) AS auto_strict_accuracy,
 count(*) FILTER (bad) AS forbidden_violations, round(avg(CASE WHEN ab THEN 1.0::DOUBLE ELSE 0 END), 4) AS abstention_rate FROM u GROUP BY ALL""")
def eval_buckets(t: Tables):
    return M.strict_metrics(_judged(t), ["lang", "source"])


@query(f"""WITH {_LABELLED}, r AS (SELECT lang, source, quality * 0.75::DOUBLE AS fr, CASE WHEN n_chars % 2 = 0 THEN quality * 0.5::DOUBLE END AS cr, CASE WHEN n_chars % 3 = 0 THEN 0.25::DOUBLE END AS sr, quality = 1 AS af, n_chars % 5 = 0 AS bad FROM l WHERE toxic = 0),
u AS (SELECT 'all' AS dim, 'all' AS value, * FROM r UNION ALL SELECT 'lang', lang, * FROM r UNION ALL SELECT 'source', source, * FROM r)
SELECT dim, value, count(*) AS n, round(coalesce(avg(fr), 0), 4) AS fact_recall, round(coalesce(avg(cr), 0), 4) AS citation_accuracy, count(cr) AS citation_rows, round(coalesce(avg(sr), 0), 4) AS substance_recall,
 round(avg(CASE WHEN af THEN 1.0::DOUBLE ELSE 0 END), 4) AS all_facts, round(avg(CASE WHEN bad THEN 1.0::DOUBLE ELSE 0 END), 4) AS forbidden_violation_rate FROM u GROUP BY ALL""")
def graded_buckets(t: Tables):
    d = t.labels.join(t.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id")
    q, n = F.col("quality"), F.col("n_chars")
    rows = d.select("lang", "source", (F.col("toxic") == 1).alias("is_safety_row"), (q * 0.75).alias("fact_recall"), F.when(n % 2 == 0, q * 0.5).alias("citation_recall"), F.when(n % 3 == 0, 0.25).alias("substance_recall"), (q == 1).alias("all_facts"), F.when(n % 5 == 0, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("forbidden_violated"))
    return M.graded_metrics(rows, ["lang", "source"])


@query(f"""WITH {_LABELLED}, f AS (SELECT * FROM l WHERE toxic = 0 AND quality = 0),
m AS (SELECT 'stale_cited' AS mode FROM f WHERE n_chars % 5 = 0 UNION ALL SELECT 'over_abstention' FROM f WHERE n_chars % 3 = 0 UNION ALL SELECT 'wrong_or_incomplete_citation' FROM f WHERE n_chars % 2 = 0 UNION ALL SELECT 'no_citation' FROM f WHERE n_chars % 2 = 1)
SELECT mode, count(*) AS n FROM m GROUP BY mode""")
def error_modes(t: Tables):
    return M.error_modes(_judged(t))


@query("""WITH f AS (SELECT doc_id, 0 AS i, source AS item FROM documents UNION ALL SELECT doc_id, 1, lang FROM documents)
SELECT item, count(*) AS n FROM f GROUP BY item ORDER BY n DESC, min((doc_id, i)), item LIMIT 10""")
def top_missing(t: Tables):
    """The most common facts, as sources and languages; a top-k report."""
    return M.top_items(t.documents.select("doc_id", F.array("source", "lang").alias("x")), "x", "doc_id", 10)


_HITS = f"""{_bm25_sql(False, 50)}, v AS (SELECT r.item_id, r.doc_id, rank, contains(d.text, b.text) AS gold FROM r JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)),
h AS (SELECT b.item_id, b.item_id % 2 AS parity, coalesce((SELECT list(doc_id ORDER BY rank) FROM v WHERE v.item_id = b.item_id AND gold), []) AS gold, coalesce((SELECT list(doc_id ORDER BY rank) FROM v WHERE v.item_id = b.item_id AND rank <= 8), []) AS found FROM benchmark b)"""


def _hits(t: Tables, title: bool = False):
    """item_id, parity, gold (candidates that hold the item verbatim), found (the first eight)."""
    c = few(bm25(t, 50, title).join(t.benchmark, "item_id")).join(t.documents.select("doc_id", F.col("text").alias("body")), "doc_id")
    pick = lambda on: F.transform(F.array_sort(F.collect_list(F.when(on, F.struct("rank", "doc_id")))), lambda x: x["doc_id"])  # noqa: E731  50 rows an item at most
    per = c.groupBy("item_id").agg(pick(F.contains("body", F.col("text"))).alias("gold"), pick(F.col("rank") <= 8).alias("found"))
    none = F.array().cast("array<bigint>")
    return t.benchmark.select("item_id", (F.col("item_id") % 2).alias("parity")).join(per, "item_id", "left").withColumn("gold", F.coalesce("gold", none)).withColumn("found", F.coalesce("found", none))


@query(f"""WITH {_HITS}, k AS (SELECT unnest([1, 3, 5, 8]) AS k), x AS (SELECT parity, k, list_has_any(found[1:k], gold) AS a, list_has_all(found[1:k], gold) AS f FROM h, k WHERE len(gold) > 0),
u AS (SELECT 'all' AS dim, 'all' AS value, k, a, f FROM x UNION ALL SELECT 'parity', CAST(parity AS VARCHAR), k, a, f FROM x)
SELECT dim, value, k, count(*) AS n, round(avg(CASE WHEN a THEN 1.0::DOUBLE ELSE 0 END), 4) AS any_hit, round(avg(CASE WHEN f THEN 1.0::DOUBLE ELSE 0 END), 4) AS full_hit FROM u GROUP BY ALL""")
def recall_at_k(t: Tables):
    return M.recall_at(_hits(t), "item_id", "gold", "found", (1, 3, 5, 8), ["parity"])


@query(f"""WITH {_HITS} SELECT CASE WHEN len(gold) = 0 THEN 'no_gold' WHEN list_has_all(found, gold) THEN 'gold_in_context' ELSE 'gold_missing' END AS bucket, count(*) AS n FROM h GROUP BY 1""")
def rescore_by_retrieval(t: Tables):
    return _hits(t).select(M.retrieval_bucket("gold", "found").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_bm25_sql(False, 8)}, w AS (SELECT item_id, contains(d2.text, b.text) AS v, len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9ऀ-ॿ]+')), d.tok)) / len(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9ऀ-ॿ]+'))) AS c
 FROM r JOIN d USING (doc_id) JOIN documents d2 USING (doc_id) JOIN benchmark b USING (item_id)), i AS (SELECT item_id, bool_or(v) AS v, max(c) AS c FROM w GROUP BY item_id)
SELECT count(*) AS n, round(avg(CASE WHEN v THEN 1.0::DOUBLE ELSE 0 END), 4) AS verbatim, round(avg(CASE WHEN c >= 0.6 THEN 1.0::DOUBLE ELSE 0 END), 4) AS scored, round(avg(c), 4) AS mean_best FROM i""")
def phrase_coverage(t: Tables):
    """How many items some retrieved document holds verbatim, or by most of its words."""
    from ..functions.text import tokens

    c = few(bm25(t, 8).join(t.benchmark, "item_id")).join(t.documents.select("doc_id", F.col("text").alias("body")), "doc_id")
    own = F.array_distinct(tokens("text"))
    c = c.select("item_id", F.contains("body", F.col("text")).alias("v"), (F.size(F.array_intersect(own, tokens("body"))) / F.size(own)).alias("c"))
    per = c.groupBy("item_id").agg(F.max("v").alias("v"), F.max("c").alias("c"))
    return per.agg(F.count(F.lit(1)).alias("n"), M.rate(F.col("v")).alias("verbatim"), M.rate(F.col("c") >= 0.6).alias("scored"), M.mean("c").alias("mean_best"))


@query("""WITH j AS (SELECT doc_id, quality = 1 AS x, toxic = 0 AS y, CASE WHEN doc_id % 2 = 0 THEN 'audited' ELSE 'never' END AS g FROM labels),
u AS (SELECT 'overall' AS grp, x, y FROM j UNION ALL SELECT g, x, y FROM j),
r AS (SELECT grp, count(*) AS n, round(avg(CASE WHEN x THEN 1.0::DOUBLE ELSE 0 END), 4) AS before, round(avg(CASE WHEN y THEN 1.0::DOUBLE ELSE 0 END), 4) AS after FROM u GROUP BY grp)
SELECT grp, n, before, after, round(after - before, 4) AS delta, round(after - before, 4) >= 0.03 AS generalises FROM r""")
def generalisation_groups(t: Tables):
    base = t.labels.withColumn("grp", F.when(F.col("doc_id") % 2 == 0, "audited").otherwise("never"))
    return M.generalisation(base.withColumn("hit", F.col("quality") == 1), t.labels.withColumn("hit", F.col("toxic") == 0), "doc_id", "grp", "hit")


@query("""WITH n AS (SELECT l_returnflag, l_quantity AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, max(n) AS n, max(x) FILTER (i = n // 2) AS p50, max(x) FILTER (i = CAST(floor(n * 0.95) AS BIGINT)) AS p95, max(x) AS largest FROM n GROUP BY l_returnflag""")
def order_stats(t: Tables):
    return M.order_statistics(t.lineitem, "l_returnflag", "l_quantity", {"p50": 0.5, "p95": 0.95, "largest": 1.0})


@query("""WITH d AS (SELECT CAST(floor(s_acctbal) AS BIGINT) AS x, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier), n AS (SELECT count(*) AS n FROM d),
w AS (SELECT r.range AS r, CAST('0x' || substr(md5('b:' || r.range || ':' || j.range), 1, 12) AS BIGINT) % n AS i FROM range(10000) r, n, range((SELECT n FROM n)) j),
m AS (SELECT r, round(avg(x), 9) AS m FROM w JOIN d USING (i) GROUP BY r), o AS (SELECT m, row_number() OVER (ORDER BY m, r) - 1 AS p FROM m)
SELECT (SELECT n FROM n) AS n, (SELECT round(avg(x), 6) FROM d) AS mean, max(m) FILTER (p = 250) AS lo, max(m) FILTER (p = 9750) AS hi FROM o""")
def bootstrap_ci(t: Tables):
    d = t.supplier.select("s_suppkey", F.floor("s_acctbal").cast("long").alias("x"))
    return M.bootstrap_ci(d, "s_suppkey", "x", seed="b")


@query("""WITH p AS (SELECT quality * 1.0::DOUBLE AS a, 1.0::DOUBLE - toxic AS b FROM labels)
SELECT count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(b - a), 6) AS delta, count(*) FILTER (b > a) AS better, count(*) FILTER (b < a) AS worse, count(*) FILTER (b = a) AS tied FROM p""")
def paired_compare(t: Tables):
    x = t.labels
    return M.paired_summary(M.paired(x.select("doc_id", (F.col("quality") * 1.0).alias("m")), x.select("doc_id", (1.0 - F.col("toxic")).alias("m")), "doc_id", "m"))


@query("""WITH a AS (SELECT role, nullif(regexp_extract(upper(text), '(^|[^\\p{L}\\p{N}_])([ABCD])([^\\p{L}\\p{N}_]|$)', 2), '') AS pred FROM conversations)
SELECT role, count(*) AS n, count(*) FILTER (pred = 'A') AS correct, count(*) FILTER (pred IS NULL) AS unparsed FROM a GROUP BY role""")
def mcq_accuracy(t: Tables):
    """Turns as answers to a question whose key is A."""
    pred = G.mcq_letter("text")
    return t.conversations.select("role", pred.alias("p")).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("p") == "A", 1)).alias("correct"), F.count(F.when(F.col("p").isNull(), 1)).alias("unparsed"))


@query("""WITH m AS (SELECT l_returnflag, 0.1::DOUBLE * ((-l_quantity + 20) - (-l_linenumber + l_tax)) AS m FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(avg(m), 6) AS margin, round(avg(greatest(-m, 0) + ln(1 + exp(-abs(m)))), 6) AS loss FROM m GROUP BY l_returnflag""")
def dpo_loss(t: Tables):
    q = F.col
    m, loss = M.preference_loss(-q("l_quantity"), F.lit(-20.0), -q("l_linenumber").cast("double"), -q("l_tax"))
    return t.lineitem.select("l_returnflag", m.alias("m"), loss.alias("x")).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("m"), 6).alias("margin"), F.round(F.avg("x"), 6).alias("loss"))


@query("SELECT round(sum(n_chars) / sum(n_chars // 2 + 1), 4) AS loss, round(exp(sum(n_chars) / sum(n_chars // 2 + 1)), 4) AS perplexity, CAST(sum(n_chars // 2 + 1) AS BIGINT) AS tokens FROM documents")
def eval_loss(t: Tables):
    return M.mean_nll(t.documents.selectExpr("n_chars nll", "n_chars div 2 + 1 n"), "nll", "n")


@query("""WITH c AS (SELECT l_returnflag AS g, count(*) AS n, avg(CASE WHEN l_quantity > 25 THEN 1.0::DOUBLE ELSE 0 END) AS p FROM lineitem GROUP BY 1)
SELECT a.g AS a, b.g AS b, round(b.p - a.p, 6) AS gap, round(b.p - a.p - 1.96 * sqrt(a.p * (1 - a.p) / a.n + b.p * (1 - b.p) / b.n), 6) AS lo, round(b.p - a.p + 1.96 * sqrt(a.p * (1 - a.p) / a.n + b.p * (1 - b.p) / b.n), 6) AS hi FROM c a JOIN c b ON a.g < b.g""")
def proportion_gaps(t: Tables):
    c = t.lineitem.groupBy(F.col("l_returnflag").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0)).alias("p"))
    x, y = c.alias("x"), c.alias("y")
    gap, lo, hi = M.proportion_gap(F.col("x.n"), F.col("x.p"), F.col("y.n"), F.col("y.p"))
    return x.join(y, F.col("x.g") < F.col("y.g")).select(F.col("x.g").alias("a"), F.col("y.g").alias("b"), F.round(gap, 6).alias("gap"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("SELECT source AS name, round(avg(n_chars), 4) AS score, count(*) FILTER (n_chars < 100) AS violations FROM documents GROUP BY source ORDER BY score DESC, violations, name LIMIT 1")
def checkpoint_pick(t: Tables):
    """The source of the longest texts as the run to keep; a top-1 report."""
    runs = t.documents.groupBy(F.col("source").alias("name")).agg(F.round(F.avg("n_chars"), 4).alias("score"), F.count(F.when(F.col("n_chars") < 100, 1)).alias("violations"))
    return M.best_run(runs, "name", "score", "violations", "name")


