"""Queries of splits, caps, plans and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as R
from ..operators import splits as S
from ..sources import sinks
from ..sources.readers import eval_split, run_predictions
from .base import Tables, query

_H = "sha256('{seed}' || {key})"


@query("""WITH g AS (SELECT DISTINCT o_custkey AS g, max(o_custkey % 20 = 0) OVER (PARTITION BY o_custkey) AS held FROM orders),
f AS (SELECT g, row_number() OVER (ORDER BY sha256('' || g), g) AS n, count(*) OVER () AS c FROM g WHERE NOT held),
s AS (SELECT g, CASE WHEN n <= round_even(c * 0.1::DOUBLE, 0) THEN 'test' WHEN n <= round_even(c * 0.1::DOUBLE, 0) * 2 THEN 'val' ELSE 'train' END AS split FROM f
 UNION ALL SELECT g, 'test' FROM g WHERE held)
SELECT o_orderkey, split FROM orders JOIN s ON g = o_custkey""")
def grouped_split(t: Tables):
    """Orders split by customer; every twentieth customer is held out."""
    o = t.orders.select("o_orderkey", "o_custkey")
    return S.grouped_split(o, F.col("o_custkey").cast("string"), holdout=F.col("o_custkey") % 20 == 0).select("o_orderkey", "split")


@query("""WITH s AS (SELECT l_suppkey, CASE WHEN l_orderkey % 10 = 0 THEN 'test' WHEN l_orderkey % 10 = 1 THEN 'val' ELSE 'train' END AS split FROM lineitem)
SELECT l_suppkey, count(DISTINCT split) AS n_splits FROM s GROUP BY l_suppkey HAVING count(DISTINCT split) > 1""")
def split_straddle_check(t: Tables):
    """Suppliers that straddle splits made by order."""
    k = F.col("l_orderkey") % 10
    return S.straddling(t.lineitem.withColumn("split", F.when(k == 0, "test").when(k == 1, "val").otherwise("train")), "l_suppkey")


@query("""SELECT c_custkey, CASE WHEN row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY sha256('s' || c_custkey), c_custkey)
 <= round_even(count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) * 0.6::DOUBLE, 0) THEN 'public' ELSE 'private' END AS visibility FROM customer""")
def stratified_split(t: Tables):
    return S.stratified_split(t.customer, ["c_mktsegment", "c_nationkey"], "c_custkey", seed="s").select("c_custkey", "visibility")


@query("""WITH n AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('' || p_partkey), p_partkey) AS n FROM part),
r AS (SELECT p_partkey, CAST(row_number() OVER (ORDER BY n, p_brand) AS INT) AS turn FROM n)
SELECT p_partkey, turn, CASE WHEN turn <= 100 THEN 'grounded_qa' WHEN turn <= 160 THEN 'terminology' ELSE 'procedural' END AS task_type FROM r WHERE turn <= 200""")
def round_robin_sample(t: Tables):
    """Parts dealt to three task slices, brands taking turns."""
    from ..functions.text import hash_order

    dealt = R.round_robin(t.part.select("p_partkey", "p_brand"), "p_brand", [hash_order("p_partkey"), F.col("p_partkey")])
    return R.allocate(dealt, [("grounded_qa", 100), ("terminology", 60), ("procedural", 40)]).select("p_partkey", "turn", "task_type")


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) <= 5")
def cap_per_group(t: Tables):
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber")
    return S.cap_per_group(rows, "l_suppkey", [F.col("l_orderkey"), F.col("l_linenumber")], 5)


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY coalesce(sum(1 + o_orderkey % 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 8""")
def cap_overshoot(t: Tables):
    """Customers' orders until eight units are emitted; the last may pass it."""
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", (1 + F.col("o_orderkey") % 3).alias("units"))
    return S.cap_before(rows, "o_custkey", [F.col("o_orderkey")], "units", 8).drop("units")


@query("""WITH s AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM documents)
SELECT doc_id, n_chars FROM s WHERE run <= 1000000 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = s.doc_id)""")
def byte_cap_select(t: Tables):
    """Documents up to a million characters, those with labels being done already."""
    return S.byte_cap(t.documents.select("doc_id", "n_chars"), "doc_id", "n_chars", 1_000_000, t.labels.select("doc_id").distinct())


@query("""WITH p AS (SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) / count(*) OVER () AS pos FROM part)
SELECT p_partkey, CAST(unnest(range(CASE WHEN pos < 0.25 THEN 3 ELSE 1 END)) AS INT) AS sample_id FROM p""")
def plan_sample_expand(t: Tables):
    """The first quarter of the plan three times, the rest once."""
    from pyspark.sql import Window as W

    p = t.part.select("p_partkey")
    # positions by a rank within ranges would do at scale; the plan is a list of tasks
    n = p.crossJoin(F.broadcast(p.agg(F.count(F.lit(1)).alias("_n")))).withColumn("_i", F.row_number().over(W.orderBy("p_partkey")) - 1)
    return R.sample_plan(n, F.col("_i") / F.col("_n"), 3, 0.25).select("p_partkey", "sample_id")


@query("""WITH e AS (SELECT event_id, '```json' || chr(10) || '[{"question": "q' || event_type || '", "answer": "a' || user_id || '"}, {"question": "", "answer": "x"}, {"question": "r", "answer": "' || event_id || '"}]' || chr(10) || '```' AS raw FROM events)
SELECT event_id, CAST(n AS INT) AS n, q AS question, a AS answer, event_id || '_0' || n AS id FROM (
 SELECT event_id, 1 AS n, 'q' || event_type AS q, 'a' || user_id AS a FROM events UNION ALL SELECT event_id, 3, 'r', CAST(event_id AS VARCHAR) FROM events)""")
def teacher_json_parse(t: Tables):
    e = t.events
    items = F.concat(F.lit('[{"question": "q'), F.col("event_type"), F.lit('", "answer": "a'), F.col("user_id").cast("string"), F.lit('"}, {"question": "", "answer": "x"}, {"question": "r", "answer": "'), F.col("event_id").cast("string"), F.lit('"}]'))
    raw = e.select("event_id", F.concat(F.lit("```json\n"), items, F.lit("\n```")).alias("raw"))
    return R.parse_answers(raw, "event_id", "raw")


_ANSWERS = "a AS (SELECT o_custkey AS task, o_orderkey AS sample, o_orderstatus || '-' || o_orderkey AS answer, o_orderstatus = 'O' AS good, CASE o_orderstatus WHEN 'F' THEN 'outside_context' WHEN 'P' THEN 'miss_cited' END AS reason FROM orders)"


def _answers(t: Tables):
    f = F.col("o_orderstatus")
    return t.orders.select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("sample"), F.concat(f, F.lit("-"), F.col("o_orderkey").cast("string")).alias("answer"), (f == "O").alias("good"), F.when(f == "F", "outside_context").when(f == "P", "miss_cited").alias("reason"))


@query(f"WITH {_ANSWERS}, c AS (SELECT task, arg_min(answer, sample) AS chosen FROM a WHERE good GROUP BY task) SELECT task, answer AS rejected, reason AS reject_reason, sample, chosen FROM a JOIN c USING (task) WHERE NOT good AND reason IN ('outside_context')")
def dpo_pairs(t: Tables):
    return R.preference_pairs(_answers(t), "task", "sample", F.col("good"), "reason", ("outside_context",))


@query(f"WITH {_ANSWERS} SELECT task, min(sample) AS sample, arg_min(answer, sample) AS answer FROM a GROUP BY task")
def first_sample_per_task(t: Tables):
    return R.first_sample(_answers(t), "task", "sample").select("task", "sample", "answer")


@query("""SELECT c_custkey AS asset_id, CASE WHEN s_suppkey IS NOT NULL THEN 'cached' WHEN n > 0 THEN 'fetched' ELSE 'failed' END AS status
FROM customer LEFT JOIN (SELECT DISTINCT s_suppkey FROM supplier) ON s_suppkey = c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def manifest_status(t: Tables):
    """Customers as assets: suppliers' numbers are cached, those with orders fetched."""
    k = lambda df, c: df.select(F.col(c).alias("asset_id"))
    return sinks.asset_status(k(t.customer, "c_custkey"), k(t.supplier, "s_suppkey"), k(t.orders, "o_custkey"))


@query("""WITH o AS (SELECT n_name AS label, CAST(n_regionkey AS BIGINT) AS v FROM nation), n AS (SELECT n_name AS label, count(*) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000 GROUP BY 1)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE label NOT IN (SELECT label FROM n)""")
def report_upsert(t: Tables):
    """New counts replace old values by label."""
    old = t.nation.select(F.col("n_name").alias("label"), F.col("n_regionkey").cast("long").alias("v"))
    rich = t.customer.where("c_acctbal > 9000").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return sinks.upsert(old, rich.groupBy(F.col("n_name").alias("label")).agg(F.count(F.lit(1)).alias("v")), "label")


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT l_partkey FROM lineitem)")
def resume_antijoin(t: Tables):
    done = t.lineitem.select(F.col("l_partkey").alias("event_id"))
    return t.events.select("event_id").join(done, "event_id", "left_anti")


@query("SELECT conv_id AS id, arg_max(text, turn) AS response, CAST(max(turn) AS BIGINT) AS last_turn FROM conversations GROUP BY conv_id")
def last_line_wins(t: Tables):
    """One prediction per conversation: its last line."""
    c = t.conversations.select(F.col("conv_id").alias("id"), F.col("turn").alias("line"), F.col("text").alias("response"), F.col("turn").alias("last_turn"))
    return run_predictions(c).select("id", "response", "last_turn")


@query("SELECT doc_id AS id, quality FROM labels WHERE toxic = 0")
def uncurated_filter(t: Tables):
    """Records that need no curation."""
    rows = t.labels.select(F.col("doc_id").alias("id"), "quality", (F.col("toxic") == 1).alias("needs_curation"))
    return eval_split(rows).select("id", "quality")


@query("SELECT page_id, url FROM pages WHERE (url LIKE 'https://%' OR url LIKE 'http://blog.%') AND (contains(url, '/en/') OR contains(url, '/de/'))")
def prefix_contains_filter(t: Tables):
    return t.pages.where(S.matches_any("url", ("https://", "http://blog."), ("/en/", "/de/"))).select("page_id", "url")


@query("""SELECT supplier.s_suppkey AS id, CASE WHEN c.k IS NULL THEN 'supplier_only' ELSE 'both' END AS side FROM supplier LEFT JOIN (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0) c ON c.k = s_suppkey""")
def complement_groups(t: Tables):
    """Ids that two sets share and the complement of one."""
    s = t.supplier.select(F.col("s_suppkey").alias("id"))
    c = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"))
    both = s.join(c, "id", "left_semi").withColumn("side", F.lit("both"))
    return both.unionByName(s.join(c, "id", "left_anti").withColumn("side", F.lit("supplier_only")))
