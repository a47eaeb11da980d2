"""Queries of page texts, sections, mapping tables and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import corpus as K
from ..streaming import flows
from ..sources.sinks import scratch_folder
from .base import Tables, query


@query("""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g') AS x FROM pages),
e AS (SELECT page_id, replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS x FROM t)
SELECT page_id, trim(regexp_replace(x, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS text FROM e""")
def page_text(t: Tables):
    return t.pages.select("page_id", K.page_text("html").alias("text"))


@query("""SELECT s_suppkey, CAST(o AS INT) AS ord, section, title, body AS text, chapter FROM (
 SELECT s_suppkey, 0 AS o, '1' AS section, 'Short title' AS title, 'Body of ' || s_name || ' one.' AS body, 'CHAPTER I — General' AS chapter FROM supplier
 UNION ALL SELECT s_suppkey, 1, '2', 'Scope', 'Applies to ' || s_name || '.', 'CHAPTER I — General' FROM supplier
 UNION ALL SELECT s_suppkey, 2, '3A', 'Claims of owners', 'Claim ' || s_suppkey || '.', 'CHAPTER II — Rights' FROM supplier)""")
def section_bounds(t: Tables):
    """Acts written from suppliers, split into sections with their chapters."""
    n, k = F.col("s_name"), F.col("s_suppkey").cast("string")
    act = F.concat(F.lit("INDEX\n1. Short title\nBE it enacted\nCHAPTER I\nGENERAL\n1. Short title.—Body of "), n, F.lit(" one.\n2. Scope.—Applies to "), n, F.lit(".\nCHAPTER II\nRIGHTS\n3A. Claims of\n owners.—Claim "), k, F.lit(".\nTHE FIRST SCHEDULE\n4. Not this.—one\n"))
    return K.split_sections(t.supplier.select("s_suppkey", K.slice_body(act).alias("text")), "s_suppkey", "text")


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'view' THEN CAST(event_id AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS mark FROM events""")
def chapter_asof(t: Tables):
    """Every event with its user's last view at or before it."""
    e = t.events.select("event_id", "user_id")
    marks = t.events.where("event_type = 'view'").select("user_id", "event_id", F.col("event_id").cast("string").alias("mark"))
    return K.last_before(e, marks, "user_id", "event_id", "mark")


@query("""WITH c AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN (o_orderkey % 500) || '. Title' WHEN o_orderkey % 3 = 2 AND o_orderkey % 2 = 0 THEN 'CHAPTER X' ELSE '' END AS a, CAST(o_orderkey % 300 AS VARCHAR) AS o FROM orders),
f AS (SELECT *, last_value(CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_orderkey % 500 AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS n FROM c)
SELECT o_custkey, o_orderkey AS ord, n AS new_section, o AS old_section FROM f WHERE a <> 'CHAPTER X' AND n IS NOT NULL""")
def mapping_ffill(t: Tables):
    """Customers' orders as table rows: old numbers under the last new one."""
    k = F.col("o_orderkey")
    left = F.when(k % 3 == 1, F.concat((k % 500).cast("string"), F.lit(". Title"))).when((k % 3 == 2) & (k % 2 == 0), "CHAPTER X").otherwise("")
    cells = t.orders.select("o_custkey", "o_orderkey", left.alias("left_cell"), F.concat((k % 300).cast("string"), F.lit(". Old")).alias("right_cell"))
    return K.mapping_pairs(cells, "o_custkey", "o_orderkey")


@query("""WITH s AS (SELECT o_custkey, o_orderkey AS i, CAST(o_orderkey % 9 + 1 AS INT) AS n, o_orderkey % 4 = 0 AS short FROM orders),
b AS (SELECT *, lag(n) OVER (PARTITION BY o_custkey ORDER BY i) > n AS back FROM s),
g AS (SELECT o_custkey, count(*) AS extracted, NOT coalesce(bool_or(back), FALSE) AS monotonic, max(n) - min(n) + 1 - count(DISTINCT n) AS gaps, count(DISTINCT CASE WHEN short THEN n END) AS short FROM b GROUP BY o_custkey)
SELECT o_custkey, extracted, monotonic, CAST(gaps AS INT) AS n_gaps, CAST(short AS INT) AS n_short, round(greatest(0, 1 - (gaps + short + CASE WHEN monotonic THEN 0 ELSE 1 END) / greatest(extracted, 1)), 4) AS clean_fraction FROM g""")
def numbering_gaps(t: Tables):
    """Customers as acts, orders as sections: gaps, order and short bodies."""
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, "short").otherwise(F.repeat(F.lit("long "), 10))
    s = t.orders.select("o_custkey", "o_orderkey", (k % 9 + 1).cast("string").alias("section"), text.alias("text"))
    q = K.section_quality(s, "o_custkey", "o_orderkey")
    return q.select("o_custkey", "extracted", "monotonic", F.size("gaps").alias("n_gaps"), F.size("short").alias("n_short"), "clean_fraction")


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_windows(t: Tables):
    """Daily windows over the events as a stream, written by its micro-batches."""
    spark = t.spark
    stream = flows.file_stream(spark, f"{t.folder}/events.parquet*", t.events.schema)
    days = flows.windowed(stream, "ts", ["event_type"], [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")], "1 day")
    at = f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = days.writeStream.outputMode("complete").option("checkpointLocation", at + "-state").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(at)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(days.schema).parquet(at).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def first_event_per_user(t: Tables):
    """The batch form of first-occurrence dedup."""
    return t.events.groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def json_props(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))
