"""Queries of gates, similarity and deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import jaccard, similarity_normal, split_words, strict_normal
from ..operators import curation as K
from ..operators import records as R
from ..session import spread
from ..sources.sinks import scratch
from .base import Tables, query

_NORM = "trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_WORDS = "list_distinct(list_filter(string_split({n}, ' '), lambda x: x <> ''))"


@query("""WITH m AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts FROM conversations GROUP BY conv_id),
r AS (SELECT conv_id, roles, texts, list_filter(texts, lambda x, i: roles[i] = 'user')[1] AS q, texts[len(texts)] AS a FROM m),
w AS (SELECT *, len(list_filter(string_split_regex(a, '\\s+'), lambda x: x <> '')) AS n FROM r)
SELECT conv_id, CASE WHEN roles[1:3] IS DISTINCT FROM ['system', 'user', 'assistant'] THEN 'schema'
 ELSE concat_ws('|', CASE WHEN conv_id % 5 = 0 THEN 'citation' END, CASE WHEN n < 40 OR n > 200 THEN 'length' END, CASE WHEN contains(a, 'idiot') THEN 'leakage' END) END AS reasons FROM w""")
def validate_reasons(t: Tables):
    """The gate over conversations: all failed checks, or the schema alone."""
    m = R.messages(t.conversations, "conv_id", "turn").withColumn("a", R.last_content()).withColumn("q", R.first_content("user"))
    no = F.lit("none")
    got = K.validation(F.transform("messages", lambda x: x["role"]), F.transform("messages", lambda x: x["content"]), F.col("q"), F.col("a"), no, no, F.array(F.lit("x")), F.col("conv_id") % 5 != 0, F.contains("a", F.lit("idiot")), {"none": 40}, max_words=200)
    return m.select("conv_id", F.array_join(got, "|").alias("reasons"))


@query("SELECT CASE WHEN n_chars < 200 THEN 'length' WHEN lang <> 'en' THEN 'language' ELSE 'other' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def reason_counts(t: Tables):
    why = F.when(F.col("n_chars") < 200, F.concat(F.lit("length: "), F.col("n_chars").cast("string"))).when(F.col("lang") != "en", F.concat(F.lit("language: "), "lang")).otherwise(F.lit("other"))
    return K.prefix_counts(t.documents.select(F.array(why).alias("r")), "r")


_SETS = f"s AS (SELECT doc_id, {_NORM.format(c='text')} AS normal FROM documents), w AS (SELECT doc_id, {_WORDS.format(n='normal')} AS words FROM s), e AS (SELECT doc_id, unnest(words) AS w FROM w)"


def _sets(t: Tables):
    """Word sets, computed once."""
    sets = K.token_sets(spread(t.documents.select("doc_id", "text")), "doc_id", "text").where(F.size("words") > 0)
    return scratch(t.spark)(sets.select("doc_id", "words"))


@query(f"""WITH {_SETS}, i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.w = b.w AND a.doc_id > b.doc_id GROUP BY ALL)
SELECT i.a, i.b, round(k / (len(x.words) + len(y.words) - k), 6) AS jaccard FROM i JOIN w x ON x.doc_id = a JOIN w y ON y.doc_id = b WHERE k / (len(x.words) + len(y.words) - k) >= 0.5""")
def jaccard_pairs(t: Tables):
    """Document pairs whose word sets are similar."""
    sets = _sets(t)
    return K.jaccard_pairs(sets, None, "doc_id", 0.5).withColumn("jaccard", F.round("jaccard", 6))


@query(f"""WITH {_SETS.replace('documents', 'benchmark').replace('doc_id', 'item_id')}, t AS (SELECT conv_id, turn, {_NORM.format(c='text')} AS normal FROM conversations)
SELECT item_id, count(conv_id) AS n FROM s LEFT JOIN t ON t.normal = s.normal GROUP BY item_id""")
def exact_normal_matches(t: Tables):
    """Turns equal to an item after normalisation."""
    s = t.benchmark.select("item_id", similarity_normal(F.coalesce("text", F.lit(""))).alias("normal"))
    c = t.conversations.select("conv_id", similarity_normal(F.coalesce("text", F.lit(""))).alias("normal"))
    return s.join(c, "normal", "left").groupBy("item_id").agg(F.count("conv_id").alias("n"))


@query()
def near_duplicates(t: Tables):
    """Pairs of conversation turns that are near duplicates by word sets and sequence ratio."""
    c = t.conversations.select(F.struct("conv_id", "turn").alias("id"), "text")
    return K.near_pairs(c, None, "id", "text")


@query(f"""WITH RECURSIVE {_SETS}, i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.w = b.w AND a.doc_id > b.doc_id GROUP BY ALL),
p AS (SELECT i.a, i.b FROM i JOIN w x ON x.doc_id = a JOIN w y ON y.doc_id = b WHERE k / (len(x.words) + len(y.words) - k) >= 0.5),
o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents),
d AS (SELECT o.n, o.doc_id, coalesce((SELECT list(b) FROM p WHERE p.a = o.doc_id), []) AS earlier FROM o WHERE doc_id IN (SELECT a FROM p UNION SELECT b FROM p)),
q AS (SELECT row_number() OVER (ORDER BY n) AS i, doc_id, earlier FROM d),
walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept UNION ALL
 SELECT q.i, CASE WHEN list_has_any(kept, earlier) THEN kept ELSE list_append(kept, q.doc_id) END FROM walk JOIN q ON q.i = walk.i + 1)
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM q) UNION ALL SELECT unnest(kept) FROM walk WHERE i = (SELECT coalesce(max(i), 0) FROM q)""")
def greedy_dedup(t: Tables):
    """Documents that stay when each is compared with kept earlier ones only."""
    sets = _sets(t)
    return K.greedy_keep(t.documents.select("doc_id"), K.jaccard_pairs(sets, None, "doc_id", 0.5), "doc_id", scratch(t.spark))


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def exact_dedup_first(t: Tables):
    return K.exact_first(t.documents.select("doc_id", "text"), "text", "doc_id").select("doc_id")


@query("""WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9ऀ-ॿ]+')) AS w FROM documents), b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9ऀ-ॿ]+')) AS w FROM benchmark)
SELECT DISTINCT doc_id FROM d JOIN b ON len(list_intersect(d.w, b.w)) >= 0.8 * len(b.w)""")
def leakage_semijoin(t: Tables):
    """Documents that hold four fifths of the words of some item.

    Items' words are the small side; counts of shared words decide, so no pair of texts is compared.
    """
    from ..functions.text import tokens

    b = t.benchmark.select("item_id", F.array_distinct(tokens("text")).alias("w")).select("item_id", F.size("w").alias("n"), F.explode("w").alias("token"))
    d = t.documents.select("doc_id", F.explode(F.array_distinct(tokens("text"))).alias("token"))
    shared = d.join(b, "token").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"))
    return shared.where("k >= 0.8 * n").select("doc_id").distinct()


_STRICT = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower({c}), '§', ' section '), '([0-9]),([0-9])', '\\1\\2', 'g'), '([0-9]),([0-9])', '\\1\\2', 'g'), '[\\\\\\[\\]!?.:;,\"''“”‘’`_|/—–॥।#%*&=+><}}{{-]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH m AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS q, arg_min(text, turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id),
w AS (SELECT conv_id, list_distinct(list_filter(string_split({_STRICT.format(c='q')}, ' '), lambda x: x <> '')) AS x, list_distinct(list_filter(string_split({_STRICT.format(c='a')}, ' '), lambda x: x <> '')) AS y FROM m WHERE q IS NOT NULL AND a IS NOT NULL)
SELECT conv_id, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 4) END AS similarity FROM w""")
def reference_similarity(t: Tables):
    m = R.messages(t.conversations, "conv_id", "turn").select("conv_id", R.first_content("user").alias("q"), R.first_content("assistant").alias("a")).where("q is not null and a is not null")
    return m.select("conv_id", F.round(jaccard(split_words(strict_normal("q")), split_words(strict_normal("a"))), 4).alias("similarity"))
