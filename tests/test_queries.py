"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from weftline.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "~"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return f"{float(x):.6g}"
    if hasattr(x, "as_tuple"):
        return f"{float(x):.6g}"
    return str(x)


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    cur = duck.execute(registry.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert table([tuple(r) for r in df.collect()], df.columns) == table(cur.fetchall(), names)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_near_duplicates_equal_all_pairs(spark):
    import re
    from difflib import SequenceMatcher

    from weftline.operators import curation as K

    texts = ["one two three four five six seven", "one two three four five six sevens", "ONE two, three four five six seven!", "other words", "", None, "one two three four five six seven"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r["a"], r["b"]) for r in K.near_pairs(df, None, "id", "text").collect()}
    import re

    norm = [" ".join(re.sub(r"(?![\w\s]).", " ", (t or "").lower()).split()) for t in texts]
    want = {(i, norm.index(n)) for i, n in enumerate(norm) if norm.index(n) != i}
    firsts = sorted({norm.index(n) for n in norm if n})
    want |= {(a, b) for a in firsts for b in firsts if a > b and SequenceMatcher(None, norm[a], norm[b]).ratio() > 0.92}
    assert got == want and (1, 0) in got


def test_turns_of_long_conversations_are_rows_of_their_own(spark, tmp_path):
    said = "one two three four five six seven eight nine ten"
    near = said + "s"
    # turn 1000 and 1001 of conversation 1 beside turn 0 and 1 of conversation 2
    rows = [(1, i, "user", f"turn{i} of{i} its{i} own{i}") for i in range(1000)] + [(1, 1000, "user", said), (1, 1001, "user", "p q r"), (2, 0, "user", near), (2, 1, "user", "P q, r")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(7, said), (8, "p q r")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registry.QUERIES["near_duplicates"](spark, str(tmp_path)).collect()
    assert sorted((tuple(r["a"]), tuple(r["b"])) for r in got) == [((2, 0), (1, 1000)), ((2, 1), (1, 1001))]
    got = registry.QUERIES["leaking_turns"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r["id"]) for r in got) == [(1, 1000), (1, 1001), (2, 0), (2, 1)]


@pytest.mark.parametrize("name", ["pack_budget", "phrase_coverage", "bm25_title_bonus_topk", "format_context", "bm25_topk"])
def test_documents_stay_where_they_are(spark, sf, name):
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables of any size
    try:
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    # only the items themselves may be shuffled for a join
    assert plan.count("SortMergeJoin") <= (name == "format_context")
    assert not any("text#" in line and "documents" in line for line in plan.splitlines() if "Exchange" in line)
