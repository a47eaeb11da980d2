import corpus_pipeline as p
from weftline.llm import queries as q

from .helpers import documents


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for name, stage in p.STAGES:
        out = stage(spark, docs, sf)
        at = f"{p.scratch_path(spark, 'test')}"
        out.write.parquet(at)
        out = spark.read.parquet(at)
        if name != "sentencepieces":
            assert out.columns == docs.columns
        counts.append(out.count())
        docs = out
    assert counts[1] <= counts[0] and counts[2] == counts[1] and counts[3] < counts[2] and counts[5] == counts[4]
    assert docs.where("not round_trip").count() == 0


def test_awkward_rows_go_through(spark, sf):
    from pyspark.sql import functions as F

    docs = documents(spark)
    for c in ("a.b", "_w_id", "row", "kept_text", "slot", "c0"):
        docs = docs.withColumn(c, F.col("key"))
    for name, stage in p.STAGES:
        docs = stage(spark, docs, sf)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        if name != "sentencepieces":
            assert all(r["a.b"] == r["_w_id"] == r["slot"] == r["key"] for r in rows)
        if name == "ngram_join":
            assert sum(r["doc_id"] == 3 for r in rows) == 1
    assert rows


def test_run_equals_the_queries_brute_force(spark, sf):
    """run() against the stages done by plain Python on the operators' own decisions."""
    import json
    import re
    from collections import Counter
    from hashlib import md5

    from pyspark.sql import functions as F

    from tests.llm.test_line_dedup import m as line
    from tests.llm.test_mixing import level, words
    from tests.llm.test_ngram_join import brute as classes
    from weftline.llm import sentencepieces, toxicity

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    field = toxicity.fit_on(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    import pyarrow as pa

    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    s, _ = toxicity.score_texts(pa.array([r[1] for r in rows]), field)
    rows = [r for r, x in zip(rows, s, strict=True) if x < 0.5]
    held = {}
    for d, t, _ in rows:
        for k in {line.key_of(x) for x in t.encode().split(b"\n")}:
            held.setdefault(k, set()).add(d)
    gone = {k: max(v) for k, v in held.items() if len(v) >= 3 and len(k.decode()) >= 20}
    rows = [(d, b"\n".join(x for x in t.encode().split(b"\n") if gone.get(line.key_of(x), d) == d).decode(), c) for d, t, c in rows]
    heads = {c for _, _, c in classes([(d, t) for d, t, _ in rows])}
    rows = [r for r in rows if r[0] in heads]
    sizes = Counter()
    for _, t, c in rows:
        sizes[c] += words(t)
    goal = {c: int(x + 0.5) for c, x in level(dict(sizes), (3, 1, 2)).items()}
    want = Counter()
    for c in goal:
        at = 0
        for d, t, _ in sorted((r for r in rows if r[2] == c), key=lambda r: md5(str(r[0]).encode()).hexdigest()):
            n = words(t)
            for a in (at, at + sizes[c]):
                took = min(a + n, goal[c]) - a
                if took > 0:
                    ends = [x.end() for x in re.finditer(r"[^\x20\x09-\x0D]+", t)]
                    want[d, c, t if took == n else t[: ends[took - 1]]] += 1
            at += n
    out = p.run(spark, sf)
    got = sentencepieces.decode(out.select("doc_id", "source", "pieces").withColumn("key", F.to_json(F.struct("doc_id", "source"))), "key").collect()
    found = Counter()
    for r in got:
        k = json.loads(r["key"])
        found[k["doc_id"], k.get("source"), r["text"]] += 1
    assert found == Counter({(d, c, t.replace("▁", " ")): n for (d, c, t), n in want.items()})
    assert out.where("not round_trip or n_samples < 1").count() == 0


def test_queries_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(q.SQL) <= set(names)
