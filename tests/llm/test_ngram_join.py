import random

import pyarrow as pa
from pyspark.sql import functions as F

from weftline.llm import ngram_join as m

from .helpers import documents, empty


def brute(rows, n=3, threshold=0.5):
    grams, off = m.gram_sets(pa.array([r[1] for r in rows], pa.string()), n)
    sets = [frozenset(grams[off[i] : off[i + 1]].tolist()) for i in range(len(rows))]
    links, group = [0] * len(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (rows[i][1] or "") == (rows[j][1] or "") or both and both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    ids = [-(2**63) if r[0] is None else r[0] for r in rows]
    return sorted((ids[i], links[i], min(ids[j] for j in range(len(rows)) if group[j] == group[i])) for i in range(len(rows)))


def check(spark, rows, df):
    got = m.similarity_classes(df).collect()
    found = sorted((-(2**63) if r["doc_id"] is None else r["doc_id"], r["n_links"], r["class_id"]) for r in got)
    assert found == brute(rows)


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    base = [[rng.choice(vocabulary) for _ in range(60)] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        words = list(base[0 if i % 3 == 0 else rng.randrange(len(base))])  # one group holds a third
        for _ in range(rng.choice((0, 1, 2, 4))):
            words[rng.randrange(60)] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    return rows


def test_awkward_rows(spark):
    df = documents(spark)
    check(spark, [(r["doc_id"], r["text"]) for r in df.collect()], df)


def test_random_corpus_with_a_hot_group(spark):
    rows = corpus(300, 3)
    check(spark, rows, spark.createDataFrame(rows, "doc_id long, text string"))


def test_hot_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(m, "LEAF", 8)
    monkeypatch.setattr(m, "BLOCK", 16)
    rows = corpus(240, 4)
    got = m.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {d: n for d, n, _ in brute(rows)}
    assert all(r["n_links"] <= want[r["doc_id"]] for r in got)
    assert sum(r["n_links"] for r in got) >= 0.99 * sum(want.values())


def test_block_pairs_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 16)
    monkeypatch.setattr(m, "BLOCK_GRAMS", 500)
    rows = corpus(240, 5)
    check(spark, rows, spark.createDataFrame(rows, "doc_id long, text string"))


def test_paths_go_deeper_than_the_sure_levels(spark, monkeypatch):
    """Sets that share a passage but aren't alike part at last; none of their links is lost."""
    monkeypatch.setattr(m, "LEAF", 8)
    monkeypatch.setattr(m, "SURE", 1)
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(18))
    rows = [(i, passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))) for i in range(120)]
    rows += [(1000 + i, t) for i, t in rows[:5]] + [(2000 + i, t + " tail of more words") for i, t in rows[5:10]]
    levels = []
    kept = m._grow
    monkeypatch.setattr(m, "_grow", lambda *a: levels.append(kept(*a)) or levels[-1])
    check(spark, rows, spark.createDataFrame(rows, "doc_id long, text string"))
    assert levels[0][2] > 1 and len(levels) == 2


def test_texts_without_words_stay_apart(spark):
    rows = [(1, "+---+"), (2, "!!! ???"), (3, "{}; ();"), (4, ""), (5, None), (6, "+---+"), (7, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(spark, rows, df)
    assert sorted(r["doc_id"] for r in m.one_per_class(df).collect()) == [1, 2, 3, 4, 7]


def test_clashing_names_pass_unchanged(spark):
    names = ["doc_id", "text", "_w_id", "_w_th", "a.b", "row", "id", "th", "c0"]
    df = spark.createDataFrame([(1, "one two three four", "keep", "x", 5, 6, 7, 8, 9), (2, "one two three four", "gone", "y", 5, 6, 7, 8, 9)], names)
    got = m.one_per_class(df)
    assert got.columns == names and [tuple(r) for r in got.collect()] == [(1, "one two three four", "keep", "x", 5, 6, 7, 8, 9)]


def test_one_per_class(spark):
    df = documents(spark)
    kept = m.one_per_class(df)
    assert kept.columns == df.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    classes = m.similarity_classes(df).select("class_id").distinct().count()
    assert len(ids) == classes and "9" not in ids and ids.count("3") == 1


def test_empty_table(spark):
    assert m.similarity_classes(empty(spark)).count() == 0
    assert m.one_per_class(empty(spark)).count() == 0


def test_runs_reach_the_recall():
    assert m.runs_for(0.5, 0.99, 5) > m.runs_for(0.5, 0.99, 3) > m.runs_for(0.5, 0.9, 3) > m.runs_for(0.8, 0.9, 3)


def test_components_of_a_chain(spark):
    rows = [(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"\xf0", b"\xf1")]
    got = m.components(spark.createDataFrame(rows, "digest binary, root binary")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sorted(r["n"] for r in got) == [2, 41]
