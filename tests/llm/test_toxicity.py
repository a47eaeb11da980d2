import itertools
import zlib

import numpy as np
import pytest

from weftline.llm import toxicity as m

from .helpers import documents, empty


def chain(e, move):
    """Marginals by summing over all state sequences."""
    total, on = 0.0, np.zeros(len(e))
    for states in itertools.product((0, 1), repeat=len(e)):
        w, before = 1.0, 0
        for s, x in zip(states, e, strict=True):
            w *= move[before][s] * (x if s else 1.0)
            before = s
        total += w
        on += w * np.array(states)
    return on / total


def test_marginals_equal_brute_force():
    rng = np.random.default_rng(1)
    move = np.array([[1.0, 0.3], [0.8, 2.5]])
    sizes = [0, 1, 7, 0, 3, 10, 0]
    e = np.exp(rng.normal(0, 2, sum(sizes)))
    row = np.repeat(np.arange(len(sizes)), sizes)
    got, at = m.marginals(e, row, len(sizes), move), 0
    for n in sizes:
        if n:
            assert np.allclose(got[at : at + n], chain(e[at : at + n], move))
        at += n


def test_marginals_of_long_rows_equal_one_pass():
    rng = np.random.default_rng(2)
    move = np.array([[1.0, 0.2], [0.7, 3.0]])
    n = 5 * m.WINDOW + 9
    e = np.exp(rng.normal(0, 3, n))
    f, b = np.zeros((n, 2)), np.ones((n, 2))
    a = np.array([1.0, 0.0])
    for i in range(n):
        a = (a @ move) * np.array([1, e[i]])
        f[i] = a = a / a.sum()
    for i in range(n - 2, -1, -1):
        b[i] = move @ (b[i + 1] * np.array([1, e[i + 1]]))
        b[i] /= b[i].sum()
    p = f * b
    assert np.allclose(m.marginals(e, np.zeros(n, np.int64), 1, move), p[:, 1] / p.sum(1))


def test_gradient_equals_finite_differences():
    """Observed less expected counts against the slope of the log likelihood, summed over all state sequences."""
    rng = np.random.default_rng(4)
    sizes = [1, 6, 4]
    seq = np.repeat(np.arange(3), sizes)
    t = rng.integers(0, 2, len(seq)).astype(bool)
    logs, move = rng.normal(0, 1, len(seq)), rng.normal(0, 1, (2, 2))

    def likelihood(logs, move):
        out, at = 0.0, 0
        for n in sizes:
            weight = {}
            for states in itertools.product((0, 1), repeat=n):
                before, w = 0, 0.0
                for s, x in zip(states, logs[at : at + n], strict=True):
                    w, before = w + move[before][s] + (x if s else 0.0), s
                weight[states] = w
            out += weight[tuple(int(x) for x in t[at : at + n])] - np.log(np.sum(np.exp(list(weight.values()))))
            at += n
        return out

    p, due = m.expected(np.exp(logs), seq, np.exp(move))
    seen, before = np.zeros((2, 2)), 0
    for i, x in enumerate(t):
        before = 0 if i == 0 or seq[i] != seq[i - 1] else int(t[i - 1])
        seen[before, int(x)] += 1
    h = 1e-5
    for i in range(len(logs)):
        d = h * (np.arange(len(logs)) == i)
        assert abs((likelihood(logs + d, move) - likelihood(logs - d, move)) / (2 * h) - (t[i] - p[i])) < 1e-6
    for a, b in itertools.product((0, 1), repeat=2):
        d = np.zeros((2, 2))
        d[a, b] = h
        assert abs((likelihood(logs, move + d) - likelihood(logs, move - d)) / (2 * h) - (seen - due)[a, b]) < 1e-6


def test_query_equals_a_plain_chain(spark, sf):
    """The registered query on a whole table against one token at a time in Python."""
    from weftline.llm import queries
    from weftline.llm.common import lower, texts, words

    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    f = m.fit_on(docs, labels)
    import pyarrow as pa

    got = {r["doc_id"]: r for r in queries.op9_toxicity(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows[:60]:
        data, off = texts(pa.array([r["text"]], pa.string()))
        start, end, _ = words(data, off)
        e = f.emissions(m.token_features(lower(data), start, end)) if len(start) else np.zeros(0)
        a, forward = np.array([1.0, 0.0]), []
        for x in e:
            a = (a @ f.move) * np.array([1, x])
            a /= a.sum()
            forward.append(a)
        b, p = np.ones(2), []
        for x, y in zip(reversed(e), reversed(forward), strict=True):
            p.append(min((y * b)[1] / (y * b).sum(), 1 - 1e-9))
            b = f.move @ (b * np.array([1, x]))
            b /= b.sum()
        total, top = -np.log1p(-np.array(p)).sum(), max([1e-6, *p])
        score = 1 / (1 + np.exp(-(f.doc @ np.array([1, np.log(total + 1e-4), np.clip(np.log(top / (1 - top)), -12, 12)]))))
        assert abs(got[r["doc_id"]]["score"] - score) < 1e-6 and got[r["doc_id"]]["predicted"] == (score >= 0.5)


@pytest.fixture(scope="module")
def field():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(900)]
    bad = ["grumbles", "vexite", "vexorro", "snarkful"]
    data = []
    for i in range(700):
        t = [words[k] for k in rng.integers(0, 900, int(rng.integers(20, 90)))]
        if i % 5 == 0:
            for _ in range(4):
                t[int(rng.integers(0, len(t)))] = bad[int(rng.integers(0, 4))]
        data.append((" ".join(t), i % 5 == 0))
    return m.fit(data[:500]), data[500:]


def test_held_out_accuracy_and_offsets(field):
    import pyarrow as pa

    f, rest = field
    scores, spans = m.score_texts(pa.array([t for t, _ in rest]), f)
    assert np.mean((scores >= 0.5) == np.array([y for _, y in rest])) > 0.97
    for (t, y), own in zip(rest, spans, strict=True):
        for s in own if y else ():
            assert t[s["start"] : s["end"]].startswith(("grum", "vex", "snark"))


def test_table(spark, field):
    rows = documents(spark)
    got = m.score(rows, field[0]).collect()
    assert len(got) == rows.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (4, 5, 10)}) == 1
    toxic = spark.createDataFrame([(1, "so vexite and grumbles, snarkful w1 w2"), (2, "w1 w2 w3")], "doc_id long, text string")
    assert [r["doc_id"] for r in m.clean_documents(toxic, field[0]).collect()] == [2]
    assert m.score(empty(spark), field[0]).count() == 0


def test_fit_reads_no_held_out_row(spark):
    ids = [i for i in range(400)]
    docs = spark.createDataFrame([(i, f"plain words {i}" if i % 3 else f"grumbles {i} {'x' * (i % 7)}") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0) if zlib.crc32(str(i).encode()) % 5 else 1) for i in ids] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    other = spark.createDataFrame([(i, 1, int(i % 3 == 0) if zlib.crc32(str(i).encode()) % 5 else 0) for i in ids], "doc_id long, quality int, toxic int")
    a, b = m.fit_on(docs, labels), m.fit_on(docs, other)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.doc, b.doc)


def test_one_class_or_no_labels(spark):
    assert m.fit([]).doc.tolist()[1:] == [0, 0]
    assert m.fit([("a", False)] * 3).doc[0] < 0
    none = m.fit_on(empty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert m.score(documents(spark), none).count() == 12


def test_texts_beyond_the_bound_leave_the_others_in_the_sample(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(5)
    plain = [f"w{i}" for i in range(900)]
    ids = [r["id"] for r in spark.range(600).orderBy(F.xxhash64("id"), "id").collect()]
    texts = {i: rng.choices(plain, k=40) + (["grumbles", "vexite", "snarkful"] if i % 3 == 0 else []) for i in ids}
    sampled = [i for i in ids if zlib.crc32(str(i).encode()) % 5]
    first = {c: next(i for i in sampled if (i % 3 == 0) == c) for c in (True, False)}
    for c, most in ((True, m.MOST_TOXIC_BYTES), (False, m.MOST_CLEAN_BYTES)):
        part = " ".join(rng.choices(plain, k=2000) + ["vexite"] * (200 * c)) + " "
        texts[first[c]] = [part * (most // len(part) + 2)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in ids], "doc_id long, quality int, toxic int")
    got = m.score(docs, m.fit_on(docs, labels)).where("held_out").collect()
    assert len(got) > 80 and np.mean([r["predicted"] == (r["doc_id"] % 3 == 0) for r in got]) > 0.97


def test_excerpts_are_bounded_and_of_whole_words():
    text = " ".join(f"wörd{i}" for i in range(5000))
    whole = set(text.split())
    for most in (100, 2048, 30_000):
        cut = m._excerpt(text.encode(), most)
        assert most / 2 < len(cut) <= most and set(cut.decode().split()) <= whole
    assert m._excerpt(text.encode(), 1 << 20) == text.encode()
    assert len(m._excerpt(("é" * 9000).encode(), 3001).decode()) > 1000


def test_driver_fits_nothing(spark, sf, monkeypatch):
    """The fit's memory is a worker's; its field is that of the same rows in one process."""
    import os

    own, here = m.fit, os.getpid()
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    toxic = {r["doc_id"]: bool(r["toxic"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in toxic)
    want = own([(t, toxic[d]) for d, t in rows], (sum(not y for y in toxic.values()), sum(toxic.values())))

    def elsewhere(labelled, totals=None):
        assert os.getpid() != here
        return own(labelled, totals)

    monkeypatch.setattr(m, "fit", elsewhere)
    got = m.fit_on(docs, labels)
    assert np.allclose(got.weights, want.weights) and np.allclose(got.move, want.move) and np.allclose(got.doc, want.doc)
