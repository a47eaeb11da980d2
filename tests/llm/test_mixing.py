import re
from collections import Counter, defaultdict

import pytest

from weftline.llm import mixing as m

from .helpers import documents, empty


def level(sizes, weights, share=1.5, most=2.0):
    """Resharing done step by step, in fractions."""
    from fractions import Fraction as Q

    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, goal, free = Q(share) * sum(sizes.values()), {}, set(names)
    while True:
        total = sum(w[s] for s in free)
        over = {s for s in free if total and left * w[s] / total > Q(most) * sizes[s]}
        if not over:
            return goal | {s: left * w[s] / total for s in free}
        for s in over:
            goal[s] = Q(most) * sizes[s]
            left -= goal[s]
        free -= over


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_targets_and_taken(spark, block):
    df = documents(spark)
    rows = df.collect()
    got = m.mixed_documents(df, block=block).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((r["doc_id"], r["source"], words(r["text"])) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += words(r["text"])
    want, took = level(sizes, m.WEIGHTS), defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        took[r["source"]] += r["taken"]
    assert all(abs(took[s] - want[s]) <= 0.5 for s in want)
    assert sorted(map(str, got)) == sorted(map(str, m.mixed_documents(df.repartition(3), block=block).collect()))


def test_schedule_is_complete_and_even(spark):
    goals = spark.createDataFrame([("=a", 5000), ("=b", 1000), ("-", 3), ("=z", 0)], "source_key string, goal long")
    plan = m.schedule(goals, 10).orderBy("slot").collect()
    assert Counter(r["source_key"] for r in plan) == {"=a": 500, "=b": 100, "-": 1}
    assert len({r["slot"] for r in plan}) == 601 and sorted(r["block_no"] for r in plan if r["source_key"] == "=b") == list(range(100))
    n = 0
    for i, r in enumerate(plan[:600], 1):
        n += r["source_key"] == "=a"
        assert abs(n - i * 500 / 601) < 6


def test_mixed_texts(spark):
    df = documents(spark)
    out = m.mixed_texts(df)
    assert out.columns == df.columns
    per = {r["doc_id"]: r["taken"] for r in m.mixed_documents(df).collect() if r["doc_id"] != 3}
    got = defaultdict(int)
    for r in out.collect():
        got[r["doc_id"]] += words(r["text"])
    assert all(got[k] == v for k, v in per.items())


def test_clashing_names_and_repeated_rows_pass(spark):
    names = ["doc_id", "text", "source", "a.b", "row", "slot", "size", "row_hash", "_a"]
    rows = [(i % 3, f"word{i % 3} and more", "s", {"k": i % 3}, 1, 2, 3, 4, 5) for i in range(9)] + [(9, "x y z", None, None, 1, 2, 3, 4, 5)]
    out = m.mixed_texts(spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` map<string, int>, row int, slot int, size int, row_hash int, _a int"))
    assert out.columns == names
    got = out.collect()
    assert all(tuple(r)[4:] == (1, 2, 3, 4, 5) for r in got)
    assert all(r["a.b"] == ({"k": r["doc_id"]} if r["doc_id"] != 9 else None) for r in got)
    assert abs(sum(words(r["text"]) for r in got) - 1.5 * 30) <= 1


def test_empty_tables(spark):
    assert m.mixed_documents(empty(spark)).count() == 0
    assert m.mixed_texts(empty(spark)).count() == 0
    none = documents(spark).where("doc_id in (4, 5, 10)")
    assert [r["taken"] for r in m.mixed_documents(none).collect()] == [0, 0, 0]


def test_rows_follow_the_schedule(spark, monkeypatch):
    from hashlib import md5
    from itertools import accumulate
    from math import ceil, floor

    monkeypatch.setattr(m, "SLOTS_PER_PART", 16)
    rows = [(i, " ".join(f"w{k}" for k in range(1 + i * 7 % 90)), "abcc"[i % 4]) for i in range(240)]
    block = 64
    # blocks of each source, and the slots that golden-ratio points give them
    sizes = Counter()
    for _, t, c in rows:
        sizes[c] += words(t)
    goal = {c: floor(g + 0.5) for c, g in level(dict(sizes), m.WEIGHTS).items()}
    names = sorted(goal)
    need = {c: ceil(goal[c] / block) for c in names}
    total, high = sum(need.values()), list(accumulate(need[c] for c in names))
    slot, had = {}, Counter()
    for s in range(total):
        u = (s + 1) * m.GOLDEN % 1
        c = next(c for c, h in zip(names, high, strict=True) if u < h / total)
        if had[c] < need[c]:
            slot[c, had[c]] = s
        had[c] += 1
    lack = sorted((b, c) for c in names for b in range(had[c], need[c]))
    slot |= {(c, b): total + i for i, (b, c) in enumerate(lack)}
    want, first = [], {}
    for c in names:
        at = 0
        for i, n in sorted(((i, words(t)) for i, t, s in rows if s == c), key=lambda r: md5(str(r[0]).encode()).hexdigest()):
            for p in (0, 1):
                a = at + p * sizes[c]
                z = min(a + n, goal[c])
                if z > a:
                    want.append((slot[c, a // block], p, at, i, z - a))
                    first[i] = min(first.get(i, 10**9), *(slot[c, b] for b in range(a // block, (z - 1) // block + 1)))
            at += n
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = m.mixed_texts(df, block=block)
    assert out.rdd.getNumPartitions() > 2
    assert [(r["doc_id"], words(r["text"])) for r in out.collect()] == [r[3:] for r in sorted(want)]
    assert {r["doc_id"]: r["first_slot"] for r in m.mixed_documents(df, block=block).collect() if r["taken"]} == first
