import hashlib
from collections import defaultdict

import numpy as np
import pytest

from weftline.llm import line_dedup as m

from .helpers import documents, empty


def brute(rows, least=20, docs=3):
    where = defaultdict(set)
    strip = " \t\n\x0b\x0c\r"
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    key = lambda x: lower(x.strip(strip))
    ids = [-(2**63) if d is None else d for d, _ in rows]
    for d, (_, t) in zip(ids, rows, strict=True):
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                where[key(x)].add(d)
    out = []
    for d, (real, t) in zip(ids, rows, strict=True):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(where[key(x)]) >= docs and d != max(where[key(x)]))]
        out.append((real, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [m.MOST_KEYS, -1])
def test_awkward_rows(spark, most):
    df = documents(spark)
    got = sorted((tuple(r) for r in m.drop_repeated_lines(df, digest=True, most_keys=most).collect()), key=str)
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert got == want and sum(r[2] for r in want) == 2


@pytest.mark.parametrize("most", [m.MOST_KEYS, -1])
def test_random_lines(spark, most):
    rng = np.random.default_rng(1)
    pool = [f"{'é' * (i % 7)} Line number {i} " + "z" * (i % 23) for i in range(60)]
    rows = [(int(rng.integers(0, 150)) if i % 40 else None, "\n".join(pool[k] + " " * int(rng.integers(0, 2)) for k in rng.integers(0, 60, int(rng.integers(0, 9))))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in m.drop_repeated_lines(df, digest=True, most_keys=most).collect()), key=str)
    assert got == brute(rows)


def test_texts_and_carried_columns(spark):
    out = m.drop_repeated_lines(documents(spark), carry=["doc_id", "size", "key", "source"])
    assert out.columns == ["doc_id", "size", "key", "source", "n_lines", "n_dropped", "kept_text"]
    assert {r["kept_text"] for r in out.where("doc_id = 1").collect()} == {"Alpha beta gamma delta epsilon zeta eta theta.\nend one"}


def test_filters_never_lose_a_pair(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(m, "HELD_KEYS", 50)
    rng = np.random.default_rng(2)
    parts = [[set(rng.integers(0, 3000, 40).tolist()) for _ in range(20)] for _ in range(6)]
    line = lambda k: f"a line of some length, number {k}"
    sent = []
    for docs in parts:
        batch = pa.RecordBatch.from_arrays([pa.array(["\n".join(map(line, d)) for d in docs])], names=["text"])
        sent += [r for b in m._sent(32, 20)(iter([batch])) for r in b.to_pylist()]
    rows = pa.RecordBatch.from_pylist(sorted(sent, key=lambda r: r["range"]))
    bits = 1 << 17
    shards = [r for b in m._met_again(1 << 16, bits, m.SHARD_BITS)(iter([rows])) for r in b.to_pylist()]
    shards = pa.RecordBatch.from_pylist(sorted(shards, key=lambda r: r["shard"]))
    whole = np.concatenate([np.frombuffer(r["bits"], np.uint8) for b in m._joined_shards(m.SHARD_BITS)(iter([shards])) for r in b.to_pylist()])
    assert len(whole) == bits // 8
    seen = lambda k: m._has(whole, m._slots(m._hashes([m._digest(line(k).encode())]), bits, m.TWICE_SLOTS))[0]
    count = [sum(k in d for docs in parts for d in docs) for k in range(3000)]
    assert all(seen(k) for k in range(3000) if count[k] > 1)
    once = [k for k in range(3000) if count[k] == 1]
    assert sum(map(seen, once)) < 0.1 * len(once)


def test_many_ranges_and_a_full_filter(spark, monkeypatch):
    """The plan of a large corpus: many ranges, and a second filter so full that it suspects nearly all."""
    monkeypatch.setattr(m, "RANGE_KEYS", 1)
    monkeypatch.setattr(m, "SHARD_BITS", 1 << 6)
    monkeypatch.setattr(m, "MOST_BITS", 1 << 7)
    rows = [(i, "\n".join(f"this is line number {(i * 7 + k) % 400}" for k in range(5))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in m.drop_repeated_lines(df, digest=True).collect()), key=str)
    assert got == brute(rows)


def test_clashing_names(spark):
    names = ["doc_id", "a.b", "text", "kept_text", "n_lines", "lost", "c0"]
    line = "a line that many documents share"
    df = spark.createDataFrame([(i, i, f"{line}\nown {i}", "k", 1, 2, 3) for i in range(4)], names)
    for most in (m.MOST_KEYS, -1):
        got = m.without_repeated_lines(df, most_keys=most)
        assert got.columns == names
        assert sorted(map(tuple, got.collect())) == [(i, i, f"own {i}" if i < 3 else f"{line}\nown 3", "k", 1, 2, 3) for i in range(4)]


def test_empty_table(spark):
    assert m.drop_repeated_lines(empty(spark)).count() == 0
