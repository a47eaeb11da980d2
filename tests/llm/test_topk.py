import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import topk as m


def brute(rows, k=10, every=100):
    good = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(q, d, strict=False)), j) for j, d in good if j != i)[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def run(spark, rows, k=10, every=100, **o):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string")
    v = m.integer_vectors(df, "vec_id", "embedding")
    return sorted(tuple(r) for r in m.top_k(v, v.where(F.col("id") % every == 0), k, **o).collect())


def rows_of(n, seed, dims=5):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=dims)]) for i in range(n)]
    rows += [(n, None), (n + 1, [1.0, None, 0.0, 0.0, 0.0]), (n + 2, [float("nan")] * dims), (n + 3, [float("inf")] * dims), (None, [1.0] * dims)]
    rows += [(n + 4 + i, rows[3][1]) for i in range(5)] + [(n + 20, [0.5, 2.0])]  # ties, and a shorter vector
    return rows


@pytest.mark.parametrize("chunk", [m.CHUNK_BYTES, 64])
def test_equals_brute_force(spark, chunk):
    rows = rows_of(300, 1)
    assert run(spark, [(*r, "x") for r in rows], every=50, chunk_bytes=chunk) == brute(rows, every=50)


def test_many_blocks_and_large_weights():
    rng = np.random.default_rng(5)
    blocks = [(np.arange(a, a + 16), rng.integers(-(2**28), 2**28, (16, 6)) * (1 + a // 64)) for a in range(0, 256, 16)]
    q = rng.integers(-(2**28), 2**28, (7, 6))
    own = np.array([3, 17, 40, 99, 1000, 1001, 5])
    best, _ = m.search(q, own, np.full(7, np.iinfo(np.int64).min), blocks, 4)
    for i in range(7):
        every = sorted((-int(sum(int(a) * int(b) for a, b in zip(q[i], v, strict=True))), int(j)) for ids, d in blocks for j, v in zip(ids, d, strict=True) if j != own[i])
        got = [(-int(s), int(j)) for qi, s, j in zip(best.q, best.score, best.id, strict=True) if qi == i]
        assert got == every[:4]


def test_bounds_are_never_too_low():
    rng = np.random.default_rng(2)
    d, q = rng.integers(-999, 999, (50, 8)), rng.integers(-999, 999, (20, 8))
    b = m.bounds(q, d.max(0)[None], d.min(0)[None])
    assert (b[:, 0] >= m.products(q, d).max(1)).all()


def test_few_and_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], "x")]) == []
    assert run(spark, [(0, [1.0], "x"), (1, [2.0], "x"), (100, [1.0], "x")]) == [(0, 1, 1, 2 * 1024**2), (0, 2, 100, 1024**2), (100, 1, 1, 2 * 1024**2), (100, 2, 0, 1024**2)]


def test_blocks_of_clustered_vectors_are_pruned(spark):
    """Sparse vectors of few terms: most blocks are never scored, and the best are those of brute force."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(4000):
        v = np.zeros(300, np.int64)
        v[(i * 7 % 60) * 5 + rng.integers(0, 5, 3)] = rng.integers(1, 1000, 3)
        rows.append((i, v.tolist()))
    df = spark.createDataFrame(rows, "id long, v array<long>").repartition(2)
    queries = df.where("id % 400 = 0")
    d = np.array([v for _, v in rows])
    got = {}
    for r in m.top_k(df, queries, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for i in range(0, 4000, 400):
        score = d @ d[i]
        best = sorted((-int(x), j) for j, x in enumerate(score) if j != i)[:5]
        assert got[i] == [(j, -x) for x, j in best]
    seen = m.pruning(df, queries, 5).collect()
    assert len(seen) == 10 and sum(r["scored"] for r in seen) < 0.3 * sum(r["blocks"] for r in seen)


def test_bounds_hold_where_huge_terms_cancel():
    big = 2**52
    q = np.array([[big, -big, 1]])
    d = np.array([[big, big, 7], [big - 1, big - 1, 9]])
    b = m.bounds(q, d.max(0)[None], d.min(0)[None])
    assert b[0, 0] >= max(int(q[0, 0]) * int(x) + int(q[0, 1]) * int(y) + int(z) for x, y, z in d)
