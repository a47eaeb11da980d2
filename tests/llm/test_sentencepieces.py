import hashlib
import io
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import sentencepieces as m
from weftline.llm.common import mix64, texts

from .helpers import ROWS, documents, empty


@pytest.fixture(scope="module")
def pieces():
    with open(m.MODEL, "rb") as f:
        return m.Pieces(f.read())


def lattice(p, text):
    """Every segmentation and its probability, by recursion."""
    b, out = b" " + text.encode(), []
    spelled = {s: i for i, s in enumerate(p.spelling) if s and i not in set(p.byte_id.tolist())}

    def go(at, ids, lp):
        if at == len(b):
            out.append((tuple(ids), lp))
            return
        wide = 1 if b[at] < 0x80 else 2 if b[at] < 0xE0 else 3 if b[at] < 0xF0 else 4
        for n in range(1, len(b) - at + 1):
            i = spelled.get(b[at : at + n])
            if i is not None:
                go(at + n, [*ids, i], lp + p.weight[i])
        if b[at : at + wide] not in spelled:
            go(at + wide, [*ids, *(int(p.byte_id[x]) for x in b[at : at + wide])], lp + wide * p.byte_weight)

    go(0, [], 0.0)
    z = np.logaddexp.reduce([x[1] for x in out])
    return {ids: float(np.exp(lp - z)) for ids, lp in out}


def draw(p, text, n, k):
    data, off = texts(pa.array([text] * n, pa.string()))
    s = m.Samples(m.Slice(data, off, p), mix64(np.arange(n, dtype=np.uint64)), k)
    rows = []
    for i in range(len(s.found)):
        ids, at = s.ids(i)
        rows.append([tuple(ids[at[r] : at[r + 1]].tolist()) if not np.isneginf(s.gumbel[i][r]) else None for r in range(n)])
    return s, rows


@pytest.mark.parametrize("text", ["the cat", "a\nb 日é", "  x", "aaaa"])
def test_samples_follow_the_lattice(pieces, text):
    want, n, k = lattice(pieces, text), 4000, 3
    s, rows = draw(pieces, text, n, k)
    for i, r in enumerate(rows):
        assert all(abs(s.log_p[i][j] - np.log(want[x])) < 1e-6 for j, x in enumerate(r) if x is not None)
    first = Counter(rows[0])
    assert all(abs(first[x] / n - q) < 0.04 for x, q in want.items())
    assert all(len({r[j] for r in rows if r[j] is not None}) == min(k, len(want)) for j in range(n))
    # inclusion weights estimate the total probability
    e = np.mean([sum(np.exp(s.log_p[i][j] - s.log_inclusion(i)[j]) for i in range(len(rows)) if rows[i][j] is not None) for j in range(n)])
    assert abs(e - 1) < 0.1


def test_second_sample_is_without_replacement(pieces):
    want = lattice(pieces, "the cat")
    _, rows = draw(pieces, "the cat", 6000, 2)
    top = max(want, key=want.get)
    second = Counter(b for a, b in zip(*rows, strict=True) if a == top)
    n = sum(second.values())
    assert all(abs(second[x] / n - q / (1 - want[top])) < 0.05 for x, q in want.items() if x != top)


def test_exhausted_texts(pieces):
    want = lattice(pieces, "日")
    s, rows = draw(pieces, "日", 50, 10)
    assert all(len([1 for r in rows if r[j] is not None]) == len(want) for j in range(50))
    assert np.allclose(s.log_inclusion(0), 0)


def test_query_rows(spark, pieces):
    df = documents(spark)
    out = m.sample(df, k=3, carry=("size",), ids=True)
    got = out.collect()
    assert len(got) == len(ROWS) and all(r["round_trip"] for r in got)
    text = {r[0]: (r[1] or "").replace("▁", " ") for r in ROWS}
    assert {r["doc_id"]: r["text"] for r in m.decode(out, "doc_id").collect()} == text
    assert all(r["n_samples"] == 1 and r["n_pieces"] == [0] for r in got if r["doc_id"] in (4, 5))
    assert all(len(set(r["ids_sha256"])) == r["n_samples"] for r in got)
    again = m.sample(df.repartition(5), k=3, carry=("size",), ids=True).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert m.sample(empty(spark)).count() == 0


def test_best_encoding_decodes(spark):
    df = documents(spark).where("doc_id in (1, 3)").dropDuplicates(["doc_id"])
    back = {r["doc_id"]: r["text"] for r in m.decode(m.encode_best(df), "doc_id").collect()}
    assert back == {r["doc_id"]: r["text"] for r in df.collect()}


@pytest.mark.parametrize("power", [1.0, 3.0, 6.0])
def test_no_segmentation_is_too_unlikely(power):
    with open(m.MODEL, "rb") as f:
        p = m.Pieces(f.read(), power)
    for text in ("a\nb 日é", "  x", "aaaa", "the cat"):
        want = lattice(p, text)
        s, rows = draw(p, text, 5, len(want) + 3)
        assert all({r[j] for r in rows if r[j] is not None} == set(want) for j in range(5))
        assert all(abs(s.log_p[i][0] - np.log(want[r[0]])) < 1e-6 for i, r in enumerate(rows) if r[0] is not None)


def test_query_gives_all_ids(spark, pieces):
    from weftline.llm.queries import op7_sentencepieces

    at = "/root/testdata/sf0.001"
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    got = op7_sentencepieces(spark, at).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    for r in got:
        assert len(r["samples"]) == r["n_samples"] and [len(x) for x in r["samples"]] == r["n_pieces"]
        for ids, digest in zip(r["samples"], r["ids_sha256"], strict=True):
            assert hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest() == digest
            assert b"".join(pieces.spelling[i] for i in ids).decode() == (" " + text[r["doc_id"]] if text[r["doc_id"]] else "")


def test_ids_of_rows_with_few_samples(spark):
    got = m.sample(documents(spark), k=40, ids=True, each=True).collect()
    assert {r["n_samples"] for r in got} > {1, 40}
    assert all([len(x) for x in r["samples"]] == r["n_pieces"] and r["samples"][0] == r["pieces"] for r in got)


@pytest.mark.parametrize("spells", [False, True])
def test_other_models_normalise_as_they_do(spark, tmp_path, spells):
    import sentencepiece

    words = "the cat sat on the mat and the dog ate the fat rat at ten then ran".split()
    lines = [" ".join(words[(i * j) % len(words)] for j in range(1, 8)) for i in range(1, 200)]
    made = io.BytesIO()
    own = {"byte_fallback": True, "add_dummy_prefix": False} if spells else {}
    sentencepiece.SentencePieceTrainer.train(
        sentence_iterator=iter(lines), model_writer=made, model_type="unigram", vocab_size=330 if spells else 50, hard_vocab_limit=False, pad_id=0, unk_id=2, bos_id=-1, eos_id=1, user_defined_symbols=["<sep>"], minloglevel=2, **own
    )
    at = tmp_path / "unigram.model"
    at.write_bytes(made.getvalue())
    sp = sentencepiece.SentencePieceProcessor(model_proto=made.getvalue())
    data = ["  ｔｈｅ   cat ", "the 日本 rat", "the<sep>cat", " \t ", "日", "fat mat 日x日"]
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    out = m.sample(df, k=512, ids=True, each=True, model=str(at)).cache()
    for r in out.collect():
        text = data[r["doc_id"]]
        assert {tuple(x) for x in r["samples"]} == {tuple(x) for x in sp.nbest_encode(text, nbest_size=512)} | ({()} if not sp.encode(text) else set())
        assert r["round_trip"] == all(sp.unk_id() not in x for x in r["samples"])
        best = r["samples"][int(np.argmax(r["log_prob"]))]
        assert best == sp.encode(text)
    back = {r["doc_id"]: r["text"] for r in m.decode(out, "doc_id", model=str(at)).collect()}
    assert all(back[r["doc_id"]] == sp.decode(r["pieces"]) for r in out.collect())


def test_bytes_that_are_no_text(spark):
    df = spark.range(3).selectExpr("id AS doc_id", "cast(X'61FF62' AS string) AS text")
    assert [(r["round_trip"], r["n_samples"]) for r in m.sample(df).collect()] == [(True, 2)] * 3


def test_stretches_whose_hashes_clash(spark):
    a = "".join("ab"[i.bit_count() & 1] for i in range(1024))  # no hash by powers modulo 2**64 tells this sequence from its mirror
    b = a.translate({97: 98, 98: 97})
    alone = {r["doc_id"]: r["ids_sha256"] for t in ((0, a), (1, b)) for r in m.sample(spark.createDataFrame([t], "doc_id long, text string")).collect()}
    got = m.sample(spark.createDataFrame([(0, a), (1, b)], "doc_id long, text string").coalesce(1)).collect()
    assert all(r["round_trip"] and r["ids_sha256"] == alone[r["doc_id"]] for r in got)


def test_shared_stretches_are_worked_once(pieces, monkeypatch):
    """Texts that share their stretches cost a sample's steps, not transcendental functions of every piece."""
    text, n = "The committee adopted its report on the 12th, in thirteen chapters and three annexes. " * 4, 200
    data, off = texts(pa.array([text] * n, pa.string()))
    s, done = m.Slice(data, off, pieces), Counter()

    class Counting:
        def __getattr__(self, name):
            f = getattr(np, name)
            if name not in ("expm1", "logaddexp"):
                return f

            def counted(x, *rest, **options):
                done[name] += np.size(x)
                return f(x, *rest, **options)

            counted.reduce = getattr(f, "reduce", None)
            return counted

    monkeypatch.setattr(m, "np", Counting())
    found = m.Samples(s, mix64(np.arange(n, dtype=np.uint64)), 2)
    edges = len(s.lattice.dst)
    assert sum(len(x[0]) for x in found.found) > 50 * edges
    assert done["expm1"] <= edges and done["logaddexp"] <= int(s.lattice.deg.max()) * edges


def test_shares_of_other_pieces(pieces):
    for text in ("the cat sat", "a\nb 日é", "aaaa" * 40, "x" * 700 + " y" * 300):
        t = m.Slice(*texts(pa.array([text], pa.string())), pieces).lattice
        edge = np.arange(len(t.dst))
        for part in (edge[::3], edge):  # known ones are given again
            got = t.others(part)
            for e, x in zip(part.tolist(), got.tolist(), strict=True):
                a = int(t.ptr[t.src[e]])
                rest = [q for i, q in enumerate(t.log_q[a : a + int(t.deg[t.src[e]])].tolist(), a) if i != e]
                assert x == -np.inf if not rest else abs(x - np.logaddexp.reduce(rest)) < 1e-9
        starts = t.ptr[np.unique(t.src)]
        assert np.allclose(np.logaddexp.reduceat(t.log_q, np.sort(starts)), 0, atol=1e-9)
