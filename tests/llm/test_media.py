import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import media

from .helpers import ROWS, documents, empty


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (4, 7, 3), (2, 3, 4)])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_netpbm_round_trip(shape, kind):
    image = np.random.default_rng(1).integers(0, np.iinfo(kind).max, shape).astype(kind)
    assert np.array_equal(media.decode(media.encode_netpbm(image)), image)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.booleans(), st.integers(0, 99))
def test_bmp_round_trip(h, w, colour, seed):
    image = np.random.default_rng(seed).integers(0, 256, (h, w, 3) if colour else (h, w)).astype(np.uint8)
    assert np.array_equal(media.decode(media.encode_bmp(image)), image)


def test_plain_and_bitmap_kinds():
    assert media.decode(b"P1 # c\n3 2\n101\n010").tolist() == [[1, 0, 1], [0, 1, 0]]
    assert media.decode(b"P2\n2 1\n255\n7 # x\n 9").tolist() == [[7, 9]]
    assert media.decode(b"P3\n1 1\n255\n1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[1, 0, 1]]


@pytest.mark.parametrize("bad", [b"P9", b"P5\n2 2\n255\n\0", b"P5\n0 1\n255\n", b"BM", b"P2\n1 1\n255\n300", b"P5\nx", b"BM" + b"\0" * 60])
def test_broken_files_are_errors(bad):
    with pytest.raises(media.MediaError):
        media.decode(bad)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(1, 9), st.integers(1, 9))
def test_area_resize_equals_brute_force(h, w, th, tw):
    image = np.random.default_rng(h * 100 + w).integers(0, 256, (h, w)).astype(np.uint8)
    fine = np.kron(image.astype(float), np.ones((th, tw)))  # each target pixel covers h x w fine ones
    brute = fine.reshape(th, h, tw, w).mean((1, 3))
    assert np.allclose(media.area_resize(image, th, tw), brute)
    assert np.array_equal(media.area_resize(image, th, tw, 3), media.area_resize(image, th, tw))
    colour = np.stack([image, image // 2, 255 - image], 2)
    assert np.allclose(media.area_resize(colour, th, tw, 5)[:, :, 0], brute)


def brute_hash(payload):
    """The difference hash of a payload's image, by fine copies of every sample and fractions."""
    from fractions import Fraction as Q

    image = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    h = len(image)
    column = [[sum(int(image[y, x]) * max(Q(0), min(Q(x + 1), Q(64 * (j + 1), 9)) - max(Q(x), Q(64 * j, 9))) for x in range(64)) for j in range(9)] for y in range(h)]
    cell = [[sum(column[y][j] * max(Q(0), min(Q(y + 1), Q(h * (i + 1), 8)) - max(Q(y), Q(h * i, 8))) for y in range(h)) for j in range(9)] for i in range(8)]
    return np.packbits([cell[i][j + 1] > cell[i][j] for i in range(8) for j in range(8)]).tobytes().hex()


def test_registered_features_equal_brute_force(spark, sf):
    from weftline.llm.queries import op1_media

    want = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op1_media(spark, sf).collect()
    assert len(got) == len(want)
    for r in got[:25]:
        b = (want[r["doc_id"]] or "").encode()
        if len(b) < 4000:
            assert r["feature"] == brute_hash(b + bytes(-len(b) % 64 or 64 * (not b)))


@pytest.mark.parametrize("form", ["pgm", "bmp"])
def test_stored_texts_as_resized_tiles(spark, form):
    import io

    stored = media.text_media(documents(spark).where("doc_id in (1, 5, 6)"), form)
    whole = media.decode_tiles(stored, "doc_id", "media", side=64).collect()
    for i, text in ((1, ROWS[0][1]), (5, ""), (6, ROWS[6][1])):
        parts = sorted((r for r in whole if r["media_id"] == i), key=lambda r: r["tile_row"])
        back = b"".join(np.load(io.BytesIO(r["npy"])).tobytes() for r in parts)
        assert back.rstrip(b"\0").decode() == text and len(back) % 64 == 0
    small = media.decode_tiles(stored, "doc_id", "media", 16, 18, side=8).collect()
    assert {(r["tile_row"], r["tile_col"]) for r in small if r["media_id"] == 6} == {(y, x) for y in range(2) for x in range(3)}
    assert all(r["tile_dhash"] == media.difference_hash(np.load(io.BytesIO(r["npy"]))) for r in small)


def test_stored_features(spark):
    got = media.stored_features(documents(spark)).collect()
    want = []
    for r in ROWS:
        b = (r[1] or "").encode()
        p = b + bytes(-len(b) % 64 or (64 if not b else 0))
        pgm = b"P5\n64 %d\n255\n" % (len(p) // 64) + p
        want.append((r[0], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(pgm), hashlib.sha256(pgm).hexdigest()))
    key = lambda x: tuple(str(v) for v in x)
    assert sorted((tuple(r[:7]) for r in got), key=key) == sorted(want, key=key)
    assert len({r["feature"] for r in got if r["payload_bytes"] == 64 and r["n_bytes"] == 0}) == 1
    assert media.stored_features(empty(spark)).count() == 0


def test_tiles_and_errors(spark):
    image = np.arange(30 * 40, dtype=np.uint8).reshape(30, 40)
    rows = [(1, media.encode_netpbm(image)), (2, b"junk"), (3, None), (4, media.encode_bmp(image))]
    got = media.decode_tiles(spark.createDataFrame(rows, "id long, data binary"), "id", "data", side=16).collect()
    assert {r["media_id"] for r in got if r["error"]} == {2, 3}
    import io

    for k in (1, 4):
        back = np.zeros_like(image)
        for r in got:
            if r["media_id"] == k:
                t = np.load(io.BytesIO(r["npy"]))
                back[r["tile_row"] * 16 :, r["tile_col"] * 16 :][: t.shape[0], : t.shape[1]] = t
        assert np.array_equal(back, image)
    small = media.decode_tiles(spark.createDataFrame(rows[:1], "id long, data binary"), "id", "data", 8, 9).collect()
    assert (small[0]["height"], small[0]["width"]) == (8, 9)
