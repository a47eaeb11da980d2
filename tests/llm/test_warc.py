import base64
import hashlib
import io

import pytest

from weftline.llm import warc

PAGES = [
    (5, "http://a/\r\nX: y", "<p>same</p>", "z"), (2, "http://b/", "<p>same</p>", "z"), (9, None, "<p>same</p>", "z"), (3, "http://c/é", None, "z"), (4, "", "", "z"),
    (6, "u", "\r\n\r\nWARC/1.1\r\n", "z"), (2, "http://b/", "<p>same</p>", "z"), (None, "n", "only", "z"), (8, "big", "x" * (3 * warc.CHUNK + 7), "z"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def frame(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string")


def test_round_trip(spark):
    got = warc.archived(frame(spark)).collect()
    want = []
    for page, _, html, _ in PAGES:
        same = [p for p, _, h, _ in PAGES if (h or "") == (html or "") and p is not None]
        head = min(same) if same else None
        n = len((html or "").encode())
        want.append((page, n, digest(html), "response" if head == page else "revisit", None if head == page else head))
    key = lambda x: tuple(str(v) for v in x)
    assert sorted((tuple(r[:5]) for r in got), key=key) == sorted(want, key=key)
    assert {r["page_id"]: r["chunks"] for r in got}[8] == 4


def test_chunks_join_to_payloads(spark, tmp_path):
    archives = warc.write_archives(frame(spark), f"file://{tmp_path}/w")
    rows = warc.chunk_table(archives).where("page_id = 8").orderBy("chunk_no").collect()
    sha = hashlib.sha1()
    for i, r in enumerate(rows):
        sha.update(r["data"])
        assert (r["chunk_no"], r["digest_so_far"], r["last"]) == (i, base64.b32encode(sha.digest()).decode(), i == 3)
    assert b"".join(bytes(r["data"]) for r in rows).decode() == PAGES[-1][2]


def test_small_payloads_are_never_revisited(spark):
    got = warc.archived(frame(spark), min_revisit=12).collect()
    assert all(r["record_type"] == "response" for r in got)


def test_damage_is_found():
    out = io.BytesIO()
    warc.write_record(out, 1, "u", b"abc", digest("abd"))
    with pytest.raises(ValueError, match="damaged"):
        list(warc.read_chunks(io.BytesIO(out.getvalue())))
    with pytest.raises(ValueError):
        list(warc.read_chunks(io.BytesIO(out.getvalue()[:40])))


def test_empty_table(spark):
    assert warc.archived(frame(spark, [])).count() == 0


def test_headers_of_any_length(spark):
    rows = [(1, "http://h/" + "a" * 1_200_000, "x"), (2, "http://h/" + "é" * 70_000, "y"), (3, "u", "x")]
    got = sorted(tuple(r)[:1] + tuple(r)[3:5] for r in warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(1, "response", None), (2, "response", None), (3, "revisit", 1)]


def test_marks_that_blocks_split():
    class Source:
        def __init__(self, parts):
            self.parts = parts

        def read(self, n):
            return self.parts.pop(0) if self.parts else b""

    lines = warc._Lines(Source([b"ab\r", b"\n\r", b"\ncd", b"\r\n\r\n"]))
    assert [lines.until(b"\r\n\r\n") for _ in range(3)] == [b"ab", b"cd", None]
