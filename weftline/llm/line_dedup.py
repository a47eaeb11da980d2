"""Line deduplication with two Bloom filters.

Line keys are partitioned by hash range.  Tasks send the distinct hashes of their
lines to the ranges; each range passes them through a filter of hashes seen once, and
those met again go into a filter of hashes seen twice.  The ranges' second filters
fold into one of bounded size.  Only lines that it suspects are shuffled as (digest,
document); exact counts confirm them and choose the document that keeps the line.

A line's key is the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z
lower-cased.  Keys of at least ``min_chars`` code points that occur in at least
``min_docs`` documents (at least 2) lose all their lines except in the largest doc_id that
holds them.  Defined cases: a null or empty text is one empty line; a null doc_id
counts as one document that precedes all others; rows that repeat a doc_id are the
same document; an empty table gives an empty result.

Scale: the number of ranges follows the bytes of text, so a range's first filter stays
near ``RANGE_KEYS`` keys; hashes are 8 bytes a distinct line and task.  The second
filter has at most ``MOST_BITS`` (32 MB), which bounds the broadcast; it holds repeated
lines alone.  Where more than about 30 million different lines repeat, it suspects more
lines, and more digests are shuffled, with the same result.  Confirmed keys are
broadcast only if there are at most ``MOST_KEYS`` (20 MB), else they are joined by
document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, mix64, saved, sliced, texts

MOST_BITS = 1 << 28
MOST_KEYS = 800_000
SHARD_BITS = 1 << 16
#: Keys that one range should hold, the fewest and the most ranges.
RANGE_KEYS, RANGES = 1 << 21, (32, 1 << 16)
#: Hashes that a task holds before it sends them.
HELD_KEYS = 1 << 20
ONCE_SLOTS, TWICE_SLOTS = 4, 3
_STRIP = b" \t\n\x0b\x0c\r"


def key_of(line: bytes) -> bytes:
    """The key of a line in UTF-8; ``bytes.lower`` changes A-Z only."""
    return line.strip(_STRIP).lower()


def _long_enough(key: bytes, least: int) -> bool:
    n = len(key)
    return n >= least and (n >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _document_digests(text: bytes, least: int) -> set[bytes]:
    """Digests of the distinct long keys of a text."""
    found = {key_of(x) for x in text.split(b"\n") if len(x) >= least}
    return {_digest(k) for k in found if _long_enough(k, least)}


def _documents(batch: pa.RecordBatch) -> Iterator[bytes]:
    data, off = texts(batch.column(batch.schema.get_field_index("text")))
    raw = data.tobytes()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        yield raw[a:b]


def _hashes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8")[::2]


def _slots(h: np.ndarray, bits: int, n: int) -> list[np.ndarray]:
    """Positions of each hash in a filter."""
    return [(mix64(h ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1)) & np.uint64(bits - 1)).astype(np.int64) for i in range(n)]


def _set(bitmap: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))


def _has(bitmap: np.ndarray, slots: list[np.ndarray]) -> np.ndarray:
    out = np.ones(len(slots[0]), bool)
    for at in slots:
        out &= (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return out


def _power(n: float, least: int, most: int) -> int:
    """The power of two from n on, within bounds."""
    return min(most, max(least, 1 << (max(int(n), 1) - 1).bit_length()))


def _sent(ranges: int, least: int):
    """range, once, twice: packed hashes of keys that a task's documents hold, and of those that two of them do."""
    shift = np.uint64(64 - ranges.bit_length() + 1)

    def flush(found: list[bytes]) -> Iterator[pa.RecordBatch]:
        unique, counts = np.unique(_hashes(found), return_counts=True)
        part = (unique >> shift).astype(np.int64) if ranges > 1 else np.zeros(len(unique), np.int64)
        cut = np.searchsorted(part, np.arange(ranges + 1))
        which = np.flatnonzero(np.diff(cut)).tolist()
        once = [unique[cut[k] : cut[k + 1]] for k in which]
        twice = [x[counts[cut[k] : cut[k + 1]] > 1] for k, x in zip(which, once, strict=True)]
        columns = [pa.array(which, pa.int32()), *(pa.array([x.tobytes() for x in v], pa.binary()) for v in (once, twice))]
        yield pa.RecordBatch.from_arrays(columns, names=["range", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[bytes] = []
        for batch in sliced(batches):
            for text in _documents(batch):
                found += _document_digests(text, least)
            if len(found) >= HELD_KEYS:
                yield from flush(found)
                found = []
        if found:
            yield from flush(found)

    return run


def _shards(at: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """shard, bits: bitmaps of the positions."""
    at = np.unique(at)
    which, first = np.unique(at // size, return_index=True)
    out = []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
        bitmap = np.zeros(size // 8, np.uint8)
        _set(bitmap, at[a:b] % size)
        out.append(bitmap.tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(out, pa.binary())], names=["shard", "bits"])


def _met_again(once_bits: int, twice_bits: int, shard: int):
    """Rows of ``_sent`` sorted by range to shards of the second filter; one range's first filter is in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, again = None, None, []
        for batch in batches:
            for k, o, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if k != now:
                    now, once = k, np.zeros(once_bits // 8, np.uint8)
                o = np.frombuffer(o, np.uint64)
                slots = _slots(o, once_bits, ONCE_SLOTS)
                again += (o[_has(once, slots)], np.frombuffer(t, np.uint64))
                for at in slots:
                    _set(once, at)
            if sum(map(len, again)) >= HELD_KEYS:
                yield from _shards(np.concatenate(_slots(np.concatenate(again), twice_bits, TWICE_SLOTS)), shard)
                again = []
        if sum(map(len, again)):
            yield from _shards(np.concatenate(_slots(np.concatenate(again), twice_bits, TWICE_SLOTS)), shard)

    return run


def _joined_shards(size: int):
    """One bitmap of each shard, of rows sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = None, None
        for batch in batches:
            out = []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != now:
                    if now is not None:
                        out.append((now, bits.tobytes()))
                    now, bits = k, np.zeros(size // 8, np.uint8)
                bits |= np.frombuffer(raw, np.uint8)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], names=["shard", "bits"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([bits.tobytes()], pa.binary())], names=["shard", "bits"])

    return run


def twice_seen_filter(docs: DataFrame, min_chars: int) -> bytes:
    """The folded filter of keys that two documents may hold; at most ``MOST_BITS``."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keys = size / (3 * min_chars + 1)  # lines are rarely as short as the least; shorter ones only fill the filters more
    ranges = _power(keys / RANGE_KEYS, *RANGES)
    once_bits, twice_bits = _power(16 * keys / ranges, 1 << 16, 1 << 32), _power(16 * keys, SHARD_BITS, MOST_BITS)
    sent = docs.select("text").mapInArrow(_sent(ranges, min_chars), "range int, once binary, twice binary")
    again = sent.repartition("range").sortWithinPartitions("range").mapInArrow(_met_again(once_bits, twice_bits, SHARD_BITS), "shard long, bits binary")
    merged = again.repartition("shard").sortWithinPartitions("shard").mapInArrow(_joined_shards(SHARD_BITS), "shard long, bits binary")
    whole, step = bytearray(twice_bits // 8), SHARD_BITS // 8
    for row in merged.toLocalIterator():  # shards of a bounded filter
        whole[row["shard"] * step : (row["shard"] + 1) * step] = bytes(row["bits"])
    return bytes(whole)


def _suspects(filter_var, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(filter_var.value, np.uint8)
        for batch in sliced(batches):
            keys, owners = [], []
            for row, text in enumerate(_documents(batch)):
                own = _document_digests(text, least)
                keys += own
                owners += [row] * len(own)
            if not keys:
                continue
            kept = np.flatnonzero(_has(twice, _slots(_hashes(keys), len(twice) * 8, TWICE_SLOTS)))
            if len(kept):
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in kept.tolist()], pa.binary()), batch.column(0).take(pa.array(np.array(owners)[kept]))], names=["key", "doc_id"])

    return run


def repeated_keys(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> tuple[DataFrame, DataFrame]:
    """Suspected (key, doc_id) and confirmed (key, keeper); keepers are largest doc_ids."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("doc_id"), col("text").alias("text"))
    var = spark.sparkContext.broadcast(twice_seen_filter(docs, min_chars))
    suspects = saved(docs.mapInArrow(_suspects(var, min_chars), "key binary, doc_id long"), "line-suspects")
    # the distinct pairs are spread by both columns, then counted with partial sums: a hot key is no hot task
    pairs = suspects.distinct()
    confirmed = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    return suspects, saved(confirmed.select("key", "keeper"), "line-keys")


def _rewrite(text: bytes, drop, least: int) -> tuple[int, int, bytes]:
    lines = text.split(b"\n")
    kept = []
    for x in lines:
        if len(x) >= least:
            k = key_of(x)
            if _long_enough(k, least) and drop(_digest(k)):
                continue
        kept.append(x)
    return len(lines), len(lines) - len(kept), b"\n".join(kept) if len(kept) < len(lines) else text


def _emit(batch: pa.RecordBatch, done: list[tuple[int, int, bytes]], names: list[str], digest: bool) -> pa.RecordBatch:
    columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
    n, d, t = (list(x) for x in zip(*done, strict=True)) if done else ([], [], [])
    out = [pa.array(n, pa.int64()), pa.array(d, pa.int64())]
    out.append(pa.array([hashlib.sha256(x).hexdigest() for x in t], pa.string()) if digest else pa.array(t, pa.binary()).cast(pa.string()))
    return pa.RecordBatch.from_arrays([*columns, *out], names=[*names, "n_lines", "n_dropped", "kept_sha256" if digest else "kept_text"])


def drop_repeated_lines(docs: DataFrame, carry: list[str] | None = None, min_chars: int = 20, min_docs: int = 3, digest: bool = False, most_keys: int = MOST_KEYS) -> DataFrame:
    """``carry`` columns, n_lines, n_dropped and kept_text (or kept_sha256), one row per row of ``docs``.

    Dropped lines leave no empty line; a text all of whose lines go becomes empty.
    """
    spark = docs.sparkSession
    carry = carry or ["doc_id"]
    suspects, confirmed = repeated_keys(docs, min_chars, min_docs)
    source = docs.select(*[col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("key_id"), "text")
    names = [f"c{i}" for i in range(len(carry))]
    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    schema = f"{kinds}, n_lines long, n_dropped long, {'kept_sha256' if digest else 'kept_text'} string"
    last = "kept_sha256" if digest else "kept_text"
    if confirmed.count() <= most_keys:
        rows = confirmed.toArrow()
        var = spark.sparkContext.broadcast((b"".join(rows.column("key").to_pylist()), rows.column("keeper").to_numpy().astype(np.int64).tobytes()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packed, keep = var.value
            keep = np.frombuffer(keep, np.int64).tolist()
            keeper = {packed[i * 16 : i * 16 + 16]: keep[i] for i in range(len(keep))}
            for batch in sliced(batches):
                ids = batch.column(len(carry)).to_pylist()
                done = [_rewrite(text, lambda k, i=i: keeper.get(k, i) != i, min_chars) for i, text in zip(ids, _documents(batch), strict=True)]
                yield _emit(batch, done, names, digest)

        out = source.mapInArrow(run, schema)
    else:
        losers = suspects.distinct().join(confirmed, "key").where("doc_id <> keeper").groupBy(F.col("doc_id").alias("key_id")).agg(F.collect_list("key").alias("lost"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                lost = batch.column(batch.schema.get_field_index("lost")).to_pylist()
                done = [_rewrite(text, set(x or ()).__contains__, min_chars) for x, text in zip(lost, _documents(batch), strict=True)]
                yield _emit(batch, done, names, digest)

        out = source.join(losers.hint("shuffle_hash"), "key_id", "left").mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "n_lines", "n_dropped", last)


def without_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """The rows and columns of ``docs`` with the repeated lines gone from text; n_chars, if there, follows it."""
    row = docs.select(col("doc_id").alias("doc_id"), col("text").alias("text"), F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]).alias("row"))
    out = drop_repeated_lines(row, carry=["row"], **options)
    kept = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        kept["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[kept.get(c, F.col("row").getField(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])
