"""Shared plumbing: scratch tables, broadcasts with a checked size, Arrow loops."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; bounds a worker's memory.
SLICE_BYTES = 1 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where that is unset, as in local tests, a temporary folder is made and
    remembered in the session.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.weftline.scratch", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.weftline.scratch", at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete all that this library wrote below the shared folder; results that read from it end with it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/weftline")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    at = scratch_path(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def give_back() -> None:
    """Return freed memory to the system: a driver that has fitted a model runs on for long, as do workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its whole name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, name: str = "row") -> Column:
    """All columns of ``docs`` as one struct, so that a step's own columns can't clash with them."""
    return F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias(name)


def unpacked(rows: DataFrame, docs: DataFrame, name: str = "row") -> DataFrame:
    """The columns of ``docs`` from the struct of ``packed``."""
    return rows.select(*[F.col(name).getField(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches at row borders so that a piece holds about ``most`` bytes of ``column``.

    Small batches pass as they are; a single longer text forms a piece of its own.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = texts(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + most, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
    give_back()  # workers outlive their tasks


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Doubles in (0, 1) from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * (2.0**-53)


_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 65536)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_P, _PINV)):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                made = np.multiply.accumulate(a)
                if size <= 4 * SLICE_BYTES:
                    _powers[k] = made
                elif k == 0:
                    other = np.full(size, _PINV, np.uint64)
                    other[0] = 1
                    return [made, np.multiply.accumulate(other)]
    return _powers


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span ``data[start:end]``, equal for equal bytes."""
    n = len(data)
    if n == 0 or len(start) == 0:
        return np.zeros(len(start), np.uint64)
    power, inverse = _powers_to(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[:n], out=total[1:])
        return mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(data: np.ndarray) -> np.ndarray:
    """Lower-case ASCII and the Latin-1 capitals of UTF-8 bytes; lengths don't change."""
    out = _LOWER[data]
    if len(out) > 1:
        at = np.flatnonzero(data[:-1] == 0xC3) + 1
        b = out[at]
        out[at] = np.where((b >= 0x80) & (b <= 0x9E) & (b != 0x97), b + 32, b)
    return out


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of maximal runs of True that don't cross rows."""
    n = len(inside)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    border = np.zeros(n + 1, bool)
    border[off] = True
    first = inside & np.concatenate(([True], ~inside[:-1])) | inside & border[:n]
    last = inside & np.concatenate((~inside[1:], [True])) | inside & border[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words are runs of ASCII letters and digits and of any non-ASCII characters."""
    return runs(_WORD[data], off)


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def count_space_separated(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of runs of bytes other than space and \\x09-\\x0D in each row."""
    _, _, row = runs(~_SPACE[data], off)
    return np.bincount(row, minlength=len(off) - 1).astype(np.int64)


def code_points(data: np.ndarray) -> np.ndarray:
    """1 where a code point begins."""
    return (data & 0xC0) != 0x80


#: Largest filter of ``held_by``, in bits.
MOST_BITS = 1 << 28


def held_by(wanted: DataFrame, keys: list[str], bits: int | None = None) -> Column:
    """A condition on ``keys``: true where ``wanted`` holds them, and rarely elsewhere.

    A Bloom filter of one position a key, 16 bits or more for each, of at most
    ``MOST_BITS``: its broadcast is bounded, and where it is full it lets more rows pass.
    """
    spark = wanted.sparkSession
    bits = bits or min(MOST_BITS, max(1 << 16, 1 << (16 * wanted.count()).bit_length()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.unique(batch.column(0).to_numpy())
            part = at >> 16
            for k in np.unique(part).tolist():
                bitmap, own = parts.setdefault(k, np.zeros(1 << 13, np.uint8)), at[part == k] & 0xFFFF
                np.bitwise_or.at(bitmap, own >> 3, np.uint8(1) << (own & 7).astype(np.uint8))
        for k, b in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([b.tobytes()], pa.binary())], names=["part", "bitmap"])

    slots = wanted.select(F.xxhash64(*keys).bitwiseAND(F.lit(bits - 1)).alias("slot"))
    whole = bytearray(bits // 8)
    for r in slots.repartition(F.shiftright("slot", 16)).mapInArrow(build, "part int, bitmap binary").toLocalIterator():  # of bounded size
        whole[r["part"] << 13 : (r["part"] + 1) << 13] = bytes(r["bitmap"])
    var = spark.sparkContext.broadcast(bytes(whole))

    @F.pandas_udf("boolean")
    def test(slot: pd.Series) -> pd.Series:
        at, bitmap = slot.to_numpy(), np.frombuffer(var.value, np.uint8)
        return pd.Series((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0)

    return test(F.xxhash64(*keys).bitwiseAND(F.lit(bits - 1)))


def salted_lookup(big: DataFrame, small: DataFrame, keys: list[str], rows_of: str, total: int, parts: int = 1000) -> DataFrame:
    """Left join of ``big`` to ``small`` (unique on ``keys``) that no hot key can slow.

    ``small[rows_of]`` says how many rows of ``big`` a key has.  The keys that hold
    more than 1/``parts`` of ``total`` rows are at most ``parts``: they are
    broadcast.  The others are shuffled.
    """
    hot = F.col(rows_of) > F.lit(max(total, 1) / parts)
    values = [c for c in small.columns if c not in keys and c != rows_of]
    packed = small.select(*keys, rows_of, F.struct(*values).alias("_value"))
    a = packed.where(hot).select(*keys, F.col("_value").alias("_hot"))
    b = packed.where(~hot).select(*keys, F.col("_value").alias("_cold"))
    out = big.join(F.broadcast(a), keys, "left")
    # rows of hot keys leave the second join by a key that matches nothing and is spread evenly
    out = out.withColumn("_spread", F.when(F.col("_hot").isNotNull(), F.xxhash64(*[F.col(c) for c in big.columns])).otherwise(F.lit(0)))
    out = out.join(b.withColumn("_spread", F.lit(0).cast("long")), [*keys, "_spread"], "left")
    return out.select(*big.columns, *[F.coalesce(F.col(f"_hot.{v}"), F.col(f"_cold.{v}")).alias(v) for v in values])
