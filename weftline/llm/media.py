"""Media columns: Netpbm and BMP decoding, area resizing, NPY tiles, difference hashes.

Images are numpy arrays of uint8 or uint16, ``height x width`` for one sample and
``height x width x channels`` for more.  Resizing averages the exact source area
below each target pixel, with fractions at its borders, by an integral image that is
built in strips, so that a long image needs little more memory than its samples.

Defined cases: null and empty payloads decode to null with a reason; a broken file
never stops a job, its row gets ``error``; files of no pixels are broken.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col, sliced, texts

_TOKEN = re.compile(rb"(?:[ \t\r\n\v\f]|#[^\r\n]*[\r\n])*([^ \t\r\n\v\f#]+)")
_MOST_PIXELS = 1 << 31


class MediaError(ValueError):
    """The bytes aren't an image of a known kind."""


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    at, found = 2, []
    for _ in range(count):
        m = _TOKEN.match(data, at)
        if not m or not m[1].isdigit():
            raise MediaError("broken Netpbm header")
        found.append(int(m[1]))
        at = m.end()
    return found, at


def _shaped(flat: np.ndarray, h: int, w: int, channels: int) -> np.ndarray:
    return flat.reshape(h, w) if channels == 1 else flat.reshape(h, w, channels)


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P7.  Bitmaps give 1 for black, as stored; 16-bit samples are big-endian."""
    kind = data[:2]
    if kind == b"P7":
        head, sep, _ = data.partition(b"ENDHDR\n")
        if not sep:
            raise MediaError("broken PAM header")
        fields = dict(x.split(None, 1) for x in head.split(b"\n")[1:] if len(x.split(None, 1)) == 2 and x[:1] != b"#")
        try:
            w, h, channels, most = (int(fields[k]) for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
        except (KeyError, ValueError) as e:
            raise MediaError("broken PAM header") from e
        at = len(head) + len(sep)
    elif kind in (b"P1", b"P4"):
        (w, h), at = _header(data, 2)
        channels, most = 1, 1
    elif kind in (b"P2", b"P3", b"P5", b"P6"):
        (w, h, most), at = _header(data, 3)
        channels = 3 if kind in (b"P3", b"P6") else 1
    else:
        raise MediaError("not Netpbm")
    if not (0 < w and 0 < h and w * h * max(channels, 1) <= _MOST_PIXELS and 0 < most < 65536 and channels > 0):
        raise MediaError("impossible size")
    n = w * h * channels
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\r\n]*", b"", data[at:])
        if kind == b"P1":
            bits = np.frombuffer(body, np.uint8)
            flat = bits[(bits == 48) | (bits == 49)] - 48
        else:
            try:
                flat = np.array(body.split(), np.int64)
            except ValueError as e:
                raise MediaError("samples aren't numbers") from e
            if flat.size and (flat.min() < 0 or flat.max() > most):
                raise MediaError("sample out of range")
            flat = flat.astype(np.uint16 if most > 255 else np.uint8)
    else:
        if kind != b"P7":
            at += 1  # one white space ends the header
        if kind == b"P4":
            row = (w + 7) // 8
            if len(data) - at < row * h:
                raise MediaError("too few samples")
            return np.unpackbits(np.frombuffer(data, np.uint8, row * h, at).reshape(h, row), axis=1)[:, :w]
        wide = 2 if most > 255 else 1
        if len(data) - at < n * wide:
            raise MediaError("too few samples")
        flat = np.frombuffer(data, ">u2" if wide == 2 else np.uint8, n, at)
        flat = flat.astype(np.uint16) if wide == 2 else flat
    if flat.size < n:
        raise MediaError("too few samples")
    return _shaped(flat[:n], h, w, channels)


def encode_netpbm(image: np.ndarray) -> bytes:
    """PGM, PPM, or PAM for other channel counts; lossless."""
    if image.dtype not in (np.uint8, np.uint16) or image.ndim not in (2, 3) or 0 in image.shape:
        raise MediaError("not an 8 or 16-bit image")
    h, w = image.shape[:2]
    channels = 1 if image.ndim == 2 else image.shape[2]
    most = 255 if image.dtype == np.uint8 else 65535
    body = image.tobytes() if most == 255 else image.astype(">u2").tobytes()
    if channels in (1, 3):
        return b"P%d\n%d %d\n%d\n" % (5 if channels == 1 else 6, w, h, most) + body
    return b"P7\nWIDTH %d\nHEIGHT %d\nDEPTH %d\nMAXVAL %d\nENDHDR\n" % (w, h, channels, most) + body


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits; palettes that are grey give one channel."""
    if data[:2] != b"BM" or len(data) < 30:
        raise MediaError("not BMP")
    (at,) = struct.unpack_from("<I", data, 10)
    (size,) = struct.unpack_from("<I", data, 14)
    if size == 12:
        w, h, _, bits = struct.unpack_from("<HHHH", data, 18)
        packed, used, entry = 0, 0, 3
    elif size >= 40 and len(data) >= 54:
        w, h, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
        (used,) = struct.unpack_from("<I", data, 46)
        entry = 4
    else:
        raise MediaError("unknown BMP header")
    if bits not in (1, 4, 8, 24, 32) or packed not in ((0, 3) if bits == 32 else (0,)):
        raise MediaError("unsupported BMP")
    flip, h = h > 0, abs(h)
    if not (0 < w and 0 < h and w * h <= _MOST_PIXELS):
        raise MediaError("impossible size")
    row = (w * bits + 31) // 32 * 4
    if len(data) - at < row * h:
        raise MediaError("too few samples")
    rows = np.frombuffer(data, np.uint8, row * h, at).reshape(h, row)
    if flip:
        rows = rows[::-1]
    if bits >= 24:
        n = bits // 8
        image = rows[:, : w * n].reshape(h, w, n)[:, :, [2, 1, 0, 3][:n]]
        return image[:, :, :3] if n == 4 and packed == 0 else image
    start = 14 + size
    count = min(used or 1 << bits, 1 << bits)
    if len(data) < start + count * entry:
        raise MediaError("palette is cut")
    palette = np.frombuffer(data, np.uint8, count * entry, start).reshape(count, entry)[:, 2::-1]
    if bits == 8:
        index = rows[:, :w]
    elif bits == 4:
        index = np.stack([rows >> 4, rows & 15], 2).reshape(h, -1)[:, :w]
    else:
        index = np.unpackbits(rows, axis=1)[:, :w]
    if index.max() >= count:
        raise MediaError("colour isn't in the palette")
    grey = (palette == palette[:, :1]).all()
    return palette[index, 0] if grey else palette[index]


def encode_bmp(image: np.ndarray) -> bytes:
    """8-bit grey with its palette, or 24-bit colour, bottom row first."""
    if image.dtype != np.uint8 or image.ndim not in (2, 3) or 0 in image.shape or image.ndim == 3 and image.shape[2] != 3:
        raise MediaError("not an 8-bit grey or colour image")
    h, w = image.shape[:2]
    flat = image if image.ndim == 2 else image[:, :, ::-1].reshape(h, w * 3)
    row = (flat.shape[1] + 3) // 4 * 4
    body = np.zeros((h, row), np.uint8)
    body[:, : flat.shape[1]] = flat[::-1]
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if image.ndim == 2 else b""
    at = 54 + len(palette)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", at + body.size, 0, 0, at, 40, w, h, 1, 8 if image.ndim == 2 else 24, 0, body.size, 2835, 2835, 256 if image.ndim == 2 else 0, 0) + palette + body.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _cuts(size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n + 1 equal cuts of an axis: the sample that each lies in, and how far within."""
    at = np.arange(n + 1) * (size / n)
    low = np.minimum(at.astype(np.int64), size - 1)
    return low, at - low


def _integral_rows(image: np.ndarray, rows: np.ndarray, strip: int) -> np.ndarray:
    """The given rows of the image's integral image, which is built in strips of about ``strip`` samples."""
    h, w = image.shape[:2]
    step = max(1, strip // max(1, image[0].size))
    out = np.zeros((len(rows), w + 1, *image.shape[2:]), np.int64)
    above = np.zeros(image.shape[1:], np.int64)
    for a in range(0, h, step):
        part = np.cumsum(np.cumsum(image[a : a + step], 0, dtype=np.int64), 1)
        part += above
        above = part[-1].copy()
        lo, hi = np.searchsorted(rows, (a + 1, a + len(part) + 1))
        out[lo:hi, 1:] = part[rows[lo:hi] - a - 1]
    return out


def area_resize(image: np.ndarray, height: int, width: int, strip: int = 1 << 18) -> np.ndarray:
    """Mean over the exact source area of each target pixel, as float64.  Memory follows the strip and the target."""
    h, w = image.shape[:2]
    low, part = _cuts(h, height)
    rows, place = np.unique(np.concatenate((low, low + 1)), return_inverse=True)
    total = _integral_rows(image, rows, strip)
    place = place.reshape(2, -1)
    shape = (-1, *[1] * (total.ndim - 1))
    cut = total[place[0]] + (total[place[1]] - total[place[0]]) * part.reshape(shape)
    low, part = _cuts(w, width)
    a, b = cut[:, low], cut[:, low + 1]
    cut = a + (b - a) * part.reshape(shape[:-1] if total.ndim > 2 else -1)
    return (cut[1:, 1:] - cut[:-1, 1:] - cut[1:, :-1] + cut[:-1, :-1]) / (h / height * w / width)


def difference_hash(image: np.ndarray, side: int = 8) -> str:
    """Signs of horizontal steps in the grey image resized to side x (side + 1), as hex."""
    if image.ndim == 3:
        image = image[:, :, :3].mean(2) if image.shape[2] >= 3 else image[:, :, 0]
        scaled = area_resize(np.rint(image).astype(np.int64), side, side + 1)
    else:
        scaled = area_resize(image, side, side + 1)
    scaled = np.round(scaled, 6)  # equal means compare as equal whatever the rounding of their sums
    return np.packbits(scaled[:, 1:] > scaled[:, :-1]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


def tiles(image: np.ndarray, side: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row, column and pixels of each tile; those at the right and bottom borders are smaller."""
    for y in range(0, image.shape[0], side):
        for x in range(0, image.shape[1], side):
            yield y // side, x // side, image[y : y + side, x : x + side]


TILE_SCHEMA = "media_id long, tile_row int, tile_col int, height int, width int, channels int, dhash string, tile_dhash string, npy binary, error string"


def decode_tiles(media: DataFrame, id_col: str, data_col: str, height: int | None = None, width: int | None = None, side: int = 256) -> DataFrame:
    """One row per NPY tile of each decoded (and, if a size is given, resized) image.

    ``dhash`` is the whole decoded image's difference hash, ``tile_dhash`` the tile's own.

    Rows whose bytes are null, empty or broken give one row with ``error`` set and
    no tile.  No shuffle; memory holds one image at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("media_id", pa.int64()), *[(c, pa.int32()) for c in ("tile_row", "tile_col", "height", "width", "channels")], ("dhash", pa.string()), ("tile_dhash", pa.string()), ("npy", pa.binary()), ("error", pa.string())])
        for batch in batches:
            rows, held = [], 0
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = data.as_py()
                try:
                    if not raw:
                        raise MediaError("no bytes")
                    image = decode(raw)
                except MediaError as e:
                    rows.append((key, *[None] * 8, str(e)))
                    continue
                mark = difference_hash(image)
                if height and width:
                    image = np.clip(np.rint(area_resize(image, height, width)), 0, 65535).astype(image.dtype)
                for y, x, tile in tiles(image, side):
                    rows.append((key, y, x, *tile.shape[:2], 1 if tile.ndim == 2 else tile.shape[2], mark, difference_hash(tile), b := npy(tile), None))
                    held += len(b)
                    if held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return media.select(col(id_col).cast("long").alias("media_id"), col(data_col).alias("data")).mapInArrow(run, TILE_SCHEMA)


def store(payload: bytes, width: int = 64, form: str = "pgm") -> bytes:
    """Bytes as the grey samples of an image of the given width; its height follows.

    The payload's length is a positive multiple of the width, which the caller's padding ensures.
    """
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    return encode_netpbm(image) if form == "pgm" else encode_bmp(image)


STORED_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_tiles int, tiles_sha256 string"


def stored_features(docs: DataFrame, form: str = "pgm", tile: int = 256) -> DataFrame:
    """Store every whole text as an image, read it back, and describe what was read.

    The payload is the text in UTF-8 (null: empty) and then bytes 0 up to a positive
    multiple of 64.  ``feature`` is the difference hash; the image is also cut into
    NPY tiles, whose bytes ``tiles_sha256`` digests in reading order.  Rows that
    repeat give repeated results.  One pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data, off = texts(batch.column(1))
            raw = data.tobytes()
            rows = []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                n = b - a
                media = store(raw[a:b] + bytes(-n % 64 or 64 * (n == 0)), form=form)
                image = decode(media)
                back = image.tobytes()
                digest, count = hashlib.sha256(), 0
                for _, _, part in tiles(image, tile):
                    digest.update(npy(part))
                    count += 1
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), count, digest.hexdigest()))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_tiles", "tiles_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], names=["doc_id", *names])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, STORED_SCHEMA)


def text_media(docs: DataFrame, form: str = "pgm") -> DataFrame:
    """doc_id, media: every whole text stored as an image, padded as in ``stored_features``; ``decode_tiles`` reads it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data, off = texts(batch.column(1))
            raw = data.tobytes()
            made = [store(raw[a:b] + bytes(-(b - a) % 64 or 64 * (a == b)), form=form) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["doc_id", "media"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, media binary")
