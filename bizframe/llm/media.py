"""Media columns: lossless PNG in binary columns, and low-frequency cosine-transform hashes of what is read back.

A payload is stored as the 8-bit grey samples of a PNG, `width` to a row: the filtered rows are compressed by zlib and
dealt over IDAT chunks, each with its CRC-32. Reading tests the signature and every chunk's checksum, inflates, and
undoes the five row filters in numpy. The hash takes block means on a size x size grid, their two-dimensional cosine
transform, and compares the low frequencies with their median.

Every row is handled alone, a batch at a time, so nothing is shuffled and memory is bounded by one batch and one text.

Defined cases: a null payload gives null media and null features; a payload whose length is not a positive multiple of
the width is an error (pad_bytes makes it one); a payload of any length is one image, handled whole; repeated rows are
handled each for itself; an empty table gives an empty table; extra columns stay untouched, and one that has the name of
a new column is an error that says so.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import map_batches, new_names

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHUNK = 1 << 16
WIDTH = 576
GRID = 32
LOW = 8


def pad_bytes(text: Column, to: int = WIDTH) -> Column:
    """The text's UTF-8 bytes (null: empty) followed by bytes 255 up to a positive multiple of `to`."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    missing = F.when(F.octet_length(data) == 0, to).otherwise(F.pmod(-F.octet_length(data), F.lit(to)))
    ones = F.substring(F.lit(bytearray(b"\xff" * to)), F.lit(1), missing)
    return F.concat(data, ones)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """Grey 8-bit PNG. Each row takes the filter (none, left, up) whose signed residuals are smallest."""
    if not payload or len(payload) % width:
        raise ValueError(f"{len(payload)} bytes are no positive multiple of {width}")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    tried = [rows, rows.copy(), rows.copy()]
    tried[1][:, 1:] -= rows[:, :-1]
    tried[2][1:] -= rows[:-1]
    cost = np.stack([np.abs(t.view(np.int8).astype(np.int16)).sum(1, dtype=np.int32) for t in tried])
    best = cost.argmin(0)
    out = np.empty((len(rows), width + 1), np.uint8)
    out[:, 0] = best
    for k, t in enumerate(tried):
        out[best == k, 1:] = t[best == k]
    packed = zlib.compress(out.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    data = b"".join(_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", head) + data + _chunk(b"IEND", b"")


def _paeth(row: np.ndarray, up: np.ndarray) -> np.ndarray:
    out = np.zeros(len(row) + 1, np.int32)
    above = np.concatenate([[0], up.astype(np.int32)])
    for x, value in enumerate(row.tolist()):
        a, b, c = int(out[x]), int(above[x + 1]), int(above[x])
        near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))
        out[x + 1] = (value + near[2]) & 255
    return out[1:].astype(np.uint8)


def _average(row: np.ndarray, up: np.ndarray) -> np.ndarray:
    out, left = np.empty(len(row), np.uint8), 0
    for x, (value, above) in enumerate(zip(row.tolist(), up.tolist())):
        left = out[x] = (value + (left + above) // 2) & 255
    return out


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undoes the row filters 0 to 4; runs of rows under one filter are summed at once where the filter allows it."""
    out, at, h = np.empty_like(rows), 0, len(rows)
    starts = np.flatnonzero(np.diff(kinds)) + 1
    for end in [*starts.tolist(), h]:
        kind, run = kinds[at], rows[at:end]
        above = out[at - 1] if at else np.zeros(rows.shape[1], np.uint8)
        if kind == 0:
            out[at:end] = run
        elif kind == 1:
            np.cumsum(run, axis=1, dtype=np.uint8, out=out[at:end])
        elif kind == 2:
            np.cumsum(run, axis=0, dtype=np.uint8, out=out[at:end])
            out[at:end] += above
        elif kind in (3, 4):
            for y in range(at, end):
                above = out[y] = (_average if kind == 3 else _paeth)(rows[y], above)
        else:
            raise ValueError(f"unknown row filter {kind}")
        at = end
    return out


def decode_png(media: bytes) -> np.ndarray:
    """The samples of a grey 8-bit PNG without interlacing; ValueError for a damaged one."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, packed, ended = 8, None, [], False
    while at < len(media) and not ended:
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if len(body) != size or len(media) < at + 12 + size or zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError(f"chunk {kind!r} at {at} fails its checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("no complete grey 8-bit PNG")
    width, height = head[:2]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(raw) != height * (width + 1):
        raise ValueError(f"{len(raw)} bytes for {height} rows of {width}")
    raw = raw.reshape(height, width + 1)
    return unfilter(raw[:, 0], raw[:, 1:])


def _cosines(n: int, k: int) -> np.ndarray:
    m = np.cos(np.pi * (2 * np.arange(n)[None, :] + 1) * np.arange(k)[:, None] / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def _means(a: np.ndarray, n: int) -> np.ndarray:
    """Means of n blocks of rows; rows repeat where there are fewer than n."""
    edges = np.arange(n) * len(a) // n
    if len(a) < n:
        return a[edges]
    return np.add.reduceat(a, edges, axis=0) / np.diff([*edges, len(a)])[:, None]


def cosine_hash(image: np.ndarray, grid: int = GRID, low: int = LOW) -> bytes:
    """low * low bits: which low frequencies of the grid's cosine transform are above their median (the mean level left out)."""
    cells = _means(_means(image.astype(np.float64), grid).T, grid).T
    basis = _cosines(grid, low)
    freq = np.round((basis @ cells @ basis.T).ravel(), 6)
    return np.packbits(freq > np.median(freq[1:])).tobytes()


def to_media(df: DataFrame, payload_col: str, out_col: str = "media", width: int = WIDTH) -> DataFrame:
    """Adds out_col, the payload as a PNG."""
    new_names(df.columns, out_col)
    schema = StructType([*df.schema.fields, StructField(out_col, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(payload_col).to_pylist()
            media = pa.array([None if v is None else encode_png(v, width) for v in values], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, media], names=schema.names)

    return map_batches(df, run, schema)


def from_media(df: DataFrame, media_col: str = "media", keep: list[str] | None = None) -> DataFrame:
    """keep columns, payload (binary, read back), feature (hexadecimal cosine hash), height, media (as stored)."""
    keep = [c for c in df.columns if c != media_col] if keep is None else keep
    added = [StructField("payload", BinaryType()), StructField("feature", StringType()), StructField("height", LongType()), StructField("media", BinaryType())]
    new_names(keep, *[f.name for f in added])
    schema = StructType([*[df.schema[c] for c in keep], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payload, feature, height = [], [], []
            for m in b.column(media_col).to_pylist():
                image = None if m is None else decode_png(m)
                payload.append(None if m is None else image.tobytes())
                feature.append(None if m is None else cosine_hash(image).hex())
                height.append(None if m is None else len(image))
            arrays = [pa.array(payload, pa.binary()), pa.array(feature, pa.string()), pa.array(height, pa.int64()), b.column(media_col)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *arrays], names=schema.names)

    return map_batches(df.select(*keep, media_col), run, schema)
