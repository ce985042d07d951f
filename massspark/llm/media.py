"""Media columns: bytes stored as PNG in a binary column, read back with checksum tests, and hashed by low frequencies.

A payload of 64-byte rows is an 8-bit grey image 64 samples wide. The writer picks the row filter of the least absolute
residual for an image. The reader checks the signature, every chunk's CRC and zlib's own checksum, and undoes all five
filters in NumPy, runs of rows of one filter at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massspark.llm.common import binary, mapped, slices

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_NONE, _SUB, _UP, _AVERAGE, _PAETH = range(5)
#: Bytes of one IDAT chunk.
CHUNK = 1 << 16


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def _residual(image: np.ndarray, kind: int) -> np.ndarray:
    left, up = np.zeros_like(image), np.zeros_like(image)
    left[:, 1:], up[1:] = image[:, :-1], image[:-1]
    if kind == _NONE:
        return image
    if kind == _SUB:
        return image - left
    if kind == _UP:
        return image - up
    if kind == _AVERAGE:
        return image - ((left.astype(np.uint16) + up) >> 1).astype(np.uint8)
    corner = np.zeros_like(image)
    corner[1:, 1:] = image[:-1, :-1]
    return image - _nearest(left, up, corner)


def _nearest(left, up, corner):
    """Of left, up and corner the one nearest to left + up - corner, in this order."""
    a, b, c = (np.asarray(x, np.int16) for x in (left, up, corner))
    pa_, pb, pc_ = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((pa_ <= pb) & (pa_ <= pc_), a, np.where(pb <= pc_, b, c)).astype(np.uint8)


def png(payload: bytes, filters: tuple[int, ...] = (_NONE, _SUB, _UP), level: int = 1) -> bytes:
    """A PNG of the payload, whose length is a positive multiple of 64."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    tried = [(int(np.abs(r.view(np.int8).astype(np.int16)).sum()), k, r) for k in filters for r in [_residual(image, k)]]
    _, kind, residual = min(tried, key=lambda x: x[:2])
    rows = np.empty((len(image), WIDTH + 1), np.uint8)
    rows[:, 0], rows[:, 1:] = kind, residual
    packed = zlib.compress(rows.tobytes(), level)
    header = struct.pack(">IIBBBBB", WIDTH, len(image), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + b"".join(_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK)) + _chunk(b"IEND", b"")


def _unfiltered(rows: np.ndarray) -> np.ndarray:
    kinds, image = rows[:, 0], rows[:, 1:].copy()
    edges = np.r_[0, np.flatnonzero(kinds[1:] != kinds[:-1]) + 1, len(kinds)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        kind, part = kinds[a], image[a:b]
        above = image[a - 1] if a else np.zeros(image.shape[1], np.uint8)
        if kind == _SUB:
            np.cumsum(part, axis=1, dtype=np.uint8, out=part)
        elif kind == _UP:
            part[0] += above
            np.cumsum(part, axis=0, dtype=np.uint8, out=part)
        elif kind in (_AVERAGE, _PAETH):
            # along anti-diagonals: a sample needs its left, upper and corner neighbours only
            wide = np.zeros((len(part) + 1, part.shape[1] + 1), np.uint8)
            wide[0, 1:] = above
            corner = 0  # left of the first column all is 0
            for d in range(sum(part.shape) - 1):
                y = np.arange(max(0, d - part.shape[1] + 1), min(d, len(part) - 1) + 1)
                x = d - y
                left, up = wide[y + 1, x], wide[y, x + 1]
                corner = wide[y, x]
                guess = ((left.astype(np.uint16) + up) >> 1).astype(np.uint8) if kind == _AVERAGE else _nearest(left, up, corner)
                wide[y + 1, x + 1] = part[y, x] + guess
            part[:] = wide[1:, 1:]
        elif kind != _NONE:
            raise ValueError(f"row filter {kind}")
    return image


def samples(media: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG without interlace. Raises ValueError if a checksum or the structure is wrong."""
    if media[:8] != _SIGNATURE:
        raise ValueError("no PNG signature")
    at, header, packed, ended = 8, None, [], False
    while at < len(media) and not ended:
        if len(media) < at + 12:
            raise ValueError("cut inside a chunk's header")
        length, kind = struct.unpack(">I4s", media[at : at + 8])
        body, sum_ = media[at + 8 : at + 8 + length], media[at + 8 + length : at + 12 + length]
        if len(sum_) < 4 or struct.unpack(">I", sum_)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            if header or length != 13:
                raise ValueError("a header of the wrong size or a second one")
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + length
    if not ended or header is None or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit grey image")
    size, unpacker = header[1] * (header[0] + 1), zlib.decompressobj()
    try:
        raw = unpacker.decompress(b"".join(packed), size + 1)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if not header[0] or not header[1] or len(raw) != size or not unpacker.eof:
        raise ValueError("samples and header differ in size")
    return _unfiltered(np.frombuffer(raw, np.uint8).reshape(header[1], header[0] + 1))


_SIDE, _LOW = 32, 8
_COSINES = np.cos(np.pi * np.arange(_LOW)[:, None] * (2 * np.arange(_SIDE) + 1) / (2 * _SIDE))


def _cells(n: int) -> tuple[np.ndarray, np.ndarray]:
    start = np.arange(_SIDE) * n // _SIDE
    return start, np.maximum(np.r_[start[1:], n], start + 1) - start


def frequency_hash(image: np.ndarray) -> str:
    """64 bits in hex: which of the 8 x 8 lowest cosine frequencies of the 32 x 32 means exceed their median."""
    (top, high), (side, wide) = _cells(image.shape[0]), _cells(image.shape[1])
    sums = np.add.reduceat(image.astype(np.int64), top, axis=0) if image.shape[0] >= _SIDE else image[top].astype(np.int64)
    means = np.add.reduceat(sums, side, axis=1) / (wide[None, :] * high[:, None])
    low = np.round(_COSINES @ means @ _COSINES.T, 6).reshape(-1)
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 8 << 20):
        sizes, media = [], []
        for text in batch.column("text").to_pylist():
            data = (text or "").encode("utf-8")
            sizes.append(len(data))
            media.append(png(data + bytes(-len(data) % 64 if data else 64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), binary(media)], ["doc_id", "n_bytes", "media"])


def as_media(documents: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (the PNG, a binary column). Null and empty texts are 64 zero bytes; one row per input row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("string").alias("text"))
    return rows.transform(mapped, _encode, "doc_id long, n_bytes long, media binary")


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "media", 8 << 20):
        rows = []
        for media in batch.column("media").to_pylist():
            if media is None:
                rows.append((None,) * 6 + ("no media",))
                continue
            own = (len(media), hashlib.sha256(media).hexdigest())
            try:
                image = samples(media)
            except ValueError as e:
                rows.append((None, None, None, *own, None, str(e)))
                continue
            payload = image.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *own, frequency_hash(image), None))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        columns = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [x.split()[0] for x in _FEATURES.split(", ")])


def media_features(media: DataFrame) -> DataFrame:
    """What reading each row's media gives: payload size and digests, media size and digest, feature, error.

    Damaged or null media give nulls and an error text; no row is dropped. Extra columns are ignored.
    """
    return media.select("doc_id", "n_bytes", "media").transform(mapped, _read, _FEATURES)
