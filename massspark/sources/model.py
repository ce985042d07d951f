"""The fragment-scoring model: its binary stream, read and written, and its parts as tables."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

SENTINEL = 0x7FFFFFFF


@dataclass
class Fragment:
    prefix: bool
    charge: int
    offset: float
    frequency: float

    @property
    def name(self) -> str:
        return f"{'P' if self.prefix else 'S'}_{self.charge}_{math.floor(np.float32(self.offset) + np.float32(0.5))}"


@dataclass
class Model:
    """partitions: (charge, mass, segment) in order of charge, segment, mass; fragments, ranks and errors go along them.

    ranks: for each partition a row of max_rank + 1 frequencies per fragment and one for noise (None without fragments);
    errors: for each partition (signal, noise, existence of neither, one, other, both), empty if error_scale is 0.
    """

    tolerance: float = 0.02
    ppm: bool = False
    deconvolute: bool = True
    deconvolution_tolerance: float = 0.02
    charges: list[tuple[int, int]] = field(default_factory=list)
    segments: int = 1
    partitions: list[tuple[int, float, int]] = field(default_factory=list)
    precursors: list[tuple[int, int, float, bool, float, float]] = field(default_factory=list)
    fragments: list[list[Fragment]] = field(default_factory=list)
    max_rank: int = 150
    ranks: list[np.ndarray | None] = field(default_factory=list)
    error_scale: int = 0
    errors: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    version: int = 1
    activation: str = "HCD"
    instrument: str = "HighRes"
    enzyme: str | None = "Tryp"
    protocol: str | None = None

    def window(self, mz):
        return np.float32(np.float64(mz) * self.tolerance / 1e6) if self.ppm else np.float32(self.tolerance)


class _Stream:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, kind: str):
        size = struct.calcsize(">" + kind)
        if self.at + size > len(self.data):
            raise ValueError(f"the model ends at byte {len(self.data)}, but {size} more are due at {self.at}")
        self.at += size
        found = struct.unpack(">" + kind, self.data[self.at - size : self.at])
        return found[0] if len(found) == 1 else found

    def text(self) -> str:
        units = self.take("B")
        raw = self.data[self.at : self.at + 2 * units]
        self.at += 2 * units
        return raw.decode("utf-16-be", "replace")

    def floats(self, n: int) -> np.ndarray:
        if self.at + 4 * n > len(self.data):
            raise ValueError(f"the model ends at byte {len(self.data)}, but {4 * n} more are due at {self.at}")
        self.at += 4 * n
        return np.frombuffer(self.data, ">f4", n, self.at - 4 * n).astype(np.float32)


def decode(data: bytes) -> Model:
    """A model from its big-endian stream. Zero existence frequencies are read as 0.001; a wrong sentinel is an error."""
    s, m = _Stream(data), Model()
    m.version, m.activation, m.instrument = s.take("i"), s.text(), s.text()
    m.enzyme, m.protocol = s.text() or None, s.text() or None
    m.ppm, m.tolerance, m.deconvolute, m.deconvolution_tolerance = s.take("?"), s.take("f"), s.take("?"), s.take("f")
    m.charges = [s.take("ii") for _ in range(s.take("i"))]
    n, m.segments = s.take("i"), s.take("i")
    m.partitions = sorted({s.take("ifi") for _ in range(n)}, key=lambda p: (p[0], p[2], p[1]))
    m.precursors = [s.take("iif?ff") for _ in range(s.take("i"))]
    m.fragments = [[Fragment(*s.take("?iff")) for _ in range(s.take("i"))] for _ in m.partitions]
    m.max_rank = s.take("i")
    m.ranks = [s.floats((len(f) + 1) * (m.max_rank + 1)).reshape(len(f) + 1, -1) if f else None for f in m.fragments]
    m.error_scale = s.take("i")
    if m.error_scale > 0:
        width = 2 * m.error_scale + 1
        for _ in m.partitions:
            signal, noise, existence = s.floats(width), s.floats(width), s.floats(4)
            m.errors.append((signal, noise, np.where(existence == 0, np.float32(0.001), existence)))
    if (end := s.take("i")) != SENTINEL:
        raise ValueError(f"the model's sentinel is {end} at byte {s.at - 4}")
    return m


def encode(m: Model) -> bytes:
    """The exact inverse of decode()."""
    out: list[bytes] = []
    put = lambda kind, *x: out.append(struct.pack(">" + kind, *x))

    def text(x: str | None) -> None:
        raw = (x or "").encode("utf-16-be")
        put("B", len(raw) // 2)
        out.append(raw)

    put("i", m.version)
    for x in (m.activation, m.instrument, m.enzyme, m.protocol):
        text(x)
    put("?f?f", m.ppm, m.tolerance, m.deconvolute, m.deconvolution_tolerance)
    put("i", len(m.charges))
    for c in m.charges:
        put("ii", *c)
    put("ii", len(m.partitions), m.segments)
    for p in m.partitions:
        put("ifi", *p)
    put("i", len(m.precursors))
    for p in m.precursors:
        put("iif?ff", *p)
    for own in m.fragments:
        put("i", len(own))
        for f in own:
            put("?iff", f.prefix, f.charge, f.offset, f.frequency)
    put("i", m.max_rank)
    out += [r.astype(">f4").tobytes() for r in m.ranks if r is not None]
    put("i", m.error_scale)
    if m.error_scale > 0:
        out += [x.astype(">f4").tobytes() for e in m.errors for x in e]
    put("i", SENTINEL)
    return b"".join(out)


def read_model(spark: SparkSession, path: str) -> Model:
    return decode(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))


def write_model(spark: SparkSession, model: Model, path: str) -> None:
    """As the one row of a Parquet table, which any store takes; read_stored() reads it."""
    spark.createDataFrame([(bytearray(encode(model)),)], "content binary").coalesce(1).write.mode("overwrite").parquet(path)


def read_stored(spark: SparkSession, path: str) -> Model:
    return decode(bytes(spark.read.parquet(path).first()[0]))


def tables(spark: SparkSession, m: Model) -> dict[str, DataFrame]:
    """The model as relations: partitions, fragments, ranks, errors, precursors, charges."""
    ranks = [(i, name, b, float(x)) for i, (own, rows) in enumerate(zip(m.fragments, m.ranks, strict=True)) if rows is not None for name, row in zip([*(f.name for f in own), "noise"], rows, strict=True) for b, x in enumerate(row)]
    errors = [(i, kind, b, float(x)) for i, e in enumerate(m.errors) for kind, row in zip(("signal", "noise", "exist"), e, strict=True) for b, x in enumerate(row)]
    return {
        "partitions": spark.createDataFrame([(i, *p) for i, p in enumerate(m.partitions)], "partition int, charge int, parent_mass float, seg int"),
        "fragments": spark.createDataFrame([(i, k, f.prefix, f.charge, f.offset, f.frequency, f.name) for i, own in enumerate(m.fragments) for k, f in enumerate(own)], "partition int, ion_idx int, is_prefix boolean, charge int, offset float, frequency float, name string"),
        "ranks": spark.createDataFrame(ranks, "partition int, ion string, bin int, freq float"),
        "errors": spark.createDataFrame(errors, "partition int, kind string, bin int, freq float"),
        "precursors": spark.createDataFrame(m.precursors, "charge int, reduced_charge int, offset float, tol_ppm boolean, tol_val float, frequency float"),
        "charges": spark.createDataFrame(m.charges, "charge int, spectra int"),
    }
