"""Embedding whitening: sums of centred products for all pairs of dimensions as generated aggregate expressions, the
covariance put together from them and decomposed by LAPACK, rows projected by expressions."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components that are returned, and the sums of one aggregation: up to 89 dimensions take one, more take several.
COMPONENTS, PAIRS = 8, 4096
#: Components of no more than this share of the whole variance have none but rounding errors, and no unit variance to scale to.
LEAST_SHARE = 1e-13
_LIMIT = float(1 << 62)


@dataclass(frozen=True)
class Whitening:
    """n rows' sums by dimension, the falling eigenvalues, the unit eigenvectors as rows, and the whole variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def means(self) -> list[float]:
        return [s / self.n for s in self.sums]


def grid(embeddings: DataFrame) -> DataFrame:
    """vec_id, x: floor(1024 c) + 100000 for each entry c; vectors that are null or hold null or no finite number are left out.
    Entries beyond 2^62 / 1024 count as that."""
    c = F.transform("embedding", lambda e: e.cast("double"))
    sound = F.col("embedding").isNotNull() & ~F.exists("c", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")).withColumn("c", c).where(sound)
    x = F.transform("c", lambda e: F.floor(F.greatest(F.least(e * 1024, F.lit(_LIMIT)), F.lit(-_LIMIT))) + 100_000)
    return rows.select("vec_id", x.alias("x"))


def _dimension(rows: DataFrame) -> int:
    """The commonest length, of equals the longest; what comes to the driver is one row."""
    top = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top["d"] if top else 0


def _sums(rows: DataFrame, expressions: list[str]) -> list:
    """One row of aggregates, of PAIRS of them a pass."""
    return [v for k in range(0, len(expressions), PAIRS) for v in rows.selectExpr(*[f"{e} AS s{i}" for i, e in enumerate(expressions[k : k + PAIRS])]).first()]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The components of rows (vec_id, x) of one dimension; None without rows. The driver gets d (d + 3) / 2 sums."""
    d = _dimension(rows)
    rows = rows.where(F.size("x") == d)
    n, *sums = rows.agg(F.count("*"), *[F.sum(F.col("x")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(d)]).first()
    if not n or not d:
        return None
    sums = [int(s) for s in sums]
    pairs = list(itertools.combinations_with_replacement(range(d), 2))
    centred = rows.selectExpr(*[f"x[{i}] - {s / n!r}D AS c{i}" for i, s in enumerate(sums)])
    found = _sums(centred, [f"sum(c{i} * c{j})" for i, j in pairs])
    v = np.zeros((d, d))
    for (i, j), s in zip(pairs, found, strict=True):
        v[i, j] = v[j, i] = s / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1].T
    vectors = vectors * np.sign(vectors[np.arange(d), np.abs(vectors).argmax(axis=1)])[:, None]  # the largest entry is positive
    trace = float(np.trace(v))
    keep = np.flatnonzero(values[:components] > LEAST_SHARE * trace)
    return Whitening(n, sums, values[keep], vectors[keep], trace)


def _projected(rows: DataFrame, w: Whitening, *keep: str) -> DataFrame:
    """keep and w1, w2, ...: each component over the root of its variance."""
    scaled = w.vectors / np.sqrt(w.values)[:, None]
    dot = lambda u: F.aggregate(F.zip_with("y", F.array(*[F.lit(float(a)) for a in u]), lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)
    means = F.array(*[F.lit(m) for m in w.means])
    rows = rows.where(F.size("x") == len(w.sums)).withColumn("y", F.zip_with("x", means, lambda a, m: a - m))
    return rows.select(*keep, *[dot(u).alias(f"w{k + 1}") for k, u in enumerate(scaled)])


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Vectors that are null or hold null or non-finite entries are left out, and so are those of another length than the
    commonest. Components without variance are left out, so one vector alone, equal vectors and an empty table give no rows.
    Repeated rows and vec_ids are kept, a null vec_id too; further columns are ignored. deviation is exact, and null where it
    is beyond a long. Rows stay where they are: only sums are shuffled.
    """
    rows = grid(embeddings)
    w = fit(rows, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if w is None or not len(w.values):
        return embeddings.sparkSession.createDataFrame([], schema)
    k = len(w.values)
    pairs = list(itertools.combinations_with_replacement(range(1, k + 1), 2))
    covariance = _projected(rows, w).agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"v{i}_{j}") for i, j in pairs]).first()
    error = max(abs(v - (i == j)) for (i, j), v in zip(pairs, covariance, strict=True))
    sums = F.array(*[F.lit(str(s)).cast("decimal(38,0)") for s in w.sums])
    apart = F.zip_with("x", sums, lambda x, s: (x.cast("decimal(19,0)") * F.lit(w.n).cast("decimal(18,0)") - s).try_cast("decimal(19,0)"))
    deviation = F.aggregate(apart, F.lit(0).cast("decimal(38,0)"), lambda s, p: F.try_add(s, (p * p).cast("decimal(38,0)")).cast("decimal(38,0)"))
    found = _projected(rows.withColumn("deviation", deviation.try_cast("long")), w, "vec_id", "deviation")
    each = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("component"), F.col(f"w{i + 1}").alias("whitened"), F.lit(float(w.values[i] / w.trace)).alias("explained")) for i in range(k)]))
    out = found.select("vec_id", "deviation", each.alias("e"))
    return out.select("vec_id", "e.component", F.lit(w.n).cast("long").alias("n"), "deviation", "e.whitened", "e.explained", F.lit(float(error)).alias("identity_error"))
