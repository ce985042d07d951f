"""Helpers that the operators share: the shared folder, written stages, byte views of Arrow text."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from massspark.operators.arrow import BATCH_BYTES, PASS_BYTES, byte_view, mapped, runs, slices  # noqa: F401
from massspark.operators.staging import shared_dir

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back


def forget(df: DataFrame) -> None:
    """Delete a table that written() made, once nothing reads it any more."""
    spark, path = df.sparkSession, getattr(df, "_written_at", None)
    if path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())
