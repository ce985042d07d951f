"""A mass-ordered index of candidates: written once in ranges of mass that follow each other, swept by the intervals of many searches."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from massspark.operators.arrow import mapped
from massspark.operators.staging import floor_join, written

#: Intervals that are swept over a range at once; a range of more is swept several times, by tasks of their own.
SWEPT = 20_000
#: Candidates of a range about, where the number of ranges isn't given, and matches of a batch.
IN_RANGE, EMITTED = 20_000, 50_000


@dataclass(frozen=True)
class MassIndex:
    """path/rows: candidates with part, a folder for each range, sorted by the value; path/bounds: part, low, high, n, first; path/schema."""

    spark: SparkSession
    path: str
    value: str

    @property
    def rows(self) -> DataFrame:
        kept = StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/schema").first()[0]))
        return self.spark.read.schema(kept).parquet(f"{self.path}/rows")

    @property
    def bounds(self) -> DataFrame:
        """A row for each range: its least and greatest value, its rows, and the first range that has its least value as well."""
        return self.spark.read.parquet(f"{self.path}/bounds")

    def count(self) -> int:
        return self.bounds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def parts_of(self, intervals: DataFrame, low: str, high: str) -> DataFrame:
        """intervals with part: a row for each range that an interval touches, found by floor joins with the ranges' least values."""
        starts = self.bounds.select(F.col("low").alias("_at"), "part", "first").withColumn("_g", F.lit(0))
        sound = intervals.where(F.col(low) <= F.col(high)).withColumns({"_id": F.monotonically_increasing_id(), "_g": F.lit(0)})
        sound = written(sound, "intervals")
        at_high = floor_join(sound.withColumn("_at", F.col(high).cast("double")), starts.select("_g", "_at", "part"), ["_g"], "_at", ["part"])
        at_high = at_high.where("part is not null").withColumnRenamed("part", "_last").drop("_at", "floor__at")
        both = floor_join(at_high.withColumn("_at", F.col(low).cast("double")), starts.select("_g", "_at", "first"), ["_g"], "_at", ["first"])
        each = both.withColumn("part", F.explode(F.sequence(F.coalesce("first", F.lit(0)), F.col("_last"))))
        # an interval in the gap behind a range, or behind all of them, does not touch it
        tops = F.broadcast(self.bounds.select("part", F.col("high").alias("_top")))  # a row for each range
        each = each.join(tops, "part").where(F.col(low).cast("double") <= F.col("_top"))
        return each.select(*intervals.columns, "part")

    def matches(self, intervals: DataFrame, low: str, high: str) -> DataFrame:
        """The intervals' rows with those of the index whose value lies inside: what range_join() gives.

        Only the folders of touched ranges are read. Ranges and their intervals meet in tasks of SWEPT intervals; each sorts its
        range, finds the ends of all intervals by bisection and hands out EMITTED matches at a time. Intervals with a null end or the wrong way round have no match.
        """
        spread = written(self.parts_of(intervals, low, high), "swept")
        sizes = spread.groupBy("part").agg(F.ceil(F.count("*") / SWEPT).cast("int").alias("_chunks"))
        touched = [r["part"] for r in sizes.select("part").collect()]  # ranges at most
        rows = self.rows.where(F.col("part").isin(touched))
        names = [c for c in rows.columns if c != "part"]
        value, key = self.value, ["part", "_chunk"]
        own = [c for c in intervals.columns if c not in names]
        if len(own) < len(intervals.columns):
            raise ValueError(f"columns of both: {sorted(set(intervals.columns) & set(names))}")
        left = spread.join(sizes, "part").withColumn("_chunk", F.pmod(F.monotonically_increasing_id(), F.col("_chunks")).cast("int"))
        left = left.groupBy(*key).agg(F.collect_list(F.struct(*own)).alias("_left"))
        right = rows.groupBy("part").agg(F.collect_list(F.struct(*names)).alias("_right"))  # IN_RANGE rows or so
        right = right.join(sizes, "part").withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))

        def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for found, range_ in zip(batch.column("_left"), batch.column("_right"), strict=True):
                    found, range_ = found.values, range_.values
                    masses = range_.field(value).to_numpy(zero_copy_only=False).astype(float)
                    order = np.argsort(masses, kind="stable")
                    ends = [found.field(c).to_numpy(zero_copy_only=False).astype(float) for c in (low, high)]
                    first, last = (np.searchsorted(masses[order], x, side) for x, side in zip(ends, ("left", "right"), strict=True))
                    n = np.maximum(last - first, 0)
                    upto = np.cumsum(n)
                    for start in range(0, int(n.sum()), EMITTED):
                        at = np.arange(start, min(start + EMITTED, upto[-1]))
                        own_at = np.searchsorted(upto, at, "right")
                        in_range = order[first[own_at] + at - (upto - n)[own_at]]
                        yield pa.RecordBatch.from_arrays([*(found.field(c).take(pa.array(own_at)) for c in own), *(range_.field(c).take(pa.array(in_range)) for c in names)], [*own, *names])

        schema = StructType([*(intervals.schema[c] for c in own), *(rows.schema[c] for c in names)])
        return mapped(left.join(right.hint("merge"), key).select("_left", "_right"), sweep, schema)


def build_index(rows: DataFrame, path: str, value: str, ranges: int | None = None) -> MassIndex:
    """Write rows with a value into ranges of about equal size; equal values may be in several. Rows without a value are left out."""
    spark = rows.sparkSession
    rows_in = rows.where(F.col(value).isNotNull())
    parts = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows_in.count() // IN_RANGE))
    tied = rows_in.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(parts, value, "_tie").withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", value)
    dealt.drop("_tie").write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    schema = StructType([*rows.schema.fields, StructField("part", IntegerType())])
    spark.createDataFrame([(schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")
    back = open_index(spark, path, value).rows
    bounds = back.groupBy("part").agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"), F.count("*").alias("n"))
    # a row for each range: ranges before one that end where it starts hold its least value too
    order = Window.orderBy("part")
    bounds = bounds.withColumn("_new", F.coalesce(F.lag("high").over(order) < F.col("low"), F.lit(True)))
    bounds = bounds.withColumn("_before", F.coalesce(F.lag("low").over(order) < F.col("low"), F.lit(True)))
    first = F.when(F.col("_new"), F.col("part")).when(F.col("_before"), F.lag("part").over(order))
    bounds = bounds.withColumn("first", F.last(first, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    bounds.select("part", "low", "high", "n", "first").coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")
    return open_index(spark, path, value)


def open_index(spark: SparkSession, path: str, value: str = "mass") -> MassIndex:
    return MassIndex(spark, path, value)
