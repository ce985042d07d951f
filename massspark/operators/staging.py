"""Tables written between the stages of a job, and orders over all rows without a task that sees them all."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where it is unset and all is on one machine, as in tests, a temporary
    one is set; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="massspark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: made once however often it is used, whatever executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, by: str) -> DataFrame:
    """The rows with part, dealt into ranges of a column that follow each other in part; equal values share a part. Written."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(parts, by).withColumn("part", F.spark_partition_id()), "ranges")


def sums_before(ranges: DataFrame, columns: list[str]) -> DataFrame:
    """part and, for each column, its sum over all earlier parts: a row for each part comes to the driver."""
    rows, at = [], [0] * len(columns)
    for r in sorted(ranges.groupBy("part").agg(*[F.sum(c).alias(c) for c in columns]).collect(), key=lambda r: r["part"]):
        rows.append((r["part"], *at))
        at = [a + r[c] for a, c in zip(at, columns, strict=True)]
    return F.broadcast(ranges.sparkSession.createDataFrame(rows, "part int, " + ", ".join(f"{c}_before long" for c in columns)))


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """Equality in all columns, null being equal to null."""
    found = F.lit(True)
    for c in columns:
        found = found & left[c].eqNullSafe(right[c])
    return found


def group_ranges(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The rows with part: ranges by group and order that follow each other, so that one group may be in many. Written."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(parts, *by, *order).withColumn("part", F.spark_partition_id()), "group-ranges")


def placed(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The rows with place (0, 1, ... in their group by the order) and size (the group's rows); nulls come first.

    A place is that in a range plus the rows of the group in the ranges before, so no task sees a whole group: what is summed
    over a group has a row for each of its ranges.
    """
    ranges = group_ranges(rows, by, order)
    counts = ranges.groupBy("part", *by).agg(F.count("*").alias("_n"))
    own = Window.partitionBy(*by)
    before = counts.select("part", *by, F.coalesce(F.sum("_n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(own).alias("size"))
    here = ranges.withColumn("_here", F.row_number().over(Window.partitionBy("part", *by).orderBy(*order)) - 1)
    joined = here.join(before, _same(here, before, ["part", *by]))
    return joined.select(*[here[c] for c in rows.columns], (F.col("_here") + F.col("_before")).alias("place"), "size")


def floor_join(rows: DataFrame, table: DataFrame, by: list[str], on: str, values: list[str]) -> DataFrame:
    """Rows with floor_<on> and the values of the table's greatest `on` that isn't above their own, among equal `by`: an as-of join.

    Both are merged into ranges of (by, on); each range carries its last key on to the ranges of the same group behind it. So
    one hot group is many tasks, and no pair of a row and a smaller key is listed. Null `on` finds nothing; of equal keys one is
    taken that has the greatest values. Columns of the rows must not be named as those of the result.
    """
    keys = table.where(F.col(on).isNotNull()).groupBy(*by, F.col(on).alias("_at")).agg(F.max(F.struct(on, *values)).alias("_found")).withColumn("_row", F.lit(0))
    own = rows.select(*by, F.col(on).alias("_at"), F.lit(1).alias("_row"), F.struct(*rows.columns).alias("_own"))
    ranges = group_ranges(keys.unionByName(own, allowMissingColumns=True), by, ["_at", "_row"])
    last = ranges.where("_row = 0").groupBy("part", *by).agg(F.max_by("_found", "_at").alias("_last"))
    # every range of a group needs what the ranges before it hold, also those without a key of their own
    each = ranges.groupBy("part", *by).agg(F.count("*").alias("_n"))
    known = each.join(last, _same(each, last, ["part", *by]), "left").select(each["part"], *[each[c] for c in by], "_last")
    carried = known.withColumn("_carried", F.last("_last", ignorenulls=True).over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    order = Window.partitionBy("part", *by).orderBy("_at", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = ranges.withColumn("_found", F.last("_found", ignorenulls=True).over(order)).where("_row = 1")
    joined = here.join(carried, _same(here, carried, ["part", *by])).withColumn("_found", F.when(F.col("_at").isNotNull(), F.coalesce("_found", "_carried")))
    return joined.select("_own.*", F.col(f"_found.{on}").alias(f"floor_{on}"), *[F.col(f"_found.{v}").alias(v) for v in values])
