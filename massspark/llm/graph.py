"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massspark.llm.common import forget, written


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """node, root: the smallest id that each linked node reaches. Nodes without a link are not returned.

    Each round replaces the links by links to the smallest neighbour; the minima combine before the shuffle and
    the join back on a hub's id is one that adaptive execution splits. Rounds grow with the log of the diameter.
    Links with a null end are ignored; an empty table gives an empty result.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    edges = written(links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before = _mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the minima are written, so that a hub's partition is one of a plain join, which can be split
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # after the large star every v is below its u
        large = written(large, "large-star")
        forget(least)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        small = written(small, "small-star")
        forget(least)
        forget(large)
        forget(edges)
        edges, after = small, _mark(small)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
