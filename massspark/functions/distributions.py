"""Score distributions as columns (min_score, probs): tails, merging, shifting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tail_probability(min_score: Column, probs: Column, threshold: Column) -> Column:
    """The chance of the threshold or more, summed upwards, at most 1; 0 beyond the greatest score."""
    first = F.greatest(threshold - min_score, F.lit(0)).cast("int") + 1
    total = F.aggregate(F.slice(probs, first, F.greatest(F.size(probs) - first + 1, F.lit(0))), F.lit(0.0), lambda a, p: a + p)
    return F.least(total, F.lit(1.0))


def max_score(min_score: Column, probs: Column) -> Column:
    """The score after the last."""
    return min_score + F.size(probs)


def relative_error(error: Column, probability: Column) -> Column:
    return F.when(probability > 0, error / probability)


def shifted(min_score: Column, by: Column) -> Column:
    return min_score + by


def merged(distributions: DataFrame, by: list[str]) -> DataFrame:
    """by, min_score, probs, valid_from, error, best: distributions of those columns added up score by score.

    The axis goes from the least to the greatest score of a group, with 0 where none of them has a chance; a tail is as
    good as the least complete of them, so valid_from is the greatest, errors add, and best is the best. Chances are added in
    partial aggregates by score; a group's own row has its axis and no more. Null errors count 0, null valid_from and best
    are left out; a group without any score has an empty axis and no min_score.
    """
    own = {"valid_from": F.max("valid_from"), "error": F.sum("error"), "best": F.max("best")}
    rows = distributions.select(*by, "min_score", "valid_from", "error", "best", F.posexplode_outer("probs").alias("_i", "_p"))
    first = F.coalesce("_i", F.lit(0)) == 0  # a distribution's error counts once
    rows = rows.groupBy(*by, (F.col("min_score") + F.col("_i")).alias("_score")).agg(
        F.sum("_p").alias("_p"), F.max("valid_from").alias("valid_from"), F.sum(F.when(first, F.coalesce("error", F.lit(0.0))).otherwise(0.0)).alias("error"), F.max("best").alias("best")
    )
    axis = F.map_from_entries(F.collect_list(F.when(F.col("_score").isNotNull(), F.struct("_score", "_p"))))
    rows = rows.groupBy(*by).agg(F.min("_score").alias("min_score"), F.max("_score").alias("_top"), axis.alias("_axis"), *[f.alias(c) for c, f in own.items()])
    probs = F.when(F.col("_top").isNull(), F.array().cast("array<double>")).otherwise(F.transform(F.sequence("min_score", "_top"), lambda s: F.coalesce(F.try_element_at("_axis", s), F.lit(0.0))))
    return rows.select(*by, "min_score", probs.alias("probs"), *own)
