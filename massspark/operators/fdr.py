"""Target-decoy q-values by windows over distinct scores. Lower scores are better; all rates are single precision."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massspark.functions.chem import is_decoy_match, peptide_key
from massspark.operators.staging import group_ranges


def score_counts(scored: DataFrame, score: str = "score", decoy: str = "is_decoy") -> DataFrame:
    """score (single precision), t, d: targets and decoys of each distinct score."""
    return scored.groupBy(F.col(score).cast("float").alias("score")).agg(F.count_if(~F.col(decoy)).alias("t"), F.count_if(F.col(decoy)).alias("d"))


def q_map(scored: DataFrame, score: str = "score", decoy: str = "is_decoy") -> DataFrame:
    """score, q for each distinct score. Rows are counted per distinct score first (with partial aggregates)."""
    return q_map_of(score_counts(scored, score, decoy))


def q_map_of(counts: DataFrame) -> DataFrame:
    """score, q of counts (score, t, d): see q_maps()."""
    return q_maps(counts.select(F.lit(0).alias("map"), "score", "t", "d")).drop("map")


def q_maps(counts: DataFrame) -> DataFrame:
    """map, score, q of counts (map, score, t, d), several maps in one pass: the least rate decoys/targets at any worse key, by
    strictly better counts.

    Scores are dealt into ranges by map and score; each range's running
    counts start from the sums of those before it in its map, and the least rate behind a range comes from the ranges' minima, so no
    task sees more than a range. Keys are the decoys' scores that some target beats. The sweep stops behind the first key
    whose rate reaches 1; beyond the last key q is 1, or 0 where there is no decoy.
    """
    ranges, before = group_ranges(counts, ["map"], ["score"]), []
    each = sorted(ranges.groupBy("map", "part").agg(F.sum("t").alias("t"), F.sum("d").alias("d")).collect(), key=lambda r: (r["map"], r["part"]))  # a row for each range
    for _, parts in groupby(each, key=lambda r: r["map"]):
        t = d = 0
        for r in parts:
            before.append((r["map"], r["part"], t, d))
            t, d = t + r["t"], d + r["d"]
    order = Window.partitionBy("map", "part").orderBy("score")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = F.broadcast(counts.sparkSession.createDataFrame(before, "map int, part int, t_before long, d_before long"))
    better = ranges.join(starts, ["map", "part"]).select("map", "part", "score", "d", (F.sum("t").over(upto) - F.col("t") + F.col("t_before")).alias("targets"), (F.sum("d").over(upto) - F.col("d") + F.col("d_before")).alias("decoys"))
    ratio = F.when(F.col("targets") <= F.col("decoys"), F.lit(1.0)).otherwise(F.col("decoys").cast("float") / F.col("targets").cast("float")).cast("float")
    rated = better.withColumn("rate", F.when((F.col("d") > 0) & (F.col("targets") > 0), ratio))
    stopped = F.coalesce(F.max(F.col("rate") >= 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rated = rated.select("map", "part", "score", "d", "rate", F.when(~stopped, F.col("rate")).alias("used"))
    found = sorted(rated.groupBy("map", "part").agg(F.sum("d").alias("d"), F.max("rate").alias("most"), F.min("used").alias("least")).collect(), key=lambda r: (r["map"], -r["part"]))
    after = []
    for _, parts in groupby(found, key=lambda r: r["map"]):
        parts = list(parts)
        behind = 1.0 if any(r["d"] for r in parts) else 0.0
        last = min((r["part"] for r in parts if (r["most"] or 0) >= 1), default=1 << 30)  # no rate counts behind the range of the stop
        for r in parts:
            after.append((r["map"], r["part"], behind, r["part"] <= last))
            if r["part"] <= last and r["least"] is not None:
                behind = min(behind, r["least"])
    rows = rated.join(F.broadcast(counts.sparkSession.createDataFrame(after, "map int, part int, behind float, counted boolean")), ["map", "part"])
    worse = F.min(F.when(F.col("counted"), F.col("used"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    return rows.select("map", "score", F.least(F.coalesce(worse, "behind"), "behind").alias("q"))


def best_per_peptide(scored: DataFrame) -> DataFrame:
    """peptide, is_decoy, score: the best of each peptide, targets and decoys apart."""
    return scored.groupBy("peptide", "is_decoy").agg(F.min(F.col("score").cast("float")).alias("score"))


def assign_q_values(matches: DataFrame) -> DataFrame:
    """matches (score, peptide, is_decoy, ...) with q_value and pep_q_value.

    A match's peptide is looked up among the targets first, then among the decoys. Null scores get null q-values.
    """
    scored = matches.where("score is not null")
    best = best_per_peptide(scored)
    maps = q_maps(score_counts(scored).withColumn("map", F.lit(0)).unionByName(score_counts(best).withColumn("map", F.lit(1))))
    return with_q_values(matches, maps.where("map = 0"), best, maps.where("map = 1"))


def with_q_values(matches: DataFrame, psm_q: DataFrame, best: DataFrame, pep_q: DataFrame) -> DataFrame:
    """matches with q_value and pep_q_value out of the maps (score, q) of matches and of peptides' bests (peptide, is_decoy, score)."""
    pep_score = best.groupBy("peptide").agg(F.coalesce(F.min(F.when(~F.col("is_decoy"), F.col("score"))), F.min("score")).alias("best"))
    rows = matches.withColumn("score_f", F.col("score").cast("float")).join(pep_score, "peptide", "left")
    rows = rows.join(psm_q.select(F.col("score").alias("score_f"), F.col("q").alias("q_value")), "score_f", "left")
    rows = rows.join(pep_q.select(F.col("score").alias("best"), F.col("q").alias("pep_q_value")), "best", "left")
    return rows.drop("score_f", "best")


def rolled_up(rows: DataFrame, protein: str = "protein") -> DataFrame:
    """Rows that differ in their protein only, as one with the sorted list of proteins."""
    others = [c for c in rows.columns if c != protein]
    return rows.groupBy(*others).agg(F.array_sort(F.collect_list(protein)).alias("proteins"))


def fdr(rows: DataFrame, peptide: str, protein: str, score: str, prefix: str = "XXX_") -> DataFrame:
    """Unrolled match rows with QValue and PepQValue. Column names are found in either case; a missing one is an error.

    Rows whose score isn't a number keep their place with null q-values. Proteins may be lists joined by `;`.
    """
    named = {c.lower().lstrip("#"): c for c in rows.columns}
    missing = [x for x in (peptide, protein, score) if x.lower() not in named]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} among {', '.join(rows.columns)}")
    p, r, s = (named[x.lower()] for x in (peptide, protein, score))
    others = [F.col(f"`{c}`") for c in rows.columns if c != r]
    key = F.xxhash64(*others) if len(others) else F.lit(0)
    rows = rows.withColumn("match_key", F.struct(key.alias("h"), *[c.cast("string").alias(f"c{i}") for i, c in enumerate(others)]))
    matches = rows.groupBy("match_key").agg(F.flatten(F.collect_list(F.split(F.col(f"`{r}`"), ";"))).alias("proteins"), F.first(F.col(f"`{p}`")).alias("p"), F.first(F.col(f"`{s}`").try_cast("float")).alias("score"))
    scored = assign_q_values(matches.select("match_key", "score", peptide_key(F.col("p")).alias("peptide"), is_decoy_match(F.col("proteins"), prefix).alias("is_decoy")))
    q = scored.select("match_key", F.col("q_value").alias("QValue"), F.col("pep_q_value").alias("PepQValue"))
    return rows.join(q, "match_key", "left").drop("match_key")


def summary(matches: DataFrame) -> DataFrame:
    """matches, targets, and target identifications at 1 % and 5 % q."""
    hit = ~F.col("is_decoy")
    return matches.agg(F.count("*").alias("matches"), F.count_if(hit).alias("targets"), *[F.count_if(hit & (F.col("q_value") <= F.lit(x).cast("float"))).alias(f"ids_{int(x * 100)}") for x in (0.01, 0.05)])
