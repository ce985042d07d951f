"""Training of the fragment-scoring model by counting, and evaluation statistics, as aggregates and windows."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from massspark.functions import chem
from massspark.operators.matching import Ion, ion_kinds, ranked_peaks, strongest_match
from massspark.operators.staging import placed, written
from massspark.sources.model import Fragment, Model, encode


def quantile_starts(rows: DataFrame, by: list[str], value: str, ties: list[str], parts: int) -> DataFrame:
    """by, part, value: where each of `parts` groups of equal counts starts, exactly, in the order of value and ties."""
    starts = placed(rows.select(*by, value, *ties), by, [value, *ties]).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).where(F.col("place") == F.floor(F.col("part") * F.col("size") / parts))
    return starts.select(*by, "part", value).distinct()


def upper_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, upper_median: the element n / 2, rounded down, of a group's sorted values, nulls left out."""
    found = placed(rows.where(F.col(value).isNotNull()).select(*by, value), by, [value])
    return found.where(F.col("place") == F.floor(F.col("size") / 2)).select(*by, F.col("size").alias("n"), F.col(value).alias("upper_median"))


def spearman(rows: DataFrame, by: str, x: str, y: str, tie: str) -> DataFrame:
    """by, rho: the correlation of ranks, ties broken by another column. Each rank is found over ranges of values."""
    first = placed(rows.select(by, x, y, tie), [by], [x, tie]).select(by, y, tie, F.col("place").alias("_x"))
    both = placed(first, [by], [y, tie])
    return both.groupBy(by).agg(F.corr("_x", "place").alias("rho"))


def calibration(rows: DataFrame, by: list[str], claimed: str, decoy: str, bins: int) -> DataFrame:
    """by, bin, n, low, high, claimed, observed: the claimed chances of error against the observed share of decoys.

    Rows of a group are dealt into bins of equal counts by falling confidence (rising claimed chance, then decoys last); bin k has the
    places from k n / bins on. observed is the share of decoys, claimed the mean. Null chances are left out.
    """
    found = placed(rows.where(F.col(claimed).isNotNull()).select(*by, claimed, decoy), by, [claimed, decoy])
    own = found.groupBy(*by, F.floor(F.col("place") * bins / F.col("size")).cast("int").alias("bin"))
    return own.agg(F.count("*").alias("n"), F.min(claimed).alias("low"), F.max(claimed).alias("high"), F.avg(claimed).alias("claimed"), F.avg(F.col(decoy).cast("double")).alias("observed"))


def median_gap(rows: DataFrame, by: list[str], unit: str, score: str, decoy: str) -> DataFrame:
    """by, n, median_gap: the upper median over units of the best target's score minus the best decoy's; higher is better. Units
    that lack either are left out."""
    gap = F.max(F.when(~F.col(decoy), F.col(score))) - F.max(F.when(F.col(decoy), F.col(score)))
    gaps = rows.groupBy(*by, unit).agg(gap.alias("gap"))
    return upper_median(gaps, by, "gap").withColumnRenamed("upper_median", "median_gap")


@dataclass(frozen=True)
class Training:
    tolerance: float = 0.5  # nodes lie on the nominal grid, up to a tenth of a Da beside their residues
    segments: int = 2
    least_spectra: int = 50
    most_groups: int = 8
    most_ions: int = 6
    least_frequency: float = 0.15
    max_rank: int = 150
    error_scale: int = 100
    rank_prior: float = 0.005
    error_prior: float = 0.01
    least_peaks: int = 20
    mass_mismatch: float = 0.1


def screened(spectra: DataFrame, how: Training = Training()) -> DataFrame:
    """Annotated spectra with sites, mass (neutral) and reject_reason: the first that holds, null for those kept."""
    rows = spectra.withColumn("sites", chem.residues(F.col("seq"), leading=True))
    mass = F.aggregate("sites", F.lit(chem.WATER), lambda a, s: a + chem.site_mass(s))
    observed = (F.col("precursor_mz") - chem.PROTON) * F.col("charge")
    reason = (
        F.when(F.coalesce("seq", F.lit("")) == "", "no annotation").when(F.coalesce("charge", F.lit(0)) <= 0, "no charge").when(F.size("peaks") < how.least_peaks, "few peaks")
        .when(F.col("sites").isNull(), "bad peptide").when(~F.size("sites").between(6, 50), "length").when(~F.element_at("sites", -1)["aa"].isin("K", "R"), "not tryptic")
        .when(F.abs(observed - F.col("mass")) > how.mass_mismatch, "mass mismatch")
    )
    return rows.withColumn("mass", mass).withColumn("reject_reason", reason)


def corpus_counts(spectra: DataFrame, how: Training = Training()) -> DataFrame:
    return screened(spectra, how).groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def decoy_sites(sites: Column, seed: Column) -> Column:
    """The residues between the first and the last in an order that a hash of the peptide gives; four are the least."""
    inner = F.slice(sites, F.lit(2), F.greatest(F.size(sites) - 2, F.lit(0)))
    mixed = F.array_sort(F.transform(inner, lambda s, i: F.struct(F.xxhash64(seed, i).alias("h"), s.alias("s"))))
    whole = F.concat(F.slice(sites, 1, 1), F.transform(mixed, lambda x: x["s"]), F.slice(sites, -1, 1))
    return F.when(F.size(sites) < 4, sites).otherwise(whole)


def _theoretical(kept: DataFrame, kinds: list[Ion], how: Training) -> DataFrame:
    """A row for each peptide bond, kind of ion, and peptide or decoy: spec_index, ion, low, high, and where it counts."""
    both = kept.select("spec_index", "charge", "mass", "part", F.explode(F.array(F.struct(F.lit(False).alias("decoy"), F.col("sites").alias("s")), F.struct(F.lit(True).alias("decoy"), decoy_sites(F.col("sites"), F.col("seq")).alias("s")))).alias("x"))
    sums = F.transform(F.sequence(F.lit(1), F.size("x.s") - 1), lambda i: F.aggregate(F.slice("x.s", F.lit(1), i), F.lit(0.0), lambda a, s: a + chem.site_mass(s)))
    bonds = both.select("spec_index", "charge", "mass", "part", "x.decoy", F.posexplode(sums).alias("bond", "prefix"), F.lit(0).alias("_"))
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i.prefix).alias("is_prefix"), F.lit(i.charge).alias("z"), F.lit(i.offset).alias("offset")) for k, i in enumerate(kinds)])
    rows = bonds.select("*", F.explode(table).alias("kind")).where(F.col("kind.z") <= F.col("charge"))
    part = F.when(F.col("kind.is_prefix"), F.col("prefix")).otherwise(F.col("mass") - chem.WATER - F.col("prefix"))
    mz = part / F.col("kind.z") + F.col("kind.offset")
    segment = F.greatest(F.least(F.floor(mz / F.col("mass") * how.segments), F.lit(how.segments - 1)), F.lit(0)).cast("int")
    return rows.select("spec_index", "charge", "part", segment.alias("segment"), "decoy", "bond", F.col("kind.k").alias("k"), mz.alias("mz"), "mass", F.struct("decoy", "bond", F.col("kind.k").alias("k")).alias("ion"), (mz - how.tolerance).alias("low"), (mz + how.tolerance).alias("high"))


def precursor_offsets(kept: DataFrame, peaks: DataFrame, how: Training) -> list[tuple[int, int, float, bool, float, float]]:
    """Offsets at which a charge's reduced precursors often have a peak: above 0.15 and twice the median rate, eight at most."""
    water = chem.WATER / chem.NOMINAL
    steps = sorted({-1, 0, 1, -int(water), -int(water) - 1})
    table = F.array(*[F.lit(float(s)) for s in steps])
    rows = kept.select("spec_index", "charge", "mass", F.explode(F.expr("sequence(0, charge - 1)")).alias("reduced")).select("*", F.explode(table).alias("step"))
    z = F.col("charge") - F.col("reduced")
    centre = (F.col("mass") + z * chem.PROTON) / z + F.col("step") / z
    rows = rows.withColumns({"ion": F.struct("reduced", "step"), "low": centre - how.tolerance, "high": centre + how.tolerance})
    hits = strongest_match(rows, peaks, 1.0).select("spec_index", "ion", F.lit(1).alias("hit"))
    rates = rows.join(hits, ["spec_index", "ion"], "left").groupBy("charge", "reduced", "step").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("rate")).collect()
    out = []
    for c in sorted({r["charge"] for r in rates}):
        own = sorted((r for r in rates if r["charge"] == c), key=lambda r: (-r["rate"], r["reduced"], r["step"]))
        middle = sorted(r["rate"] for r in own)[len(own) // 2]
        out += [(c, r["reduced"], r["step"] / (c - r["reduced"]), False, how.tolerance, r["rate"]) for r in own if r["rate"] >= max(how.least_frequency, 2 * middle)][:8]
    return out


def train(spectra: DataFrame, how: Training = Training()) -> Model:
    """A scoring model from annotated spectra. All counts are Spark aggregates; what comes to the driver has the model's size.

    The same spectra give the same bytes. Raises ValueError if no spectrum passes the screen.
    """
    return train_with_report(spectra, how)[0]


#: The reasons of screened(), in the order in which they are looked for.
REASONS = ("no annotation", "no charge", "few peaks", "bad peptide", "length", "not tryptic", "mass mismatch")


def train_with_report(spectra: DataFrame, how: Training = Training()) -> tuple[Model, dict]:
    """train(), and a report of it for JSON: what was read, rejected and kept, and what each partition of the model rests on.

    The counts of the screen are observed while the spectra that are kept are written, not counted by jobs of their own.
    """
    seen = Observation()
    counted = [F.count("*").alias("read"), *[F.count_if(F.col("reject_reason") == r).alias(r) for r in REASONS], F.count_if(F.col("reject_reason").isNull()).alias("kept"), F.coalesce(F.sum(F.when(F.col("reject_reason").isNull(), F.size("peaks"))), F.lit(0)).alias("peaks")]
    kept = screened(spectra, how).observe(seen, *counted).where("reject_reason is null").select("spec_index", "charge", "mass", "sites", "seq", "peaks")
    parts = int(spectra.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = written(kept.repartition(parts, "spec_index"), "kept")  # so many files that all cores share what is made of each row
    sizes = {r["charge"]: r["n"] for r in kept.groupBy("charge").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        raise ValueError("no annotated spectrum to train on")
    starts: dict[int, list[float]] = {}
    for c, n in sizes.items():
        groups = max(1, min(how.most_groups, n // how.least_spectra))
        found = quantile_starts(kept.where(F.col("charge") == c), ["charge"], "mass", ["spec_index"], groups).collect()
        starts[c] = sorted({float(np.float32(r["mass"])) for r in found})
    part = F.lit(0)
    for c, own in starts.items():
        for i, s in enumerate(own[1:], 1):
            part = F.when((F.col("charge") == c) & (F.col("mass") >= s), i).otherwise(part)
    kept = kept.withColumn("part", part)
    peaks = kept.select("spec_index", F.posexplode("peaks").alias("pos", "p")).select("spec_index", "pos", "p.mz", "p.intensity")
    ranks = ranked_peaks(peaks, ["pos"]).select("spec_index", "mz", "intensity", "rank")
    kinds = ion_kinds(max(sizes))
    sites = _theoretical(kept, kinds, how)
    matched = strongest_match(sites, peaks, 1.0).join(ranks, ["spec_index", "mz", "intensity"]).groupBy("spec_index", "ion").agg(F.min("rank").alias("rank"), F.first("mz").alias("hit"))
    both = sites.join(matched, ["spec_index", "ion"], "left")
    both = written(both.select("spec_index", "charge", "part", "segment", "decoy", "bond", "k", "mz", "hit", "rank"), "ions")
    bin_ = F.when(F.col("rank").isNull(), how.max_rank).otherwise(F.least("rank", F.lit(how.max_rank)) - 1)
    counts = both.groupBy("charge", "part", "segment", "decoy", "k", bin_.alias("bin")).agg(F.count("*").alias("n")).collect()
    order = sorted((c, s, float(np.float32(starts[c][p])), p) for c in sizes for s in range(how.segments) for p in range(len(starts[c])))
    model = Model(tolerance=how.tolerance, deconvolution_tolerance=how.tolerance, charges=sorted(sizes.items()), segments=how.segments, max_rank=how.max_rank, error_scale=how.error_scale)
    model.partitions = [(c, m, s) for c, s, m, _ in order]
    model.precursors = precursor_offsets(kept, peaks, how)
    table: dict[tuple, np.ndarray] = {}
    for r in counts:
        row = table.setdefault((r["charge"], r["segment"], r["part"], r["decoy"], r["k"]), np.zeros(how.max_rank + 1))
        row[r["bin"]] += r["n"]
    smooth = lambda row: ((_pooled(row) + how.rank_prior) / (row.sum() + how.rank_prior * len(row))).astype(np.float32)
    for c, s, _, p in order:
        found = []
        for k, ion in enumerate(kinds):
            row = table.get((c, s, p, False, k))
            if row is not None and row.sum():
                found.append((float(row[:-1].sum() / row.sum()), -k, ion, row))
        found.sort(key=lambda x: x[:2], reverse=True)
        chosen = [x for x in found if x[0] >= how.least_frequency][: how.most_ions] or found[:1]
        names, own = set(), []
        for f, minus, ion, row in chosen:
            fragment = Fragment(ion.prefix, ion.charge, float(np.float32(ion.offset)), float(np.float32(f)))
            if fragment.name not in names:
                names.add(fragment.name)
                own.append((fragment, row, -minus))
        noise = sum((table.get((c, s, p, True, k), np.zeros(how.max_rank + 1)) for _, _, k in own if kinds[k].charge == 1), np.zeros(how.max_rank + 1))
        noise = noise if noise.sum() else sum((table.get((c, s, p, True, k), np.zeros(how.max_rank + 1)) for _, _, k in own), np.zeros(how.max_rank + 1))
        model.fragments.append([x[0] for x in own])
        model.ranks.append(np.array([smooth(x[1]) for x in own] + [smooth(noise)]) if own else None)
    model.errors = _errors(both, kinds, order, how)
    return model, _report(model, seen.get, {(r["charge"], r["part"]): r["n"] for r in kept.groupBy("charge", "part").agg(F.count("*").alias("n")).collect()}, order)


def _report(model: Model, seen: dict, spectra: dict[tuple[int, int], int], order: list[tuple]) -> dict:
    ions: dict[str, int] = {}
    detail = []
    for (c, s, m, p), own in zip(order, model.fragments, strict=True):
        for f in own:
            ions[f.name] = ions.get(f.name, 0) + 1
        main = max(own, key=lambda f: f.frequency).name if own else None
        detail.append({"charge": c, "parent_mass": m, "segment": s, "spectra": spectra[c, p], "main_ion": main, "ions": [{"name": f.name, "frequency": f.frequency} for f in own]})
    return {
        "spectra": {"read": seen["read"], "rejected": {r: seen[r] for r in REASONS}, "kept": seen["kept"], "peaks": seen["peaks"]},
        "model": {"bytes": len(encode(model)), "partitions": len(model.partitions), "max_rank": model.max_rank, "precursor_offsets": len(model.precursors), "ion_types": dict(sorted(ions.items(), key=lambda x: (-x[1], x[0])))},
        "partitions": detail,
    }


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """As a folder with one text file of JSON, which any store takes."""
    spark.createDataFrame([(json.dumps(report, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _pooled(row: np.ndarray) -> np.ndarray:
    """Each rank's count as the mean over a tenth of the rank to either side; the bin of missing peaks as it is."""
    sums, n = np.r_[0, np.cumsum(row[:-1])], len(row) - 1
    rank = np.arange(1, n + 1)
    reach = np.floor(rank * 0.1 + 0.5).astype(int)
    low, high = np.maximum(rank - 1 - reach, 0), np.minimum(rank + reach, n)
    return np.r_[(sums[high] - sums[low]) / (high - low), row[-1]]


def _errors(both: DataFrame, kinds: list[Ion], order: list[tuple], how: Training) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of singly charged y ions: the mass errors between neighbours, and how often neither, one, the other or both are seen.

    All counts go to the partitions of a charge's mass group, whatever the segment.
    """
    y = next(k for k, i in enumerate(kinds) if not i.prefix and i.charge == 1)
    own = both.where(F.col("k") == y)
    by = Window.partitionBy("spec_index", "decoy").orderBy("bond")
    pairs = own.select("charge", "part", "decoy", "hit", "mz", F.lag("hit").over(by).alias("hit0"), F.lag("mz").over(by).alias("mz0"), F.lag("bond").over(by).alias("bond0")).where("bond0 is not null")
    state = F.col("hit").isNotNull().cast("int") + 2 * F.col("hit0").isNotNull().cast("int")
    error = F.floor(((F.col("hit0") - F.col("hit")) - (F.col("mz0") - F.col("mz"))) * how.error_scale + 0.5)
    bin_ = F.when(state == 3, F.greatest(F.least(error, F.lit(how.error_scale)), F.lit(-how.error_scale)) + how.error_scale)
    rows = pairs.groupBy("charge", "part", "decoy", state.alias("state"), bin_.alias("bin")).agg(F.count("*").alias("n")).collect()
    width = 2 * how.error_scale + 1
    out = []
    for c, _, _, p in order:
        signal, noise, exist = np.zeros(width), np.zeros(width), np.zeros(4)
        for r in rows:
            if (r["charge"], r["part"]) == (c, p):
                if not r["decoy"]:
                    exist[r["state"]] += r["n"]
                if r["bin"] is not None:
                    (noise if r["decoy"] else signal)[r["bin"]] += r["n"]
        norm = lambda x: ((x + how.error_prior) / (x.sum() + how.error_prior * width)).astype(np.float32)
        out.append((norm(signal), norm(noise), np.maximum((exist + 0.5) / (exist.sum() + 2), 1e-4).astype(np.float32)))
    return out
