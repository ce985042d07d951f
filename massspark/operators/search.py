"""Search of spectra against candidates, rescoring of match lists, and their evaluation tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massspark.functions.chem import ISOTOPE, MASSES, PROTON, Tolerance, is_decoy_match, peptide_key, peptide_string, residues, rescore_cleavage, search_cleavage
from massspark.operators.digest import TRYPSIN, Digest, composition, digest
from massspark.operators.fdr import assign_q_values
from massspark.operators.mass_index import MassIndex
from massspark.operators.matching import Mods, candidate_windows, candidates, isotope_windows, last_by_scan, with_charges
from massspark.operators.scoring import Alphabet, Spectrum, build_graph, distribution, nominal, precursor_mass, tail
from massspark.operators.staging import written
from massspark.operators.tails import certified, saddlepoint
from massspark.sources.bundled import resolve_model
from massspark.sources.model import Model


@dataclass(frozen=True)
class Tails:
    """What is made of score distributions besides the exact tail.

    estimate: the columns spec_estimate and spec_bound, a saddlepoint estimate and a bound, beside it. cap or share: pruning with
    loss, as certified() does it; the tail then may be too small by the column spec_error at most.
    """

    estimate: bool = False
    cap: int | None = None
    share: float | None = None

    @property
    def lossy(self) -> bool:
        return self.cap is not None or self.share is not None

    @property
    def columns(self) -> list[str]:
        return ["spec_estimate", "spec_bound"] * self.estimate + ["spec_error"] * self.lossy


@dataclass(frozen=True)
class Search:
    tolerance: Tolerance = Tolerance(10.0)
    isotopes: tuple[int, int] = (0, 1)
    charges: tuple[int, int] = (2, 3)
    matches: int = 1
    digest: Digest = Digest(max_missed=2)
    mods: Mods = Mods()
    decoy_prefix: str = "XXX_"
    tails: Tails = Tails()


def _sites(mods: Mods):
    """(aa, delta) of a placed peptide: fixed and variable changes together."""
    fixed = F.create_map(*[F.lit(x) for r, d in mods.fixed().items() for x in (r, float(d))])
    mass = F.array(*[F.lit(float(m.mass)) for m in mods.mods]) if mods.mods else F.array(F.lit(0.0))
    letters = F.transform(F.sequence(F.lit(0), F.length("peptide") - 1), lambda i: F.struct(
        F.substring("peptide", i + 1, F.lit(1)).alias("aa"),
        (F.element_at(fixed, F.substring("peptide", i + 1, F.lit(1))) + F.aggregate(F.filter("placement", lambda p: p["pos"] == i), F.lit(0.0), lambda a, p: a + F.get(mass, p["mod"]))).alias("delta")))
    return letters


_MASS = np.full(128, np.nan)
for _r, _m in MASSES.items():
    _MASS[ord(_r)] = _m


def _sums(peptide: str, delta) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of a peptide's nominal and accurate residue masses, with changes if there are any."""
    each = _MASS[np.frombuffer(peptide.encode("ascii"), np.uint8)]
    each = each if delta is None else each + np.asarray(delta, float)
    return np.cumsum(nominal(each)), np.cumsum(each)


_SCORED = "spec_index long, charge int, raw_score int, denovo_score int, spec_evalue double"


def _kernel(model: Model, alphabet: Alphabet, isotopes: tuple[int, int], keep: int, flank: float | None, cleave_at: str, carried: list[str], tails: Tails):
    """For one (spectrum, charge): the best candidates, with what is carried along of them and the chance of their scores."""

    def run(key, spectrum: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c: [] for c in ("spec_index", "charge", "raw_score", "denovo_score", "spec_evalue", *tails.columns, *carried)})
        if not len(spectrum) or not len(found):
            return empty
        s = spectrum.iloc[0]
        charge = int(s["charge"])
        mass = precursor_mass(s["precursor_mz"], charge)
        whole = int(nominal(mass - np.float32(18.010565)))
        if not 50 <= whole <= 10_000:
            return empty
        sums = [_sums(a, d) for a, d in zip(found["letters"], found["delta"], strict=True)]
        top = max([whole - isotopes[0], *(int(n[-1]) for n, _ in sums)]) + 1
        scored = Spectrum(model, charge, mass, s["mz"], s["intensity"], top)
        raw = np.array([scored.raw_score(n, a) for n, a in sums]) + found["cleavage"].to_numpy()
        rows = found[carried].assign(raw=raw)
        if keep:
            forms = rows.sort_values(["raw", "form"], ascending=[False, True])["form"].drop_duplicates().head(keep)
            rows = rows[rows["form"].isin(forms)]
        sinks = [whole - k for k in range(isotopes[0], isotopes[1] + 1)]
        graph = build_graph(scored, whole, sinks, alphabet, cleave_at)
        worst = int(rows["raw"].min())
        made = None if graph is None else certified(graph, worst, flank, tails.cap, tails.share) if tails.lossy else distribution(graph, worst, flank)
        if made is None:
            return empty
        chance = {r: tail(made.low, made.chances, int(r)) for r in rows["raw"].unique()}
        out = {"spec_index": s["spec_index"], "charge": charge, "raw_score": rows["raw"], "denovo_score": made.best, "spec_evalue": rows["raw"].map(chance)}
        if tails.estimate:
            saddles = {r: saddlepoint(graph, int(r), flank) for r in rows["raw"].unique()}
            out |= {"spec_estimate": rows["raw"].map(lambda r: saddles[r].estimate), "spec_bound": rows["raw"].map(lambda r: saddles[r].bound)}
        if tails.lossy:
            out["spec_error"] = made.error
        return pd.DataFrame(out | {c: rows[c] for c in carried})

    return run


def _spectra(rows: DataFrame) -> DataFrame:
    return rows.select("spec_index", "charge", "precursor_mz", F.transform("peaks", lambda p: p["mz"]).alias("mz"), F.transform("peaks", lambda p: p["intensity"]).alias("intensity"))


def _cogrouped(spectra: DataFrame, found: DataFrame, kernel, schema: str) -> DataFrame:
    """The kernel over each (spectrum, charge) and its candidates. The number of partitions is given, since adaptive execution
    goes by bytes and would put the few bytes of many dear distributions into one task."""
    parts = int(spectra.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = _spectra(spectra).repartition(parts, "spec_index", "charge").groupBy("spec_index", "charge")
    return left.cogroup(found.repartition(parts, "s", "z").groupBy("s", "z")).applyInPandas(kernel, schema)


def search_candidates(proteins: DataFrame, how: Search = Search()) -> DataFrame:
    """form, letters, delta, cleavage, mass, accession, start, pre, post of every form of every peptide: what an index is built of."""
    enzyme = how.digest.enzyme
    flat = candidates(digest(proteins, how.digest), how.mods)
    flat = flat.withColumn("cleavage", search_cleavage(F.col("pre"), F.col("peptide"), F.col("prot_n"), (F.col("start") == 1) & (F.col("pre") == "M"), enzyme.cleave_at or "KR") if enzyme.cleave_at and enzyme.c_term else F.lit(0))
    if how.mods.mods:
        flat = flat.withColumn("sites", _sites(how.mods)).withColumns({"form": peptide_string(F.col("sites")), "delta": F.transform("sites", lambda x: x["delta"])})
    else:
        flat = flat.withColumns({"form": F.col("peptide"), "delta": F.lit(None).cast("array<double>")})
    return flat.select("form", F.col("peptide").alias("letters"), "delta", "cleavage", "mass", "accession", "start", "pre", "post")


def search(spectra: DataFrame, proteins: DataFrame, model: Model | str | None = None, how: Search = Search(), index: MassIndex | None = None) -> DataFrame:
    """The best peptides of each spectrum with scores, E-values and q-values.

    proteins holds targets and decoys. Candidates meet spectra in a join by mass bins or, where an index of search_candidates()
    is given, by a sweep over it, which saves digesting for every search. Those of one spectrum and charge are scored together, so
    its tables and distribution are made once. Equal peptides of several proteins are one match. Without a model or the path of
    one, the bundled one is taken; model_source tells which it was.
    """
    model, source = resolve_model(spectra.sparkSession, model)
    enzyme = how.digest.enzyme
    carried = ["form", "isotope", "mass", "accession", "start", "pre", "post"]
    charged = with_charges(spectra, *how.charges)
    asked = charged.select("spec_index", "charge", "precursor_mz")
    if index is None:  # written: they are counted as well as joined, and digestion is the dearer part
        flat = written(search_candidates(proteins, how), "candidates")
        pairs, size = candidate_windows(asked, flat, how.tolerance, how.isotopes), flat.count()
    else:
        pairs, size = index.matches(isotope_windows(asked, how.tolerance, how.isotopes), "low", "high"), index.count()
    shares = {r["residue"]: r["frequency"] for r in composition(proteins).collect()}  # twenty rows
    alphabet = Alphabet(how.mods.fixed(), [(m.residues, m.mass) for _, m in how.mods.variable() if m.position == "any"], shares)
    cleave = enzyme.cleave_at if enzyme.c_term else ""
    flank = sum(shares[r] for r in cleave) if cleave else None
    kernel = _kernel(model, alphabet, how.isotopes, how.matches, flank, cleave, carried, how.tails)
    grouped = pairs.select(F.col("spec_index").alias("s"), F.col("charge").alias("z"), "letters", "delta", "cleavage", *carried)
    schema = _SCORED + "".join(f", {c} double" for c in how.tails.columns) + ", form string, isotope int, mass double, accession string, start int, pre string, post string"
    hits = _cogrouped(charged, grouped, kernel, schema)
    order = F.struct((-F.col("raw_score")).alias("r"), F.abs("isotope"), "mass", "accession", "start")
    rolled = hits.groupBy("spec_index", "charge", "form").agg(F.min_by(F.struct("raw_score", "denovo_score", "spec_evalue", *how.tails.columns, "isotope", "mass", "pre", "post"), order).alias("best"), F.array_sort(F.collect_set("accession")).alias("proteins"))
    best = Window.partitionBy("spec_index").orderBy("best.spec_evalue", F.desc("best.raw_score"), "form", "charge")
    top = rolled.withColumn("place", F.row_number().over(best)).where(F.col("place") <= how.matches)
    about = spectra.select("spec_file", "spec_index", "title", "scan", "precursor_mz")
    out = top.select("spec_index", "charge", "form", "best.*", "proteins").join(about, "spec_index")
    observed = (F.col("precursor_mz") - PROTON) * F.col("charge") - F.col("isotope") * ISOTOPE
    out = out.select(
        "spec_file", "spec_index", "title", "scan", "precursor_mz", "isotope", ((observed - F.col("mass")) / F.col("mass") * 1e6).alias("precursor_error"), "charge",
        F.concat("pre", F.lit("."), "form", F.lit("."), "post").alias("flanked"), "proteins", "denovo_score", "raw_score", "spec_evalue", *how.tails.columns, (F.col("spec_evalue") * size).alias("evalue"), F.lit(source).alias("model_source"),
    )
    matches = written(out, "matches").withColumns({"score": F.col("spec_evalue").cast("float"), "peptide": peptide_key(F.col("flanked")), "is_decoy": is_decoy_match(F.col("proteins"), how.decoy_prefix)})
    return assign_q_values(matches).drop("score", "peptide").withColumnRenamed("flanked", "peptide")


def rescore(matches: DataFrame, spectra: DataFrame, model: Model | str | None = None, isotopes: tuple[int, int] = (0, 0), frequency: dict[str, float] | None = None, db_size: int | None = None, tails: Tails = Tails()) -> DataFrame:
    """A match list (input_pos, scan, peptide, charge, ...) with status, raw_score, denovo_score, spec_evalue[, evalue] and the columns of tails.

    status: scored, or the first reason against it: no spectrum, no charge, bad peptide, no distribution. Every row and
    column of the input stays, in its order by input_pos, so that the result can go on to fdr(). model as in search(), without a
    column that names it, as rows go on to be written as they came.
    """
    model, _ = resolve_model(spectra.sparkSession, model)
    known = last_by_scan(spectra).select("scan", "spec_index", "precursor_mz", "peaks", F.col("charge").alias("own_charge"))
    rows = matches.join(known, "scan", "left").withColumn("charge", F.coalesce("charge", "own_charge"))
    core = F.regexp_replace(F.regexp_replace("peptide", r"^[A-Za-z_-]\.", ""), r"\.[A-Za-z_-]$", "")
    rows = rows.withColumns({"sites": residues(core), "cleavage": rescore_cleavage(F.col("peptide"))})
    reason = F.when(F.col("spec_index").isNull(), "no spectrum").when(F.col("charge").isNull(), "no charge").when(F.col("sites").isNull(), "bad peptide")
    rows = rows.withColumn("status", reason)
    good = rows.where("status is null")
    found = good.select(F.col("spec_index").alias("s"), F.col("charge").alias("z"), F.col("input_pos").alias("candidate"), "cleavage", F.array_join(F.transform("sites", lambda x: x["aa"]), "").alias("letters"), F.transform("sites", lambda x: x["delta"]).alias("delta"))
    units = good.select("spec_index", "charge", "precursor_mz", "peaks").dropDuplicates(["spec_index", "charge"])
    alphabet = Alphabet(frequency=frequency)
    flank = float(sum(p for r, p in zip(alphabet.residues, alphabet.probability, strict=True) if r in TRYPSIN.cleave_at))
    kernel = _kernel(model, alphabet, isotopes, 0, flank, TRYPSIN.cleave_at, ["candidate"], tails)
    scored = _cogrouped(units, found, kernel, _SCORED + "".join(f", {c} double" for c in tails.columns) + ", candidate long")
    out = rows.drop("sites", "cleavage", "peaks", "own_charge", "precursor_mz", "spec_index").join(scored.select(F.col("candidate").alias("input_pos"), "raw_score", "denovo_score", "spec_evalue", *tails.columns), "input_pos", "left")
    out = out.withColumn("status", F.coalesce("status", F.when(F.col("raw_score").isNull(), "no distribution").otherwise("scored")))
    return out.withColumn("evalue", F.col("spec_evalue") * db_size) if db_size else out
