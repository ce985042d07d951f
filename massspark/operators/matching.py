"""Candidates, modifications and the joins that bring them to spectra."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massspark.functions.chem import ATOMS, ISOTOPE, PROTON, RESIDUES, WATER, Tolerance, letters, masses, running

POSITIONS = ("any", "N-term", "C-term", "Prot-N-term", "Prot-C-term")
#: Forms of a peptide, the plain one with them, and modifications on one form.
MAX_FORMS, MAX_PLACED = 4096, 4


def mass_or_formula(text: str) -> float:
    """A number, or a composition such as `C2H3N1O1` (counts may be negative)."""
    try:
        return float(text)
    except ValueError:
        pass
    parts = re.findall(r"(Br|Cl|Fe|Se|[CHNOSP])(-?\d*)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"`{text}` is neither a mass nor a composition")
    unknown = [a for a, _ in parts if a not in ATOMS]
    if unknown:
        raise ValueError(f"`{text}`: no mass for {unknown[0]}")
    return sum(ATOMS[a] * (int(b) if b not in ("", "-") else int(b + "1")) for a, b in parts)


@dataclass(frozen=True)
class Mod:
    mass: float
    residues: str  # empty: all
    fixed: bool
    position: str = "any"
    name: str = ""

    @classmethod
    def parse(cls, line: str) -> Mod:
        """`mass-or-formula,residues,fix|opt,position,name`, or the short form `C+57.02` (fixed)."""
        short = re.fullmatch(r"([A-Z*])([+-][0-9.]+)", line.strip())
        if short:
            return cls(float(short[2]), short[1].replace("*", ""), True, "any", line.strip())
        f = [x.strip() for x in line.split(",")]
        if len(f) != 5:
            raise ValueError(f"modification `{line}`: expected five fields")
        plain = re.sub(r"[^a-z]", "", f[3].lower())
        position = {"any": 0, "nterm": 1, "cterm": 2, "protnterm": 3, "protcterm": 4, "proteinnterm": 3, "proteincterm": 4}.get(plain)
        if position is None:
            raise ValueError(f"modification `{line}`: unknown position `{f[3]}`")
        if f[2].lower() not in ("fix", "opt"):
            raise ValueError(f"modification `{line}`: `{f[2]}` is neither fix nor opt")
        if set(f[1].replace("*", "")) - set(RESIDUES):
            raise ValueError(f"modification `{line}`: unknown residues `{f[1]}`")
        return cls(mass_or_formula(f[0]), f[1].replace("*", ""), f[2].lower() == "fix", POSITIONS[position], f[4])


@dataclass(frozen=True)
class Mods:
    mods: tuple[Mod, ...] = ()
    most: int = 2

    @classmethod
    def parse(cls, text: str) -> Mods:
        """Lines of modifications, `NumMods=N`, and comments behind `#`."""
        mods, most = [], 2
        for n, line in enumerate(text.splitlines(), 1):
            line = line.split("#")[0].strip()
            try:
                if line.lower().startswith("nummods="):
                    most = int(line.split("=", 1)[1])
                elif line:
                    mods.append(Mod.parse(line))
            except ValueError as e:
                raise ValueError(f"line {n}: {e}") from e
        return cls(tuple(mods), most)

    def fixed(self) -> dict[str, float]:
        """Mass change of each residue by fixed modifications of any position."""
        return {r: sum(m.mass for m in self.mods if m.fixed and m.position == "any" and r in (m.residues or RESIDUES)) for r in RESIDUES}

    def variable(self) -> list[tuple[int, Mod]]:
        return [(i, m) for i, m in enumerate(self.mods) if not m.fixed]


def _sites(mods: Mods) -> Column:
    """All (pos, mod, mass) that a variable modification could take, modification by modification."""
    return F.concat(*[_own_sites(i, m) for i, m in mods.variable()]) if mods.variable() else F.array().cast("array<struct<pos:int,mod:int,mass:double>>")


def _own_sites(i: int, m: Mod) -> Column:
    end = F.length("peptide") - 1

    def fits(p: Column) -> Column:
        place = {"any": F.lit(True), "N-term": p == 0, "C-term": p == end, "Prot-N-term": (p == 0) & F.col("prot_n"), "Prot-C-term": (p == end) & F.col("prot_c")}[m.position]
        return place & (F.instr(F.lit(m.residues), F.substring("peptide", p + 1, F.lit(1))) > 0) if m.residues else place

    return F.transform(F.filter(F.sequence(F.lit(0), end), fits), lambda p: F.struct(p.alias("pos"), F.lit(i).alias("mod"), F.lit(m.mass).alias("mass")))


def _form_count(most: int) -> Column:
    """How many forms the sites allow: sets of up to `most` of them with one to a residue, counted residue by residue."""
    many = F.transform(F.array_distinct(F.transform("_sites", lambda s: s["pos"])), lambda p: F.size(F.filter("_sites", lambda s: s["pos"] == p)).cast("double"))
    start = F.array(*[F.lit(float(k == 0)) for k in range(most + 1)])
    sums = F.aggregate(many, start, lambda e, c: F.transform(e, lambda x, k: x + F.when(k > 0, c * F.get(e, k - 1)).otherwise(0.0)))
    return F.aggregate(sums, F.lit(0.0), lambda a, x: a + x).cast("long")


def placements(peptides: DataFrame, mods: Mods) -> DataFrame:
    """peptides with placement (array of pos, mod), delta and skipped: a row for each form, the plain one included.

    Sets of up to `most` sites with one modification to a residue, grown a site at a time. A peptide has MAX_FORMS forms at most,
    in depth-first order of its sites; skipped is how many more there are. A form that has MAX_FORMS forms of as many sites before
    it is not among the first ones, so no more than that many (and what one form grows to) are made of each number of sites.
    """
    most = min(mods.most, MAX_PLACED)
    empty = F.array().cast("array<struct<i:int,pos:int,mod:int,mass:double>>")
    sites = F.transform(_sites(mods), lambda s, i: F.struct(i.alias("i"), s["pos"].alias("pos"), s["mod"].alias("mod"), s["mass"].alias("mass")))
    rows = peptides.withColumn("_sites", sites).withColumns({"_level": F.array(empty), "_forms": F.array(empty), "_count": _form_count(most)})
    last = lambda form: F.coalesce(F.try_element_at(form, F.lit(-1))["i"], F.lit(-1))
    grows = lambda form: F.filter("_sites", lambda s: (last(form) < s["i"]) & ~F.exists(form, lambda x: x["pos"] == s["pos"]))
    for _ in range(most):
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"))
        enough = F.aggregate("_level", start, lambda a, form: F.when(a["n"] < MAX_FORMS, F.struct((a["n"] + F.size(grows(form))).alias("n"), (a["k"] + 1).alias("k"))).otherwise(a))["k"]
        grown = F.flatten(F.transform(F.slice("_level", F.lit(1), enough), lambda form: F.transform(grows(form), lambda s: F.concat(form, F.array(s)))))
        rows = rows.withColumn("_level", F.slice(grown, 1, MAX_FORMS)).withColumn("_forms", F.concat("_forms", "_level"))
    order = F.array_sort(F.transform("_forms", lambda form: F.struct(F.transform(form, lambda s: s["i"]).alias("by"), form.alias("form"))))
    forms = rows.withColumn("skipped", F.greatest(F.col("_count") - MAX_FORMS, F.lit(0))).withColumn("_form", F.explode(F.slice(order, 1, MAX_FORMS))).withColumn("_form", F.col("_form.form"))
    delta = F.aggregate("_form", F.lit(0.0), lambda a, s: a + s["mass"])
    return forms.withColumns({"placement": F.transform("_form", lambda s: F.struct(s["pos"].alias("pos"), s["mod"].alias("mod"))), "delta": delta}).drop("_sites", "_level", "_forms", "_form", "_count")


def candidates(peptides: DataFrame, mods: Mods = Mods()) -> DataFrame:
    """placements() with mass: water, the residues with fixed changes from the left, then the placement's change."""
    table = masses(mods.fixed())
    base = F.aggregate(letters(F.col("peptide")), F.lit(WATER), lambda a, r: a + F.element_at(table, r))
    return placements(peptides, mods).withColumn("mass", base + F.col("delta"))


def range_join(left: DataFrame, right: DataFrame, low: str, high: str, value: str, width: float) -> DataFrame:
    """Rows of left and right with left.low <= right.value <= left.high, as an equal join on bins of the width.

    An interval is repeated for every bin it touches, so a width of about an interval makes one to two rows of it. Dense
    bins are split by adaptive execution like any skewed key.
    """
    bins = F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    spread = left.where(F.col(low) <= F.col(high)).withColumn("_bin", bins)
    keyed = right.withColumn("_bin", F.floor(F.col(value) / width))
    return spread.join(keyed, "_bin").where(F.col(value).between(F.col(low), F.col(high))).drop("_bin")


def isotope_windows(spectra: DataFrame, tolerance: Tolerance, isotopes: tuple[int, int] = (0, 1)) -> DataFrame:
    """spectra (precursor_mz, charge) with isotope, target, low, high: a row for each isotope error."""
    neutral = (F.col("precursor_mz") - PROTON) * F.col("charge")
    rows = spectra.withColumn("isotope", F.explode(F.sequence(F.lit(isotopes[0]), F.lit(isotopes[1])))).withColumn("target", neutral - F.col("isotope") * ISOTOPE)
    low, high = tolerance.bounds(F.col("target"))
    return rows.withColumns({"low": low, "high": high})


def candidate_windows(spectra: DataFrame, peptides: DataFrame, tolerance: Tolerance, isotopes: tuple[int, int] = (0, 1)) -> DataFrame:
    """Every candidate (mass) inside a window of a spectrum."""
    return range_join(isotope_windows(spectra, tolerance, isotopes), peptides, "low", "high", "mass", 1.0)


def with_charges(spectra: DataFrame, low: int = 2, high: int = 3) -> DataFrame:
    """Spectra that have a precursor; one without a charge once for each charge of the range."""
    charges = F.when(F.col("charge") > 0, F.array("charge")).otherwise(F.sequence(F.lit(low), F.lit(high)))
    return spectra.where("precursor_mz is not null").withColumn("charge", F.explode(charges))


def last_by_scan(spectra: DataFrame) -> DataFrame:
    """The last spectrum of each scan that has a precursor."""
    found = spectra.where("scan is not null and precursor_mz is not null")
    names = [c for c in spectra.columns if c != "scan"]
    best = found.groupBy("scan").agg(F.max_by(F.struct(*names), "spec_index").alias("s"))
    return best.select("scan", "s.*")


def top_hits(hits: DataFrame, n: int, by: list[str], order: list[Column]) -> DataFrame:
    return hits.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


@dataclass(frozen=True)
class Ion:
    """A kind of fragment: b side or y side, a charge, and what is added to residues / charge."""

    prefix: bool
    charge: int
    offset: float
    name: str = field(default="")


def ion_kinds(charge: int) -> list[Ion]:
    """b and y ions, plain or with a loss of water, ammonia or CO or one or two isotope steps, at charges up to `charge`."""
    water, ammonia, co = WATER, ATOMS["N"] + 3 * ATOMS["H"], ATOMS["C"] + ATOMS["O"]
    changes = {"": 0.0, "-H2O": -water, "-NH3": -ammonia, "-CO": -co, "+i": ISOTOPE, "+2i": 2 * ISOTOPE}
    return [Ion(prefix, z, ((0.0 if prefix else water) + d) / z + PROTON, f"{'b' if prefix else 'y'}{n}_{z}") for z in range(1, charge + 1) for prefix in (True, False) for n, d in changes.items()]


def ladder(peptides: DataFrame, suffix: bool = False) -> DataFrame:
    """peptide, i, mz1, mz2 of b ions, or of y ions if suffix: a row for each proper part of 1, 2, ... residues."""
    seq = F.reverse("peptide") if suffix else F.col("peptide")
    own = F.transform(F.slice(letters(seq), F.lit(1), F.length("peptide") - 1), lambda r: F.element_at(masses(), r))
    sums = running(own, F.lit(WATER if suffix else 0.0))
    rows = peptides.where(F.length("peptide") > 1).select("peptide", F.posexplode(sums).alias("i", "sum"))
    return rows.select("peptide", (F.col("i") + 1).alias("i"), (F.col("sum") + PROTON).alias("mz1"), ((F.col("sum") + 2 * PROTON) / 2).alias("mz2"))


def ranked_peaks(peaks: DataFrame, ties: list[str]) -> DataFrame:
    """peaks (spec_index, mz, intensity) with rank: by falling intensity, then falling mz, then `ties`."""
    return peaks.withColumn("rank", F.row_number().over(Window.partitionBy("spec_index").orderBy(F.desc("intensity"), F.desc("mz"), *ties)))


def simple_rank(peaks: DataFrame, position: str) -> DataFrame:
    """The same with ties in the order of the input."""
    return peaks.withColumn("rank", F.row_number().over(Window.partitionBy("spec_index").orderBy(F.desc("intensity"), position)))


def strongest_match(theoretical: DataFrame, peaks: DataFrame, width: float) -> DataFrame:
    """For each (spec_index, ion, low, high) the most intense peak inside, the greatest mz of equals; none if there is none.

    The join is sorted: Spark takes rows repeated by bins to be as small as the table they come from, and would send them through the driver.
    """
    bins = F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width)))
    spread = theoretical.select("spec_index", "ion", "low", "high", bins.alias("_bin"))
    keyed = peaks.select("spec_index", F.floor(F.col("mz") / width).alias("_bin"), "mz", "intensity")
    found = spread.hint("merge").join(keyed, ["spec_index", "_bin"]).where("mz between low and high")
    return found.groupBy("spec_index", "ion").agg(F.max(F.struct("intensity", "mz")).alias("best")).select("spec_index", "ion", F.col("best.mz").alias("mz"), F.col("best.intensity").alias("intensity"))


def away_from(rows: DataFrame, others: DataFrame, by: list[str], value: str, reach: int = 1) -> DataFrame:
    """Rows whose whole-number value is more than `reach` from every value of the others with equal `by`: an anti join on
    the others' neighbourhoods, each listed once. Sorted, as in strongest_match()."""
    near = others.select(*by, F.explode(F.sequence(F.col(value) - reach, F.col(value) + reach)).alias(value)).distinct()
    return rows.join(near.hint("merge"), [*by, value], "left_anti")
