"""Peptide chemistry as column expressions: masses, grids, tolerances, ladders."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Monoisotopic atom masses, the proton and the electron, in Da.
ATOMS = {"H": 1.0078250319, "C": 12.0, "N": 14.0030740052, "O": 15.9949146221, "S": 31.97207073, "P": 30.973761512}
PROTON, ELECTRON = 1.0072764669, 0.0005485799
WATER = 2.0 * ATOMS["H"] + ATOMS["O"]
#: Mass between the isotopes of a precursor.
ISOTOPE = 1.003354838
#: Bins per Da of the low- and high-resolution grids, single precision.
NOMINAL, HIGH_RESOLUTION = 0.999497, 274.335215

# Atoms (C, H, N, O, S) of each amino-acid residue.
FORMULAS = {
    "G": (2, 3, 1, 1, 0), "A": (3, 5, 1, 1, 0), "S": (3, 5, 1, 2, 0), "P": (5, 7, 1, 1, 0), "V": (5, 9, 1, 1, 0),
    "T": (4, 7, 1, 2, 0), "C": (3, 5, 1, 1, 1), "L": (6, 11, 1, 1, 0), "I": (6, 11, 1, 1, 0), "N": (4, 6, 2, 2, 0),
    "D": (4, 5, 1, 3, 0), "Q": (5, 8, 2, 2, 0), "K": (6, 12, 2, 1, 0), "E": (5, 7, 1, 3, 0), "M": (5, 9, 1, 1, 1),
    "H": (6, 7, 3, 1, 0), "F": (9, 9, 1, 1, 0), "R": (6, 12, 4, 1, 0), "Y": (9, 9, 1, 2, 0), "W": (11, 10, 2, 1, 0),
}
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"


def residue_mass(aa: str) -> float | None:
    """Monoisotopic mass of one residue in either case; None for other letters."""
    atoms = FORMULAS.get(aa.upper())
    return None if atoms is None else sum(n * ATOMS[x] for n, x in zip(atoms, "CHNOS", strict=True))


MASSES = {aa: residue_mass(aa) for aa in RESIDUES}


def masses(delta: dict[str, float] | None = None) -> Column:
    """A literal map from residue to mass, with fixed modifications added."""
    return F.create_map(*[F.lit(x) for aa in RESIDUES for x in (aa, MASSES[aa] + (delta or {}).get(aa, 0.0))])


def is_standard(peptide: Column) -> Column:
    return peptide.rlike(f"^[{RESIDUES}]+$")


def letters(sequence: Column) -> Column:
    return F.filter(F.split(sequence, ""), lambda x: x != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, start: Column) -> Column:
    """The sums of the first, of the first two and so on, from the left, each on top of `start`."""
    none = F.slice(F.array(start), 1, 0)
    return F.aggregate(values, none, lambda a, x: F.array_append(a, F.when(F.size(a) > 0, F.get(a, F.size(a) - 1)).otherwise(start) + x))


def neutral_mass(peptide: Column, delta: dict[str, float] | None = None) -> Column:
    """Water and the residues, summed from the left; null if a letter isn't a standard residue."""
    table = masses(delta)
    return F.aggregate(letters(F.upper(peptide)), F.lit(WATER), lambda total, aa: total + F.try_element_at(table, aa))


def mz(mass: Column, charge: Column | int) -> Column:
    return (mass + F.lit(charge) * PROTON) / F.lit(charge)


def _float(x) -> Column:
    return F.lit(x).cast("float")


def nominal_bin(mass: Column) -> Column:
    """The low-resolution bin: a single-precision product, ties away from zero."""
    return F.round((mass.cast("float") * _float(NOMINAL)).cast("float")).cast("int")


def nominal_to_mass(bin_: Column) -> Column:
    return (bin_.cast("float") / _float(NOMINAL)).cast("float")


def high_resolution_bin(mass: Column) -> Column:
    return F.round((mass.cast("float") * _float(HIGH_RESOLUTION)).cast("float")).cast("int")


def round_half_up(x: Column) -> Column:
    return F.floor(x.cast("float") + _float(0.5)).cast("int")


@dataclass(frozen=True)
class Tolerance:
    """A mass tolerance in Da or in millionths of the theoretical mass."""

    value: float
    ppm: bool = True

    def window(self, mass: Column | float) -> Column | float:
        return mass * self.value / 1e6 if self.ppm else (F.lit(self.value) if isinstance(mass, Column) else self.value)

    def bounds(self, mass: Column) -> tuple[Column, Column]:
        return mass - self.window(mass), mass + self.window(mass)

    def matches(self, theoretical: Column, observed: Column) -> Column:
        return F.abs(observed - theoretical) <= self.window(theoretical)

    @classmethod
    def parse(cls, text: str) -> Tolerance:
        """`10ppm`, `0.5Da` or a bare number of ppm."""
        t = text.strip().lower()
        for unit, ppm in (("ppm", True), ("da", False)):
            if t.endswith(unit):
                return cls(float(t[: -len(unit)]), ppm)
        return cls(float(t))


def parse_pair(text: str) -> tuple[int, int]:
    """`0,1`: two whole numbers, the first not above the second."""
    low, high = (int(x) for x in text.split(","))
    if low > high:
        raise ValueError(f"`{text}`: the first must not be above the second")
    return low, high


def strip_context(peptide: Column) -> Column:
    """`K.PEPTIDE.R` without its flanks; other strings as they are."""
    flanked = (F.length(peptide) >= 4) & (F.substring(peptide, 2, 1) == ".") & (F.substring(peptide, -2, 1) == ".")
    return F.when(flanked, F.substring(peptide, F.lit(3), F.length(peptide) - 4)).otherwise(peptide)


def peptide_key(peptide: Column) -> Column:
    return F.upper(strip_context(peptide))


def is_decoy_match(proteins: Column, prefix: str) -> Column:
    """There are proteins and all carry the prefix."""
    return (F.size(proteins) > 0) & F.forall(proteins, lambda p: p.startswith(prefix))


def decoy_prefix(prefix: str) -> str:
    return prefix.rstrip("_") + "_"


_ANY_CASE = RESIDUES + RESIDUES.lower()
_SITE = r"[A-Za-z](?:[+-][0-9.]+)*"


def residues(peptide: Column, leading: bool = False) -> Column:
    """An array of (aa, delta) of a peptide with inline mass changes, `PEP+15.99TIDE`; null if it doesn't parse.

    leading: white space is dropped and a change before the first letter belongs to the first residue, as in annotated
    spectra; otherwise such a string doesn't parse.
    """
    p = F.regexp_replace(peptide, r"\s", "") if leading else peptide
    if leading:
        p = F.regexp_replace(p, r"^((?:[+-][0-9.]+)+)([A-Za-z])", "$2$1")

    def site(text: Column) -> Column:
        deltas = F.regexp_extract_all(text, F.lit(r"([+-][0-9.]+)"), 1)
        total = F.when(F.length(text) > 1, F.aggregate(deltas, F.lit(0.0), lambda a, d: a + d.try_cast("double"))).otherwise(0.0)
        return F.struct(F.upper(F.substring(text, 1, 1)).alias("aa"), total.alias("delta"))

    def parsed(text: Column) -> Column:
        plain = F.transform(F.split(F.upper(text), ""), lambda x: F.struct(x.alias("aa"), F.lit(0.0).alias("delta")))
        changed = let(F.transform(F.regexp_extract_all(text, F.lit(f"({_SITE})"), 1), site), lambda sites: F.when(F.forall(sites, lambda s: s["delta"].isNotNull()), sites))
        return F.when(text.rlike(f"^[{_ANY_CASE}]+\\z"), plain).when(text.rlike(f"^(?:[{_ANY_CASE}](?:[+-][0-9.]+)*)+$"), changed)

    return let(p, parsed)


def num_mods(sites: Column) -> Column:
    return F.size(F.filter(sites, lambda s: s["delta"] != 0))


def site_mass(site: Column) -> Column:
    return F.element_at(masses(), site["aa"]) + site["delta"]


def accurate_prefix_masses(sites: Column) -> Column:
    """Running sums of residue masses."""
    return running(F.transform(sites, site_mass), F.lit(0.0))


def nominal_prefix_masses(sites: Column) -> Column:
    """Running sums of residues' nominal bins: each residue is binned, then summed."""
    return running(F.transform(sites, lambda s: nominal_bin(site_mass(s))), F.lit(0))


def precursor_error_ppm(observed: Column, theoretical: Column, isotope: Column) -> Column:
    return (observed - isotope * ISOTOPE - theoretical) / theoretical * 1e6


def peptide_string(sites: Column, before: Column | None = None, after: Column | None = None) -> Column:
    """Residues with `+15.995` changes, between flanks if given (`-` for a protein's end)."""
    core = F.array_join(F.transform(sites, lambda s: F.when(s["delta"] != 0, F.concat(s["aa"], F.format_string("%+.3f", s["delta"]))).otherwise(s["aa"])), "")
    return core if before is None else F.concat(before, F.lit("."), core, F.lit("."), after)


CREDIT, PENALTY = 2, -11


def _in(letter: Column, cleave_at: str) -> Column:
    return reduce(lambda a, c: a | (letter == c), cleave_at, F.lit(False))


def search_cleavage(pre: Column, peptide: Column, prot_n: Column, after_met: Column, cleave_at: str = "KR") -> Column:
    """Credit or penalty of both ends in a search: the start of a protein, with or without its M, counts as cleaved."""
    start = prot_n | after_met | _in(pre, cleave_at)
    end = _in(F.substring(peptide, -1, 1), cleave_at)
    return sum(F.when(x, CREDIT).otherwise(PENALTY) for x in (start, end))


def rescore_cleavage(flanked: Column) -> Column:
    """The same from a match list's string, by trypsin: no flank or `-` before counts as cleaved."""
    pre = F.when(strip_context(flanked) != flanked, F.substring(flanked, 1, 1)).otherwise(F.lit("-"))
    last = F.substring(F.regexp_replace(strip_context(flanked), r"[+-][0-9.]+", ""), -1, 1)
    return sum(F.when(x, CREDIT).otherwise(PENALTY) for x in (_in(pre, "KR-"), _in(last, "KR")))


def ion_mz(residue_sum: Column, offset: Column | float, charge: Column | int) -> Column:
    return (residue_sum / F.lit(charge) + F.lit(offset)).cast("float")


def ion_mass(mz_: Column, offset: Column | float, charge: Column | int) -> Column:
    return ((mz_ - F.lit(offset)) * F.lit(charge)).cast("float")


def tic(peaks: Column) -> Column:
    return F.aggregate(peaks, F.lit(0.0), lambda a, p: a + p["intensity"])


def canonical_peaks(peaks: Column) -> Column:
    return F.array_join(F.transform(peaks, lambda p: F.format_string("%.5f %.5f", p["mz"], p["intensity"])), "\n")


def fragmentation_method(title: Column) -> Column:
    """The first of these that the title contains; N/A if none."""
    t, out = F.upper(F.coalesce(title, F.lit(""))), F.lit("N/A")
    for method in ("UVPD", "ETHCD", "ETD", "CID", "HCD"):
        out = F.when(F.contains(t, F.lit(method)), method).otherwise(out)
    return out
