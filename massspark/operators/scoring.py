"""Scores of one spectrum and charge, in NumPy: what a task does with the spectra that Spark has dealt to it.

All masses and scores are single precision and probabilities double, added in a fixed order, so results do not depend on
how spectra are grouped.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from massspark.functions.chem import CREDIT, MASSES, NOMINAL, PENALTY, RESIDUES, WATER
from massspark.sources.model import Model

F32 = np.float32
#: The rest of a node that leads to no sink.
NEVER = -(1 << 40)
# Single-precision charge carrier and spacings of first and second isotopes.
CARRIER, STEP, SECOND = F32(1.00727649), F32(13.00335483 - 12.0), F32(14.003241 - 13.00335483)


def nominal(mass):
    x = np.asarray(mass, F32) * F32(NOMINAL)
    return np.trunc(x + np.copysign(F32(0.5), x)).astype(np.int64)


def half_up(x):
    return np.floor(np.asarray(x, F32) + F32(0.5)).astype(np.int64)


def precursor_mass(mz: float, charge: int) -> np.float32:
    return F32(F32(mz) * F32(charge) - F32(charge) * F32(1.0072764669))


def _singly(mz: np.ndarray, charge: int, tolerance: np.float32) -> np.ndarray:
    """Isotope pairs of charge 2 and 3 moved to charge 1. Peaks are taken in order and see what was moved before them."""
    used = np.zeros(len(mz), bool)
    for i in range(len(mz)):
        if used[i]:
            continue
        at = mz[i]
        for z in range(2, min(charge, 4)):
            j = _partner(mz, i, at + STEP / F32(z), tolerance)
            if j is None:
                continue
            k = _partner(mz, j, mz[j] + SECOND / F32(z), tolerance)
            for x in (i, j, *([k] if k is not None else [])):
                mz[x] = F32(z) * mz[x] - F32(z - 1) * CARRIER
                used[x] |= x != i
            break
    return mz


def _partner(mz: np.ndarray, after: int, want: np.float32, tolerance: np.float32) -> int | None:
    """The first later peak within the tolerance, up to the first beyond it."""
    apart = mz[after + 1 :] - want
    near = np.flatnonzero(apart > -tolerance)
    return after + 1 + int(near[0]) if len(near) and apart[near[0]] < tolerance else None


def preprocess(model: Model, charge: int, mass: np.float32, mz, intensity) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """m/z, intensity and rank, ascending by m/z: precursor peaks emptied, then ranked, then deconvoluted."""
    mz, intensity = np.array(mz, F32), np.array(intensity, F32)
    if (np.diff(mz) < 0).any():
        by = np.lexsort((intensity, mz))
        mz, intensity = mz[by], intensity[by]
    charges = sorted({p[0] for p in model.precursors})
    key = max((c for c in charges if c <= charge), default=charges[0] if charges else None)
    for c, reduced, offset, *_ in model.precursors:
        z = charge - reduced
        if c == key and z:
            centre = (mass + F32(z) * CARRIER) / F32(z) + F32(offset)
            near = model.window(centre)
            intensity[(mz >= centre - near) & (mz <= centre + near)] = 0
    rank = np.empty(len(mz), np.int64)
    rank[np.lexsort((-mz, -intensity))] = np.arange(1, len(mz) + 1)
    if model.deconvolute and charge:
        mz = _singly(mz, charge, F32(model.deconvolution_tolerance))
        by = np.lexsort((intensity, mz))
        mz, intensity, rank = mz[by], intensity[by], rank[by]
    return mz, intensity, rank


def _floor_partition(model: Model, charge: int, segment: int, mass: float) -> int | None:
    def floor(c: int) -> int | None:
        return max((i for i, (pc, pm, ps) in enumerate(model.partitions) if (pc, ps, pm) <= (c, segment, mass)), default=None)

    found = floor(charge)
    if found is None:
        return floor(model.partitions[0][0]) if model.partitions else None
    own = model.partitions[found][0]
    return found if own == charge else floor(own)


class Spectrum:
    """Score tables of one spectrum and charge up to a nominal mass."""

    def __init__(self, model: Model, charge: int, mass: np.float32, mz, intensity, top: int):
        self.model, self.mass = model, mass
        self.mz, self.intensity, self.rank = preprocess(model, charge, mass, mz, intensity)
        self._strength = np.empty(len(self.mz), np.int64)
        self._strength[np.lexsort((self.mz, self.intensity))] = np.arange(len(self.mz))
        self.partitions = [_floor_partition(model, charge, s, float(mass)) for s in range(model.segments)]
        sums: dict[tuple[str, float], float] = {}
        for p in self.partitions:
            for f in model.fragments[p] if p is not None else ():
                sums[f.name, f.offset] = sums.get((f.name, f.offset), 0.0) + f.frequency
        best = max(sums, key=sums.get) if sums else None  # the first of equals
        self.main = next((f for p in self.partitions if p is not None for f in model.fragments[p] if (f.name, f.offset) == best), None)
        self._edges()
        masses = np.arange(top + 1).astype(F32) / F32(NOMINAL)
        masses = masses.astype(F32)
        self.prefix, self.suffix = (self._nodes(masses, side) for side in (True, False))
        self.node_mass = np.full(top + 1, F32(-1))
        if self.main is not None:
            hit = self._match(self._mz_of(self.main, masses))
            self.node_mass[hit >= 0] = (self.mz[hit[hit >= 0]] - F32(self.main.offset)) * F32(self.main.charge)
        self.node_mass[0] = 0

    @staticmethod
    def _mz_of(fragment, masses):
        return masses / F32(fragment.charge) + F32(fragment.offset)

    def _match(self, theoretical: np.ndarray) -> np.ndarray:
        """The index of the most intense peak in the tolerance, the last of equals; -1 if there is none."""
        near = np.asarray([self.model.window(1.0)], F32) if not self.model.ppm else (theoretical.astype(np.float64) * self.model.tolerance / 1e6).astype(F32)
        low, high = np.searchsorted(self.mz, theoretical - near, "left"), np.searchsorted(self.mz, theoretical + near, "right")
        best, power = np.full(len(theoretical), -1), np.full(len(theoretical), -1)
        for k in range(int((high - low).max(initial=0))):
            at = low + k
            inside = at < high
            strength = np.where(inside, self._strength[np.minimum(at, len(self.mz) - 1)], -1)
            better = strength > power
            best[better], power[better] = at[better], strength[better]
        return best

    def _nodes(self, masses: np.ndarray, prefix: bool) -> np.ndarray:
        out, m = np.zeros(len(masses), F32), self.model
        for segment, p in enumerate(self.partitions):
            if p is None:
                continue
            for i, f in enumerate(m.fragments[p]):
                if f.prefix != prefix:
                    continue
                noise = m.ranks[p][-1] * F32(min(f.charge, m.segments))
                table = np.log((m.ranks[p][i] / noise).astype(np.float64)).astype(F32)
                theoretical = self._mz_of(f, masses)
                here = np.minimum((theoretical / self.mass * F32(m.segments)).astype(np.int64), m.segments - 1) == segment
                hit = self._match(theoretical)
                rank = np.where(hit >= 0, self.rank[np.maximum(hit, 0)] if len(self.rank) else 0, 0)
                bins = np.where(hit < 0, m.max_rank, np.where(rank > m.max_rank, m.max_rank - 1, rank - 1))
                out = np.where(here, out + table[bins], out)
        out[0] = 0
        return out

    def _edges(self) -> None:
        p = self.partitions[-1] if self.partitions else None
        self.existence, self.error = np.zeros(4, F32), np.zeros(1, F32)
        if p is None or p >= len(self.model.errors):
            return
        signal, noise, exist = self.model.errors[p]
        bins = max(F32((self.mass - F32(WATER)) / F32(self.model.tolerance * 2)), F32(1))
        peak = F32(max(len(self.mz), 1)) / bins
        chance = np.array([(1 - peak) * (1 - peak), peak * (1 - peak), peak * (1 - peak), peak * peak], F32)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.existence = np.nan_to_num(np.log(np.where(exist == 0, F32(0.01), exist).astype(np.float64) / chance.astype(np.float64))).astype(F32)
        self.error = np.log(signal.astype(np.float64) / noise.astype(np.float64)).astype(F32)

    def edge_scores(self, now: np.ndarray, before: np.ndarray, between) -> np.ndarray:
        """Scores of steps between nodes of these main-ion masses (-1: unseen), whose residue weighs `between`."""
        state = (now >= 0).astype(np.int64) + 2 * (before >= 0)
        score = self.existence[state]
        if self.model.error_scale and len(self.error) > 1:
            scale = self.model.error_scale
            bin_ = np.clip(half_up((now - before - np.asarray(between, F32)) * F32(scale)), -scale, scale) + scale
            score = np.where(state == 3, score + self.error[bin_], score)
        return half_up(score)

    def raw_score(self, nominal_sums: np.ndarray, accurate_sums: np.ndarray) -> int:
        """Node and edge scores of a peptide by the running sums of its residues (without flank credits)."""
        if len(nominal_sums) < 2:
            return 0
        whole, inner = int(nominal_sums[-1]), nominal_sums[:-1]
        score = int(half_up(self.prefix[inner] + self.suffix[whole - inner]).sum())
        n, a = np.r_[0, nominal_sums], np.r_[0.0, accurate_sums]
        if self.main is not None and self.main.prefix:
            now, before, between = n[1:-1], n[:-2], a[1:-1] - a[:-2]
        else:
            now, before, between = whole - n[1:-1], whole - n[2:], a[2:] - a[1:-1]
        return score + int(self.edge_scores(self.node_mass[now], self.node_mass[before], between).sum())


class Alphabet:
    """Residues of the null model: nominal and accurate masses and probabilities, one entry per residue and open change."""

    def __init__(self, fixed: dict[str, float] | None = None, variable: list[tuple[str, float]] | None = None, frequency: dict[str, float] | None = None):
        entries = [(r, MASSES[r] + (fixed or {}).get(r, 0.0)) for r in RESIDUES]
        entries += [(r, m + d) for targets, d in variable or [] for r, m in entries[:20] if r in (targets or RESIDUES)]
        self.residues = [r for r, _ in entries]
        self.accurate = np.array([m for _, m in entries], F32)
        self.nominal = nominal(self.accurate)
        self.probability = np.array([(frequency or {}).get(r, 0.05) for r in self.residues])


@dataclass(frozen=True)
class Graph:
    """Residue strings as ways over nominal masses: node 0 is the start, node m + noms[a] follows node m by residue a.

    gain[a, m]: the score of the step by residue a into node m, nothing into a sink. rest[m]: the most that can still be had from node
    m to a sink, NEVER where none is reached; it goes on behind the last node.
    """

    noms: np.ndarray
    probability: np.ndarray
    gain: np.ndarray
    sinks: list[int]
    rest: np.ndarray

    @property
    def top(self) -> int:
        return max(self.sinks)

    @property
    def block(self) -> int:
        """Nodes closer than the lightest residue do not lead to each other, so they are worked on together."""
        return int(self.noms.min())

    @classmethod
    def of(cls, noms, probability, gain: np.ndarray, sinks: list[int]) -> Graph:
        noms, gain, sinks = np.asarray(noms, np.int64), gain.copy(), sorted(set(sinks))
        top, block = max(sinks), int(noms.min())
        gain[:, sinks] = 0
        rest = np.full(top + 1 + int(noms.max()), NEVER)
        rest[sinks] = 0
        each = np.arange(len(noms))
        for high in range(top, 0, -block):
            m = np.arange(max(0, high - block), high)
            to = m[:, None] + noms
            rest[m] = np.maximum(rest[m], (gain[each, np.minimum(to, top)] + rest[to]).max(axis=1))
        return cls(noms, np.asarray(probability, float), gain, sinks, rest)

    def reached(self, at=slice(None)) -> np.ndarray:
        return self.rest[at] > NEVER // 2


@dataclass(frozen=True)
class Distribution:
    """The chances of the scores from low on, and the best score of all. What a tail at valid_from or above lacks is at most error."""

    low: int
    chances: np.ndarray
    best: int
    valid_from: int = -(1 << 31)
    error: float = 0.0


def merge(found: list[Distribution]) -> Distribution | None:
    """Distributions added score by score: valid from where all of them are, errors added, the best of the best."""
    if not found:
        return None
    low, high = min(d.low for d in found), max(d.low + len(d.chances) for d in found)
    chances = np.zeros(high - low)
    for d in found:
        chances[d.low - low : d.low - low + len(d.chances)] += d.chances
    return Distribution(low, chances, max(d.best for d in found), max(d.valid_from for d in found), sum(d.error for d in found))


def flanked(d: Distribution, flank: float) -> Distribution:
    """With the residue before the peptide: its credit with the chance flank, else its penalty."""
    wide = np.zeros(len(d.chances) + CREDIT - PENALTY)
    wide[CREDIT - PENALTY :] += d.chances * flank
    wide[: len(d.chances)] += d.chances * (1.0 - flank)
    return replace(d, low=d.low + PENALTY, chances=wide, best=d.best + CREDIT)


def build_graph(spectrum: Spectrum, whole: int, sinks: list[int], alphabet: Alphabet, cleave_at: str = "KR") -> Graph | None:
    """Nodes are nominal suffix masses, sinks those above 0; None if there is none."""
    sinks = sorted({s for s in sinks if s > 0})
    if not sinks:
        return None
    top = max(sinks)
    node = np.zeros(top + 1, np.int64)
    inner = np.arange(1, top + 1)
    inner = inner[inner <= whole]
    node[inner] = half_up(spectrum.prefix[whole - inner] + spectrum.suffix[inner])
    gain = np.zeros((len(alphabet.nominal), top + 1), np.int64)
    for a, (nom, acc, r) in enumerate(zip(alphabet.nominal, alphabet.accurate, alphabet.residues, strict=True)):
        now = np.arange(nom, top + 1)
        scores = spectrum.edge_scores(spectrum.node_mass[now], spectrum.node_mass[now - nom], np.full(len(now), acc))
        if len(scores):
            scores[0] += (CREDIT if r in cleave_at else PENALTY) if cleave_at else 0
        gain[a, nom:] = node[nom:] + scores
    return Graph.of(alphabet.nominal, alphabet.probability, gain, sinks)


def score_distribution(spectrum: Spectrum, whole: int, sinks: list[int], alphabet: Alphabet, threshold: int | None = None, cleave_at: str = "KR", flank: float | None = None):
    """(least score, probabilities, best score) over all residue strings that end in a sink; None if none does. See distribution()."""
    graph = build_graph(spectrum, whole, sinks, alphabet, cleave_at)
    d = distribution(graph, threshold, flank) if graph is not None else None
    return None if d is None else (d.low, d.chances, d.best)


def score_windows(graph: Graph, cut: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Each node's scores [low, high), without those that cannot end at the cut or above; equal where there are none."""
    top, block, noms, gain, rest = graph.top, graph.block, graph.noms, graph.gain, graph.rest
    low, high = np.zeros(top + 1, np.int64), np.zeros(top + 1, np.int64)
    high[0] = 1
    for first in range(1, top + 1, block):
        m = np.arange(first, min(first + block, top + 1))
        source = m[:, None] - noms
        there = (source >= 0) & (high[source] > low[source])
        step = gain[:, m].T
        least = np.where(there, low[source] + step, -NEVER).min(axis=1)
        most = np.where(there, high[source] + step, NEVER).max(axis=1)
        if cut is not None:
            least = np.maximum(least, cut - rest[m])
        some = there.any(axis=1) & graph.reached(m) & (most > least)
        low[m], high[m] = np.where(some, least, 0), np.where(some, most, 0)
    return low, high


def distribution(graph: Graph, threshold: int | None = None, flank: float | None = None) -> Distribution | None:
    """The distribution over all residue strings that end in a sink; None if none does.

    Probabilities of a node are those of the nodes a residue below it, shifted by the step's score. Given a threshold, scores
    that cannot reach it any more are dropped: what is kept at or above it is the same to the last bit. flank: the chance that
    the residue before the peptide is a cleavage site, credited or not.
    """
    top, block, noms, gain = graph.top, graph.block, graph.noms, graph.gain
    if not graph.reached(0):
        return None
    best = int(graph.rest[0])
    cut = None if threshold is None else min(threshold - (CREDIT if flank is not None else 0), best)
    low, high = score_windows(graph, cut)
    width = int((high - low).max())
    table = np.zeros((top + 1, 3 * width))  # zeros on either side, for scores that a node does not have
    table[0, width] = 1.0
    flat, lanes = table.reshape(-1), np.arange(width)
    for first in range(1, top + 1, block):
        m = np.arange(first, min(first + block, top + 1))
        m = m[high[m] > low[m]]
        if not len(m):
            continue
        reach = int((high[m] - low[m]).max())
        total = np.zeros((len(m), reach))
        for a, (nom, p) in enumerate(zip(noms, graph.probability, strict=True)):
            source = m - nom
            rows = np.flatnonzero((source >= 0) & (high[np.maximum(source, 0)] > low[np.maximum(source, 0)]))
            if not len(rows):
                continue
            source = source[rows]
            at = np.clip(low[m[rows]] - gain[a, m[rows]] - low[source], -width, width) + width
            part = flat[(source * 3 * width + at)[:, None] + lanes[:reach]]
            part *= p
            if len(rows) == len(m):
                total += part
            else:
                total[rows] += part
        total[lanes[:reach] >= (high[m] - low[m])[:, None]] = 0
        table[m, width : width + reach] = total
    ends = [Distribution(int(low[m]), table[m, width : width + int(high[m] - low[m])], best) for m in graph.sinks if high[m] > low[m]]
    merged = merge(ends)
    if merged is None:
        return None
    merged = replace(merged, best=best, valid_from=merged.valid_from if threshold is None else threshold)
    return merged if flank is None else flanked(merged, flank)


def tail(low: int, probabilities: np.ndarray, score: int) -> float:
    """The chance of a score or more, at most 1."""
    return min(1.0, float(np.cumsum(probabilities[max(0, score - low) :])[-1])) if score - low < len(probabilities) else 0.0
