"""Score graphs against enumeration of all their strings: distributions, certified pruning, saddlepoints, merging."""

import itertools
import math

import numpy as np
import pytest

from massspark.functions import distributions as dist
from massspark.operators import scoring as sc
from massspark.operators import tails


def some_graph(rng, residues=4, top=23, spread=4, weights=None):
    noms = np.sort(rng.choice(np.arange(3, 9), residues, replace=False))
    p = rng.dirichlet(np.full(residues, 5.0)) if weights is None else weights
    gain = rng.integers(-spread, spread + 1, (residues, top + 1))
    return sc.Graph.of(noms, p, gain, [top, top - 1] if rng.random() < 0.5 else [top])


def enumerated(graph, flank=None):
    """score -> chance over all strings, way by way."""
    found: dict[int, float] = {}
    work = [(0, 0, 1.0)]
    while work:
        m, score, p = work.pop()
        if m in graph.sinks:
            for s, share in ((2, flank), (-11, 1 - flank)) if flank is not None else ((0, 1.0),):
                found[score + s] = found.get(score + s, 0.0) + p * share
        for nom, q, gain in zip(graph.noms, graph.probability, graph.gain, strict=True):
            if m + nom <= graph.top:
                work.append((m + nom, score + int(gain[m + nom]), p * q))
    return found


def tail_of(d, t):
    return float(d.chances[max(0, t - d.low) :].sum()) if t - d.low < len(d.chances) else 0.0


@pytest.mark.parametrize("seed", range(12))
def test_certified_tails(seed):
    rng = np.random.default_rng(seed)
    graph = some_graph(rng, weights=np.full(4, 0.4) if seed % 4 == 3 else None)  # open changes let chances sum to more than 1
    flank = 0.2 if seed % 2 else None
    want = enumerated(graph, flank)
    if not want:
        assert tails.certified(graph, 0, flank, 1, 0.1) is None and sc.distribution(graph, None, flank) is None and tails.saddlepoint(graph, 0, flank) is None
        return
    full = sc.distribution(graph, None, flank)
    assert {full.low + i: pytest.approx(p) for i, p in enumerate(full.chances) if p > 0} == want and full.best == max(want) and full.error == 0
    for t in range(min(want) - 1, max(want) + 2):
        true = sum(p for s, p in want.items() if s >= t)
        for cap, share in ((None, None), (0, None), (3, None), (None, 0.05), (2, 0.5), (1000, 1e-9)):
            d = tails.certified(graph, t, flank, cap, share)
            p = tail_of(d, t)
            assert p <= true * (1 + 1e-12) and true <= (p + d.error) * (1 + 1e-12) + 1e-300
            assert d.best == max(want) and d.valid_from == t and d.error >= 0
            if cap is None and share is None:
                assert p == pytest.approx(true) and d.error == 0
            if cap == 1000:
                assert p >= true * (1 - 1e-6)


def test_lossy_pruning_saves_and_loses():
    rng = np.random.default_rng(4)
    graph = some_graph(rng, 5, 60, 3)
    full = sc.distribution(graph)
    t = full.best - 12
    d = tails.certified(graph, t, cap=2)
    assert 0 < d.error and len(d.chances) <= len(full.chances) and tail_of(d, t) < tail_of(full, t) <= tail_of(d, t) + d.error


@pytest.mark.parametrize("seed", range(8))
def test_tilted_sweeps(seed):
    rng = np.random.default_rng(100 + seed)
    graph = some_graph(rng)
    want = enumerated(graph, 0.3)
    for theta in (0.0, 0.2, 1.5, 5.0):
        m = [sum(p * s**k * math.exp(theta * s) for s, p in want.items()) for k in range(3)]
        k, k1, k2 = tails.cumulants(graph, theta, 0.3)
        assert (k, k1) == (pytest.approx(math.log(m[0])), pytest.approx(m[1] / m[0], abs=1e-7)) and k2 == pytest.approx(m[2] / m[0] - (m[1] / m[0]) ** 2, abs=1e-6)


def test_saddlepoint_estimates():
    """Within 0.25 in log10 of the exact tail over graphs of peptide-like depth, and never above the bound."""
    worst, n = 0.0, 0
    for seed in range(12):
        rng = np.random.default_rng(seed)
        graph = some_graph(rng, 6, 90, 3)
        flank = 0.1 if seed % 2 else None
        full = sc.distribution(graph, None, flank)
        for t in range(full.low, full.best + 1):
            true = tail_of(full, t)
            s = tails.saddlepoint(graph, t, flank)
            assert true <= s.bound * (1 + 1e-9) and 0 < s.estimate <= s.bound * (1 + 1e-12)
            worst, n = max(worst, abs(math.log10(s.estimate / true))), n + 1
        assert tails.saddlepoint(graph, full.best + 1, flank).estimate == 0
    assert n > 500 and worst <= 0.25, worst


def test_merge(spark):
    rng = np.random.default_rng(2)
    rows, groups = [], {}
    for i in range(40):
        g = int(rng.integers(5))
        low, chances = int(rng.integers(-20, 20)), rng.random(int(rng.integers(0, 6)))
        d = sc.Distribution(low, chances, int(rng.integers(50)), int(rng.integers(-5, 5)), float(rng.random()))
        groups.setdefault(g, []).append(d)
        rows.append((g, d.low, chances.tolist(), d.valid_from, d.error, d.best))
    rows += [(9, 0, [], 3, None, 7), (9, 0, None, 4, 0.5, 8)]
    df = spark.createDataFrame(rows, "g int, min_score int, probs array<double>, valid_from int, error double, best int")
    got = {r.g: r for r in dist.merged(df, ["g"]).collect()}
    assert set(got) == {*groups, 9}
    for g, own in groups.items():
        some = [d for d in own if len(d.chances)]
        want = sc.merge(some)
        r = got[g]
        assert (r.valid_from, r.best) == (max(d.valid_from for d in own), max(d.best for d in own)) and r.error == pytest.approx(sum(d.error for d in own))
        assert r.min_score == want.low and r.probs == pytest.approx(want.chances.tolist())
    assert (got[9].valid_from, got[9].error, got[9].best, got[9].probs, got[9].min_score) == (4, 0.5, 8, [], None)
    assert dist.merged(df.limit(0), ["g"]).count() == 0


def test_merge_of_nothing():
    assert sc.merge([]) is None
    one = sc.Distribution(3, np.array([0.5]), 4, 2, 0.25)
    both = sc.merge([one, sc.Distribution(6, np.array([0.125]), 9)])
    assert (both.low, both.chances.tolist(), both.best, both.valid_from, both.error) == (3, [0.5, 0, 0, 0.125], 9, 2, 0.25)


def test_all_strings_of_a_chain():
    graph = sc.Graph.of([2, 3], [0.5, 0.5], np.array([[0] * 7, [1] * 7]), [6])
    strings = [s for n in range(1, 4) for s in itertools.product((2, 3), repeat=n) if sum(s) == 6]
    d = sc.distribution(graph)
    assert d.chances.sum() == pytest.approx(sum(0.5 ** len(s) for s in strings))
