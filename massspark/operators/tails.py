"""Tails of score distributions without the whole distribution: exponential tilting, saddlepoint estimates, and pruning whose
loss is bounded by what was carried through the recursion.

The tilted sweep runs backwards over a score graph: B(m) sums, over all ways from node m to a sink, chance * e^(theta * score). It is
kept relative to the best way, as e^(-theta * rest(m)) B(m), so no exponent is positive and nothing overflows at theta >= 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from massspark.functions.chem import CREDIT, PENALTY
from massspark.operators.scoring import NEVER, Distribution, Graph, flanked, merge, score_windows

#: The steepest tilt, the sweeps of a solution, and how near the tilted mean must come to the threshold, in scores.
MOST_TILT, SWEEPS, NEAR = 40.0, 40, 0.02


def backward(graph: Graph, theta: float, derivatives: bool = False) -> list[np.ndarray]:
    """[B] relative to the best way, or [B, B', B''] by theta, for each node; behind the last node all is 0."""
    out = [np.zeros(len(graph.rest)) for _ in range(3 if derivatives else 1)]
    start = -graph.rest[graph.sinks].astype(float)
    for k, b in enumerate(out):
        b[graph.sinks] = start**k * np.exp(theta * start)
    each = np.arange(len(graph.noms))
    for high in range(graph.top, 0, -graph.block):
        m = np.arange(max(0, high - graph.block), high)
        to = m[:, None] + graph.noms
        leads = graph.reached(to) & graph.reached(m)[:, None]
        w = np.where(leads, graph.gain[each, np.minimum(to, graph.top)] + graph.rest[to] - graph.rest[m][:, None], 0).astype(float)
        f = np.where(leads, graph.probability * np.exp(theta * w), 0.0)
        before = [b[to] for b in out]
        out[0][m] += (f * before[0]).sum(axis=1)
        if derivatives:
            out[1][m] += (f * (w * before[0] + before[1])).sum(axis=1)
            out[2][m] += (f * (w * w * before[0] + 2 * w * before[1] + before[2])).sum(axis=1)
    return out


def cumulants(graph: Graph, theta: float, flank: float | None = None) -> tuple[float, float, float]:
    """ln of the sum of chance * e^(theta * score) over all strings, and its first two derivatives."""
    b, b1, b2 = (float(x[0]) for x in backward(graph, theta, True))
    k, k1, k2 = math.log(b) + theta * graph.rest[0], graph.rest[0] + b1 / b, b2 / b - (b1 / b) ** 2
    if flank is not None:  # another factor, so cumulants add
        weights, scores = np.array([flank, 1 - flank]), np.array([CREDIT, PENALTY], float)
        w = weights * np.exp(theta * (scores - CREDIT))
        mean = float((w * scores).sum() / w.sum())
        k, k1, k2 = k + math.log(w.sum()) + theta * CREDIT, k1 + mean, k2 + float((w * (scores - mean) ** 2).sum() / w.sum())
    return k, k1, max(k2, 0.0)


@dataclass(frozen=True)
class Saddle:
    """The tilt, an estimate of the tail, and a bound that the tail never exceeds."""

    theta: float
    estimate: float
    bound: float


def _beyond(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def saddlepoint(graph: Graph, threshold: int, flank: float | None = None) -> Saddle | None:
    """The chance of the threshold or more, estimated from a few tilted sweeps; None if no string ends in a sink.

    theta solves mean(theta) = threshold by Newton's steps, halved into the bracket where they leave it. The estimate is
    Lugannani and Rice's for whole-number scores, and no more than the bound e^(K(theta) - theta * threshold). At or below the
    mean, where there is nothing to tilt towards, it is that of a normal distribution and the bound is the whole mass.
    """
    if not graph.reached(0):
        return None
    best = int(graph.rest[0]) + (CREDIT if flank is not None else 0)
    if threshold > best:
        return Saddle(MOST_TILT, 0.0, 0.0)
    whole, mean, spread = cumulants(graph, 0.0, flank)
    mass = math.exp(whole)
    if threshold <= mean + NEAR:
        z = (threshold - 0.5 - mean) / math.sqrt(spread) if spread > 0 else -math.inf
        return Saddle(0.0, mass * _beyond(z), mass)
    low, high, theta = 0.0, MOST_TILT, min(MOST_TILT, (threshold - mean) / max(spread, 1e-9))
    for _ in range(SWEEPS):
        k, k1, k2 = cumulants(graph, theta, flank)
        if abs(k1 - threshold) <= NEAR or high - low < 1e-6:
            break
        low, high = (theta, high) if k1 < threshold else (low, theta)
        step = theta + (threshold - k1) / k2 if k2 > 0 else math.inf
        theta = step if low < step < high else (low + high) / 2
    bound = math.exp(k - theta * threshold)
    w = math.sqrt(2 * max(0.0, theta * threshold - k + whole))
    u = (1 - math.exp(-theta)) * math.sqrt(k2)
    estimate = mass * (_beyond(w) + math.exp(-w * w / 2) / math.sqrt(2 * math.pi) * (1 / u - 1 / w)) if u > 0 and w > 0 else bound
    return Saddle(theta, min(estimate, bound) if estimate > 0 else bound, bound)


def certified(graph: Graph, threshold: int, flank: float | None = None, cap: int | None = None, share: float | None = None) -> Distribution | None:
    """A distribution whose tail p at the threshold is certain: the true one lies in [p, p + error]. None as distribution().

    Scores that cannot reach the threshold are dropped without loss. cap: scores of more than cap above it are dropped too,
    at the loss of their chance times all that follows. share: from each node's low end scores are dropped while their tilted
    bounds sum to no more than this share of the estimated tail, divided by the nodes. best stays exact.
    """
    if not graph.reached(0):
        return None
    noms, gain, rest, top, block = graph.noms, graph.gain, graph.rest, graph.top, graph.block
    best = int(rest[0])
    cut = min(threshold - (CREDIT if flank is not None else 0), best)
    first_low, first_high = score_windows(graph, cut)
    width = max(1, int((first_high - first_low).max()))
    follows = backward(graph, 0.0)[0]
    theta = budget = 0.0
    if share is not None:
        saddle = saddlepoint(graph, cut)
        theta, budget = saddle.theta, share * saddle.estimate / max(1, int((first_high > first_low).sum()))
        tilted = backward(graph, theta)[0]
    is_sink = np.zeros(top + 1, bool)
    is_sink[graph.sinks] = True
    low, high = np.zeros(top + 1, np.int64), np.zeros(top + 1, np.int64)
    high[0] = 1
    table = np.zeros((top + 1, 3 * width))
    table[0, width] = 1.0
    flat, lanes, error = table.reshape(-1), np.arange(width), 0.0
    for first in range(1, top + 1, block):
        m = np.arange(first, min(first + block, top + 1))
        source = m[:, None] - noms
        there = (source >= 0) & (high[source] > low[source])
        step = gain[:, m].T
        least = np.maximum(np.where(there, low[source] + step, -NEVER).min(axis=1), cut - rest[m])
        most = np.where(there, high[source] + step, NEVER).max(axis=1)
        some = there.any(axis=1) & graph.reached(m) & (most > least)
        m, least, most = m[some], least[some], most[some]
        if not len(m):
            continue
        reach = int((most - least).max())
        total = np.zeros((len(m), reach))
        for a, (nom, p) in enumerate(zip(noms, graph.probability, strict=True)):
            source = np.maximum(m - nom, 0)
            rows = np.flatnonzero((m >= nom) & (high[source] > low[source]))
            at = np.clip(least[rows] - gain[a, m[rows]] - low[source[rows]], -width, width) + width
            total[rows] += p * flat[(source[rows] * 3 * width + at)[:, None] + lanes[:reach]]
        scores = least[:, None] + lanes[:reach]
        total[scores >= most[:, None]] = 0
        inner = ~is_sink[m]
        if cap is not None:
            over = (scores > cut + cap) & inner[:, None]
            error += float((np.where(over, total, 0).sum(axis=1) * follows[m]).sum())
            total[over] = 0
            most = np.where(inner, np.minimum(most, cut + cap + 1), most)
        if budget > 0:
            bounds = total * np.exp(np.minimum(theta * (scores + rest[m][:, None] - cut), 600)) * tilted[m][:, None]
            runs = np.cumsum(bounds, axis=1)
            gone = np.where(inner, (runs <= budget).sum(axis=1), 0)
            error += float(np.take_along_axis(runs, np.maximum(gone - 1, 0)[:, None], axis=1)[gone > 0].sum())
            shifted = np.minimum(lanes[:reach] + gone[:, None], reach)
            total = np.take_along_axis(np.pad(total, ((0, 0), (0, 1))), shifted, axis=1)
            least = least + gone
        kept = most > least
        m, least, most, total = m[kept], least[kept], most[kept], total[kept]
        low[m], high[m] = least, most
        table[m, width : width + reach] = total
    ends = [Distribution(int(low[m]), table[m, width : width + int(high[m] - low[m])], best, threshold) for m in graph.sinks if high[m] > low[m]]
    merged = merge(ends) or Distribution(cut, np.zeros(1), best, threshold)
    merged = Distribution(merged.low, merged.chances, best, threshold, error)
    return merged if flank is None else flanked(merged, flank)
