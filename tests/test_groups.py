"""Orders inside groups over ranges: places, medians, quantiles, rank correlation, floor joins, placements by depth."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from massspark.operators import mass_index as mi
from massspark.operators import matching as ma
from massspark.operators import staging as st
from massspark.operators import train as tr


def table(spark, rng, n=400):
    # one group holds most rows, values repeat, keys and values may be null
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, *range(12)]), i, rng.random()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, v int, t int, w double").repartition(5)


def test_placed(spark):
    rows, df = table(spark, random.Random(1))
    got = {r.t: (r.place, r["size"]) for r in st.placed(df, ["g"], ["v", "t"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: (i, len(own)) for i, r in enumerate(own)}
    assert got == want and st.placed(df.limit(0), ["g"], ["v"]).count() == 0


def test_hot_group_is_many_tasks(spark):
    _, df = table(spark, random.Random(2))
    parts = st.group_ranges(df, ["g"], ["v", "t"]).where("g = 'hot'").groupBy("part").count().collect()
    assert len(parts) >= 3 and max(r["count"] for r in parts) < 200


def test_median_and_quantiles(spark):
    rows, df = table(spark, random.Random(3))
    groups = {g: sorted(r[1] for r in rows if r[0] == g and r[1] is not None) for g in {r[0] for r in rows}}
    assert {r.g: (r.n, r.upper_median) for r in tr.upper_median(df, ["g"], "v").collect()} == {g: (len(v), v[len(v) // 2]) for g, v in groups.items()}
    got = {(r.g, r.part, r.v) for r in tr.quantile_starts(df.where("v is not null"), ["g"], "v", ["t"], 5).collect()}
    assert got == {(g, p, v[p * len(v) // 5]) for g, v in groups.items() for p in range(5)}


def test_spearman(spark):
    rows, df = table(spark, random.Random(4))
    got = {r.g: r.rho for r in tr.spearman(df.where("v is not null"), "g", "v", "w", "t").collect()}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g and r[1] is not None]
        x, y = ({r[2]: i for i, r in enumerate(sorted(own, key=lambda r: (r[k], r[2])))} for k in (1, 3))
        assert got[g] == pytest.approx(np.corrcoef([x[r[2]] for r in own], [y[r[2]] for r in own])[0, 1])


def test_calibration_and_gap(spark):
    rows, df = table(spark, random.Random(5))
    df = df.withColumn("decoy", F.col("t") % 3 == 0)
    got = {(r.g, r.bin): r for r in tr.calibration(df, ["g"], "w", "decoy", 4).collect()}
    for g in {r[0] for r in rows}:
        own = sorted((r[3], r[2] % 3 == 0) for r in rows if r[0] == g)
        for b in range(4):
            part = [x for i, x in enumerate(own) if i * 4 // len(own) == b]
            r = got[g, b]
            assert r.n == len(part) and r.observed == pytest.approx(np.mean([d for _, d in part])) and (r.low, r.high) == (part[0][0], part[-1][0])
    gaps = {}
    for g in {r[0] for r in rows}:
        for u in {r[1] for r in rows}:
            t, d = ([r[3] for r in rows if r[0] == g and r[1] == u and (r[2] % 3 == 0) == x] for x in (False, True))
            if t and d:
                gaps.setdefault(g, []).append(max(t) - max(d))
    want = {g: (len(v), sorted(v)[len(v) // 2]) for g, v in gaps.items()}
    assert {r.g: (r.n, r.median_gap) for r in tr.median_gap(df, ["g"], "v", "w", "decoy").collect()} == want


def test_floor_join(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", None]), rng.choice([None, *range(-5, 60)])) for i in range(300)]
    keys = [(rng.choice(["hot"] * 3 + ["a", "c", None]), rng.choice([None, *range(0, 50, 3)]), rng.randrange(9)) for _ in range(60)]
    left = spark.createDataFrame(rows, "id int, g string, at int").repartition(3)
    right = spark.createDataFrame(keys, "g string, at int, name int").repartition(3)
    got = {r.id: (r.floor_at, r.name) for r in st.floor_join(left, right, ["g"], "at", ["name"]).collect()}
    for i, g, at in rows:
        under = [(k, n) for h, k, n in keys if h == g and k is not None and at is not None and k <= at]
        assert got[i] == (max(under) if under else (None, None))
    assert {r.name for r in st.floor_join(left, right.limit(0), ["g"], "at", ["name"]).collect()} == {None}


def brute_forms(sites, most):
    out = [()]
    for n in range(1, most + 1):
        out += [c for c in itertools.combinations(range(len(sites)), n) if len({sites[i][0] for i in c}) == n]
    return sorted(out)


@pytest.mark.parametrize("most", [1, 2, 4])
def test_placements(spark, monkeypatch, most):
    mods = ma.Mods.parse(f"NumMods={most}\n15.99,M,opt,any,Ox\n42.01,*,opt,N-term,Ac\n79.97,STM,opt,any,Ph\n")
    peptides = ["MAMSK", "AAAK", "MSTMSTK", "M" * 9 + "K"]
    df = spark.createDataFrame([(p, True, False) for p in peptides], "peptide string, prot_n boolean, prot_c boolean")
    for limit in (4096, 20):
        monkeypatch.setattr(ma, "MAX_FORMS", limit)
        got = {}
        for r in ma.placements(df, mods).collect():
            got.setdefault(r.peptide, []).append(r)
        for p in peptides:
            sites = [(i, 0) for i, c in enumerate(p) if c == "M"] + [(0, 1)] + [(i, 2) for i, c in enumerate(p) if c in "STM"]
            want = brute_forms(sites, most)
            assert [tuple((s.pos, s.mod) for s in r.placement) for r in got[p]] == [tuple(sites[i] for i in f) for f in want[:limit]]
            assert {r.skipped for r in got[p]} == {max(0, len(want) - limit)}


def test_many_sites_are_not_all_placed(spark):
    mods = ma.Mods.parse("NumMods=4\n15.99,M,opt,any,Ox\n")
    df = spark.createDataFrame([("M" * 40 + "K", False, False)], "peptide string, prot_n boolean, prot_c boolean")
    rows = ma.placements(df, mods).collect()
    assert len(rows) == ma.MAX_FORMS and {r.skipped for r in rows} == {sum(math.comb(40, k) for k in range(5)) - ma.MAX_FORMS}
    assert [s.pos for s in rows[-1].placement] == [0, *list(itertools.islice((c for c in sorted(c for n in range(1, 4) for c in itertools.combinations(range(1, 40), n))), 4093, 4094))[0]]


def test_mass_index(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    masses = [rng.choice([500.0] * 3 + [round(rng.uniform(100, 900), 1)]) for _ in range(300)] + [None]  # one mass fills several ranges
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(masses)], "id int, mass double").repartition(3)
    spans = [(i, x, x + rng.choice([0, 0.5, 20, -1, 900])) for i in range(150) for x in [rng.choice([500.0, 499.9, 0.0, 950.0, round(rng.uniform(90, 910), 1)])]] + [(999, None, 5.0)]
    asked = spark.createDataFrame(spans, "q int, low double, high double").repartition(3)
    want = sorted((q, i) for q, a, b in spans if a is not None for i, m in enumerate(masses) if m is not None and a <= m <= b)
    index = mi.build_index(rows, str(tmp_path / "i"), "mass", 7)
    bounds = index.bounds.orderBy("part").collect()
    assert index.count() == 300 and len(bounds) >= 5 and all(a.high <= b.low for a, b in zip(bounds, bounds[1:])) and sum(b.low == b.high == 500 for b in bounds) >= 2
    assert all(b.first == min(x.part for x in bounds if x.high >= b.low) for b in bounds)
    for swept in (20_000, 11):
        monkeypatch.setattr(mi, "SWEPT", swept)
        assert sorted((r.q, r.id) for r in index.matches(asked, "low", "high").collect()) == want
    assert sorted((r.q, r.id) for r in ma.range_join(asked, rows, "low", "high", "mass", 5.0).collect()) == want
    few = index.matches(asked.where("q = 0 and false"), "low", "high")
    assert few.count() == 0
    assert mi.build_index(rows.limit(0), str(tmp_path / "e"), "mass").matches(asked, "low", "high").count() == 0
    with pytest.raises(ValueError, match="mass"):
        index.matches(asked.withColumn("mass", F.lit(1)), "low", "high")


def test_sweep_hands_out_few_matches_at_a_time(spark, tmp_path, monkeypatch):
    """Equal masses and wide intervals: each batch is bounded, and an interval behind all candidates meets none of them."""
    monkeypatch.setattr(mi, "EMITTED", 7)
    monkeypatch.setattr(mi, "IN_RANGE", 10)
    index = mi.build_index(spark.range(60).selectExpr("id", "CAST(id % 3 AS DOUBLE) AS mass"), str(tmp_path / "i"), "mass")
    assert index.bounds.count() >= 6
    asked = spark.createDataFrame([(0, 1.0, 1.0), (1, 0.0, 9.0), (2, 5.0, 9.0), (3, 1.2, 1.8)], "q int, low double, high double")
    got = sorted((r.q, r.id) for r in index.matches(asked, "low", "high").collect())
    assert got == sorted([(0, i) for i in range(60) if i % 3 == 1] + [(1, i) for i in range(60)])
    assert {r.q for r in index.parts_of(asked, "low", "high").collect()} <= {0, 1, 3} and index.parts_of(asked.where("q = 2"), "low", "high").count() == 0
