"""q-values against a plain sweep, over the awkward shapes and random ties."""

import random
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame

from massspark.operators import fdr


def sweep(targets, decoys):
    """Keys and rates of a target-decoy sweep, then a running minimum; lookups take the least key strictly greater."""
    f32 = np.float32
    keys = []
    for key in sorted(set(decoys)):
        t, d = sum(x < key for x in targets), sum(x < key for x in decoys)
        if not t:
            continue
        keys.append((key, f32(1) if t <= d else f32(d) / f32(t)))
        if keys[-1][1] >= 1:
            break
    top = f32(1 if decoys else 0)

    def q(score):
        return min([r for k, r in keys if k > score] + [top])

    return q


CASES = {
    "interleaved": ([1, 3, 5, 7], [2, 4, 6]), "ties": ([1, 2, 2, 3], [2, 2, 2, 4]), "on key": ([1, 2, 3], [2, 5]), "no better target": ([5, 6], [1, 2, 7]),
    "all decoys better": ([9], [1, 2, 3]), "no decoys": ([1, 2], []), "no targets": ([], [1, 2]), "single": ([1], [2]), "stop": ([1, 8, 9], [2, 3, 10]), "spike": ([1, 2, 4, 5, 6, 7], [3, 3.5, 8]),
}
for seed in range(6):
    r = random.Random(seed)
    CASES[f"random {seed}"] = ([r.randrange(12) / 2 for _ in range(30)], [r.randrange(3, 15) / 2 for _ in range(25)])


@pytest.fixture(scope="module")
def all_cases(spark):
    return {n: {r.score: r.q for r in fdr.q_map(spark.createDataFrame([(float(x), False) for x in t] + [(float(x), True) for x in d], "score float, is_decoy boolean")).collect()} for n, (t, d) in CASES.items()}


@pytest.mark.parametrize("name", CASES)
def test_q_map(all_cases, name):
    targets, decoys = CASES[name]
    q = sweep(targets, decoys)
    assert all_cases[name] == {float(s): float(q(s)) for s in {*targets, *decoys}}


def test_peptide_level_and_summary(spark):
    rows = [(1.0, "A", False), (5.0, "A", False), (2.0, "B", True), (3.0, "C", False), (None, "A", False)]
    out = fdr.assign_q_values(spark.createDataFrame(rows, "score float, peptide string, is_decoy boolean"))
    got = {(r.score, r.peptide): (r.q_value, r.pep_q_value) for r in out.collect()}
    assert got[5.0, "A"][1] == got[1.0, "A"][1] == 0.0 and got[None, "A"][0] is None
    s = fdr.summary(out).first()
    assert (s.matches, s.targets, s.ids_1) == (5, 4, 1)


def test_fdr_table(spark):
    rows = [("PEP", "T1", "1.0", "x"), ("PEP", "XXX_T2", "1.0", "x"), ("DEC", "XXX_T3", "2.0", "y"), ("ODD", "T4", "n/a", "z")]
    out = fdr.fdr(spark.createDataFrame(rows, ["Peptide", "Protein", "SpecEValue", "extra"]), "peptide", "PROTEIN", "specevalue")
    got = {r.Protein: (r.QValue, r.PepQValue, r.extra) for r in out.collect()}
    assert got["T1"] == got["XXX_T2"] == (0.0, 0.0, "x") and got["T4"][0] is None and len(got) == 4
    with pytest.raises(ValueError, match="score"):
        fdr.fdr(spark.createDataFrame(rows, ["Peptide", "Protein", "SpecEValue", "extra"]), "peptide", "protein", "score")


def test_empty(spark):
    empty = spark.createDataFrame([], "score float, peptide string, is_decoy boolean")
    assert fdr.assign_q_values(empty).count() == 0


def test_several_maps_in_one_pass(spark):
    """Maps share the ranges, but nothing of their counts; a map without decoys stands beside one that stops."""
    names = ["no decoys", "stop", "spike", "random 1", "all decoys better"]
    rows = [(i, float(x), is_decoy) for i, n in enumerate(names) for is_decoy in (False, True) for x in CASES[n][is_decoy]]
    scored = spark.createDataFrame(rows, "map int, score float, is_decoy boolean")
    parts = [fdr.score_counts(scored.where(f"map = {i}")).selectExpr(f"{i} AS map", "score", "t", "d") for i in range(len(names))]
    counts = reduce(DataFrame.unionByName, parts)
    got = {}
    for r in fdr.q_maps(counts).collect():
        got.setdefault(names[r["map"]], {})[r.score] = r.q
    for n in names:
        targets, decoys = CASES[n]
        q = sweep(targets, decoys)
        assert got[n] == {float(s): float(q(s)) for s in {*targets, *decoys}}


def test_no_scores(spark):
    rows = spark.createDataFrame([(None, "A", False)], "score float, peptide string, is_decoy boolean")
    assert [(r.q_value, r.pep_q_value) for r in fdr.assign_q_values(rows).collect()] == [(None, None)]
