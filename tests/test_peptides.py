"""Chemistry, digestion, modifications and joins on small hand-made cases."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from massspark.functions import chem
from massspark.operators import digest as dig
from massspark.operators import matching as ma
from massspark.operators import staging


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column).first()[0]


def test_masses(spark):
    assert one(spark, chem.neutral_mass(F.col("p")), p="PEPTIDE") == pytest.approx(799.359964, abs=1e-4)
    assert one(spark, chem.neutral_mass(F.col("p")), p="peptide") == pytest.approx(799.359964, abs=1e-4)
    assert one(spark, chem.neutral_mass(F.col("p")), p="PEPXIDE") is None
    assert one(spark, chem.mz(F.col("m"), 2), m=799.359964) == pytest.approx(400.687258, abs=1e-4)
    assert one(spark, chem.nominal_bin(F.col("m")), m=57.02146) == 57
    assert one(spark, chem.round_half_up(F.col("m")), m=-1.5) == -1
    assert one(spark, chem.nominal_bin(chem.nominal_to_mass(F.col("m"))), m=1234.0) == 1234


def test_strings(spark):
    strip = lambda p: one(spark, chem.strip_context(F.col("p")), p=p)
    assert [strip(p) for p in ("K.PEPR.A", "PEPR", "A.B", "-.PE.-")] == ["PEPR", "PEPR", "A.B", "PE"]
    assert one(spark, chem.peptide_key(F.col("p")), p="K.pepR.A") == "PEPR"
    assert chem.decoy_prefix("XXX") == chem.decoy_prefix("XXX_") == "XXX_"
    parse = lambda p, leading=False: one(spark, chem.residues(F.col("p"), leading), p=p)
    assert [(s.aa, s.delta) for s in parse("AM+15.995K")] == [("A", 0.0), ("M", 15.995), ("K", 0.0)]
    assert [(s.aa, round(s.delta, 3)) for s in parse("M+1-0.5K")] == [("M", 0.5), ("K", 0.0)]
    assert parse("+42AK") is None and parse("AXK") is None and parse("") is None
    assert [(s.aa, s.delta) for s in parse("+42 A K", True)] == [("A", 42.0), ("K", 0.0)]
    assert one(spark, chem.peptide_string(chem.residues(F.col("p"))), p="AM+15.9949K") == "AM+15.995K"
    assert one(spark, chem.rescore_cleavage(F.col("p")), p="K.PEPR.A") == 4
    assert one(spark, chem.rescore_cleavage(F.col("p")), p="A.PEPA.A") == -22
    assert one(spark, chem.fragmentation_method(F.col("p")), p="scan etd") == "ETD"
    assert one(spark, chem.fragmentation_method(F.col("p")), p=None) == "N/A"


def test_tolerance(spark):
    t = chem.Tolerance.parse("10ppm")
    assert t == chem.Tolerance(10.0) and chem.Tolerance.parse("0.5Da") == chem.Tolerance(0.5, False)
    assert one(spark, t.matches(F.lit(1000.0), F.col("x")), x=1000.01) and not one(spark, t.matches(F.lit(1000.0), F.col("x")), x=1000.02)
    assert chem.parse_pair("0,1") == (0, 1)
    with pytest.raises(ValueError):
        chem.parse_pair("2,1")


def proteins(spark, *seqs):
    return spark.createDataFrame([(f"P{i}", s, False) for i, s in enumerate(seqs)], "accession string, sequence string, is_decoy boolean")


def brute_full(seq, at, missed, low, high, met=True):
    cuts = sorted({0, len(seq), *(i + 1 for i, c in enumerate(seq[:-1]) if c in at), *([1] if met and seq[:1] == "M" and len(seq) > 1 else [])})
    return {(s, seq[s:e]) for i, s in enumerate(cuts) for j, e in enumerate(cuts[i + 1 :]) if j <= missed and low <= e - s <= high and set(seq[s:e]) <= set(chem.RESIDUES)}


@pytest.mark.parametrize("missed", [0, 2, None])
def test_full_digestion(spark, missed):
    rng = random.Random(missed or 9)
    seqs = ["", "M", "K", "MKAAAK", "MAAGGKCCCR", *("".join(rng.choice("MKRAGXP") for _ in range(rng.randrange(60))) for _ in range(20))]
    got = dig.digest(proteins(spark, *seqs), dig.Digest(max_missed=missed, min_len=2, max_len=12)).collect()
    for i, s in enumerate(seqs):
        own = [r for r in got if r.accession == f"P{i}"]
        assert {(r.start, r.peptide) for r in own} == brute_full(s, "KR", 99 if missed is None else missed, 2, 12), s
        assert len(own) == len({(r.start, r.len) for r in own})
        for r in own:
            assert r.pre == (s[r.start - 1] if r.start else "-") and r.post == (s[r.start + r.len] if r.start + r.len < len(s) else "-")
            assert r.prot_n == (r.start == 0) and r.prot_c == (r.start + r.len == len(s))


def test_repeated_accessions_stay_apart(spark):
    df = spark.createDataFrame([("A", "GGGGGGGKAAAAAAK", False), ("A", "CCCCCCCK", False), (None, "DDDDDDDK", False)], "accession string, sequence string, is_decoy boolean").repartition(1)
    out = dig.digest(df, dig.Digest(max_missed=0))
    assert {(r.accession, r.start, r.peptide, r.pre, r.post) for r in out.collect()} == {("A", 0, "GGGGGGGK", "-", "A"), ("A", 8, "AAAAAAK", "K", "-"), ("A", 0, "CCCCCCCK", "-", "-"), (None, 0, "DDDDDDDK", "-", "-")}
    plan = spark._jvm.PythonSQLUtils.explainString(dig.digest(df, dig.Digest())._jdf.queryExecution(), "simple")
    assert plan.count("Exchange") == 1 and "Window" not in plan  # the test's own repartition


@pytest.mark.parametrize("spec", ["K", "KM", "D"])
def test_semi_and_missed_against_brute_force(spark, spec):
    rng = random.Random(len(spec))
    c_term = spec != "D"
    enzyme = dig.Enzyme("x", spec, c_term)
    for seq in ["M", "MK", "KM", *("".join(rng.choice("MMKDAG") for _ in range(rng.randrange(1, 25))) for _ in range(6))]:
        n = len(seq)
        cuts = {0, n} | {i + c_term for i, c in enumerate(seq) if c in spec and 0 < i + c_term < n} | ({1} if seq[0] == "M" and n > 1 else set())
        for missed in (None, 0, 1):
            got = {(r.start, r.len, r.n_termini, r.peptide, r.pre, r.post) for r in dig.digest(proteins(spark, seq), dig.Digest(enzyme, missed, 1, 8, 1)).collect()}
            want = set()
            for s in range(n):
                for e in range(s + 1, min(n, s + 8) + 1):
                    ends, inner = (s in cuts) + (e in cuts), sum(s < c <= e and c < n for c in cuts)
                    if ends and (missed is None or inner <= missed + 1):
                        want.add((s, e - s, ends, seq[s:e], seq[s - 1] if s else "-", seq[e] if e < n else "-"))
            assert got == want, (seq, missed)


def test_unspecific_and_semi(spark):
    seq = "MAKCDERGHI"
    spans = {(s, e) for s in range(10) for e in range(s + 3, min(s + 6, 10) + 1)}
    got = dig.digest(proteins(spark, seq, ""), dig.Digest(dig.ENZYMES[0], min_len=3, max_len=6)).collect()
    assert {(r.start, r.start + r.len) for r in got} == spans
    cuts = {0, 1, 3, 7, 10}
    got = dig.digest(proteins(spark, seq), dig.Digest(min_len=3, max_len=6, min_termini=1)).collect()
    assert {(r.start, r.start + r.len, r.n_termini) for r in got} == {(s, e, (s in cuts) + (e in cuts)) for s, e in spans if s in cuts or e in cuts}


def test_enzymes():
    assert dig.Enzyme.parse("1") == dig.Enzyme.parse("tryp") == dig.TRYPSIN
    assert dig.Enzyme.parse("X,KD,N,mine") == dig.Enzyme("X", "KD", False, "mine")
    for bad in ("99", "nope", "X,kd,C", "X,K,Q", "X,K"):
        with pytest.raises(ValueError):
            dig.Enzyme.parse(bad)


def test_decoys(spark):
    both = dig.with_decoys(proteins(spark, "ABC", ""))
    assert sorted((r.accession, r.sequence, r.is_decoy) for r in both.collect()) == [("P0", "ABC", False), ("P1", "", False), ("XXX_P0", "CBA", True), ("XXX_P1", "", True)]
    assert dig.with_decoys(both).count() == 4
    assert dig.decoy_sanity(both).first().sound
    shares = {r.residue: r.frequency for r in dig.composition(proteins(spark, "AAC")).collect()}
    assert len(shares) == 20 and shares["A"] == pytest.approx(2 / 3) and shares["W"] == 0
    assert {r.frequency for r in dig.composition(proteins(spark)).collect()} == {0.05}


def test_mods(spark):
    mods = ma.Mods.parse("# x\nNumMods=3\nC2H3N1O1,C,fix,any,Carb\nO1,M,opt,any,Ox\n42.01,*,opt,Prot-N-term,Ac\n")
    assert mods.most == 3 and mods.mods[0].mass == pytest.approx(57.021464, abs=1e-5) and ma.mass_or_formula("H-1N1") == pytest.approx(12.995249, abs=1e-5)
    for bad in ("C,K,fix,custom,x", "C,B,fix,any,x", "C,K,maybe,any,x", "C,K,fix,any", "Zz,K,fix,any,x"):
        with pytest.raises(ValueError):
            ma.Mods.parse(bad)
    rows = spark.createDataFrame([("MAMMK", True, False), ("AAA", False, False)], "peptide string, prot_n boolean, prot_c boolean")
    got = ma.placements(rows, mods).collect()
    sites = [(0, 1), (2, 1), (3, 1), (0, 2)]
    want = {frozenset(c) for k in range(4) for c in itertools.combinations(sites, k) if len({p for p, _ in c}) == len(c)}
    assert {frozenset((p.pos, p.mod) for p in r.placement) for r in got if r.peptide == "MAMMK"} == want
    assert sum(r.peptide == "MAMMK" for r in got) == len(want) and sum(r.peptide == "AAA" for r in got) == 1


def test_range_join(spark):
    rng = random.Random(2)
    left = [(i, a, a + rng.randrange(-2, 30)) for i in range(50) for a in [rng.randrange(-100, 100)]]
    right = [(i, rng.randrange(-120, 130)) for i in range(200)]
    got = ma.range_join(spark.createDataFrame(left, "l long, low long, high long"), spark.createDataFrame(right, "r long, v long"), "low", "high", "v", 7)
    assert sorted((x.l, x.r) for x in got.collect()) == sorted((i, j) for i, a, b in left for j, v in right if a <= v <= b)


def test_floor_join(spark):
    table = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (2, 5, "c")], "k long, at long, v string")
    rows = spark.createDataFrame([(1, 1, 9), (2, 1, 10), (3, 1, 25), (4, 2, 7), (5, 3, 7)], "id long, k long, at long")
    got = staging.floor_join(rows, table, ["k"], "at", ["v"]).collect()
    assert {r.id: r.v for r in got} == {1: None, 2: "a", 3: "b", 4: "c", 5: None}


def test_strongest_match(spark):
    ions = spark.createDataFrame([(1, 0, 10.0, 12.0), (1, 1, 50.0, 51.0)], "spec_index long, ion int, low double, high double")
    peaks = spark.createDataFrame([(1, 10.0, 5.0), (1, 12.0, 5.0), (1, 11.0, 4.0), (2, 50.5, 9.0)], "spec_index long, mz double, intensity double")
    assert [tuple(r) for r in ma.strongest_match(ions, peaks, 1.0).collect()] == [(1, 0, 12.0, 5.0)]


def test_repeated_rows_are_not_broadcast(spark):
    """A table of a few bytes by Spark's estimate, whose rows are repeated before the join."""
    rows = spark.range(20).selectExpr("id AS spec_index", "explode(sequence(0, 10)) AS ion", "0.0D AS low", "9.0D AS high", "id % 3 AS bin")
    peaks = spark.range(20).selectExpr("id AS spec_index", "CAST(id % 12 AS DOUBLE) AS mz", "1.0D AS intensity", "id % 5 AS bin")
    got = ma.strongest_match(rows, peaks, 1.0)
    far = ma.away_from(peaks, rows.select("spec_index", "bin"), ["spec_index"], "bin")
    for df in (got, far):
        assert "Broadcast" not in spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert got.count() == 11 * sum(i % 12 <= 9 for i in range(20)) and far.count() == sum(abs(i % 3 - i % 5) > 1 for i in range(20))


def test_digestion_of_any_letters(spark, monkeypatch):
    """Sequences that aren't all ASCII, enzymes of both sides, and batches of a few starts."""
    rng = random.Random(11)
    seqs = ["\u00c4K", "K\u20acR\U0001f600", *("".join(rng.choice("MKDAG\u00c4\u20ac\U0001f600") for _ in range(rng.randrange(70))) for _ in range(30))]
    monkeypatch.setattr(dig, "STARTS", 5)
    monkeypatch.setattr(dig, "TEXT_BYTES", 100)
    for enzyme, at in ((dig.TRYPSIN, 1), (dig.Enzyme.parse("AspN"), 0)):
        got = dig.digest(proteins(spark, *seqs), dig.Digest(enzyme, 1, 1, 9)).collect()
        for i, s in enumerate(seqs):
            cuts = sorted({0, len(s), *(j + at for j, c in enumerate(s) if c in enzyme.cleave_at), *([1] if s[:1] == "M" else [])})
            spans = {(a, b) for j, a in enumerate(cuts) for b in cuts[j + 1 : j + 3] if b - a <= 9 and set(s[a:b]) <= set(chem.RESIDUES)}
            want = {(a, b - a, s[a:b], s[a - 1] if a else "-", s[b] if b < len(s) else "-", a == 0, b == len(s)) for a, b in spans}
            own = [(r.start, r.len, r.peptide, r.pre, r.post, r.prot_n, r.prot_c) for r in got if r.accession == f"P{i}"]
            assert set(own) == want and len(own) == len(want), s


def test_long_sequences_take_linear_work(spark):
    """12 MB of text, and sums over 8,000 residues."""
    rng = random.Random(12)
    one_, long = spark.range(1), "".join(rng.choice(chem.RESIDUES) for _ in range(8000))
    text = one_.select(F.lit("P").alias("accession"), F.repeat(F.lit(long), 1500).alias("sequence"), F.lit(False).alias("is_decoy"))
    peptide = one_.select(F.concat(F.lit(long), F.substring(F.col("id").cast("string"), 1, 0)).alias("peptide"))
    start = time.time()
    assert dig.digest(text, dig.Digest(max_missed=2)).count() > 100_000
    digested = time.time()
    assert digested - start < 12
    sums = list(itertools.accumulate(chem.MASSES[r] for r in long))
    sites = peptide.withColumn("s", chem.residues(F.col("peptide")))
    row = sites.select(chem.accurate_prefix_masses(F.col("s")).alias("a"), chem.nominal_prefix_masses(F.col("s")).alias("n")).first()
    assert row.a == pytest.approx(sums) and len(row.n) == 8000
    assert [r.mz1 for r in ma.ladder(peptide).orderBy("i").collect()] == pytest.approx([x + chem.PROTON for x in sums[:-1]])
    assert time.time() - digested < 30


def test_plain_and_changed_residues(spark):
    rows = spark.createDataFrame([("aK",), ("AK\n",), ("A+1.5K",), ("A+1.5.2K",), ("A+K",), ("AB",), ("B+1K",), ("\u00c4K",), (None,)], "p string").select("p", chem.residues(F.col("p")).alias("s")).collect()
    got = {r.p: r.s and [(x.aa, x.delta) for x in r.s] for r in rows}
    plain = [("A", 0.0), ("K", 0.0)]
    assert got == {"aK": plain, "AK\n": plain, "A+1.5K": [("A", 1.5), ("K", 0.0)], "A+1.5.2K": None, "A+K": None, "AB": None, "B+1K": None, "\u00c4K": None, None: None}
