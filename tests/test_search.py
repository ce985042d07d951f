"""Sources, sinks, the model's stream, training, scores against enumeration, and search end to end."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from massspark.functions.chem import MASSES
from massspark.operators import digest as dig
from massspark.operators import scoring as sc
from massspark.operators import search as se
from massspark.operators import train as tr
from massspark.operators.fdr import assign_q_values
from massspark.operators.mass_index import build_index, open_index
from massspark.plans import adaptors as ad
from massspark.sources import bundled
from massspark.sources import model as mo
from massspark.sources import sinks, spectra, tables
from massspark.streaming import spectra as stream

MGF = """noise
BEGIN IONS
TITLE=first HCD
PEPMASS=500.25 1234
CHARGE=2+
SCANS=7
UNKNOWN=1
100.5 10
200.25
END IONS
BEGIN IONS
TITLE=second
PEPMASS=x
CHARGE=2+ and 3+
SEQ=PEPTIDEK
300 1e3
END IONS
"""


def test_mgf(spark, tmp_path):
    (tmp_path / "a.mgf").write_text(MGF)
    (tmp_path / "b.mgf").write_text(MGF.replace("first", "third"))
    rows = spectra.indexed(spectra.read_mgf(spark, str(tmp_path))).orderBy("spec_index").collect()
    assert [r.spec_index for r in rows] == [0, 1, 2, 3] and [r.title for r in rows] == ["first HCD", "second", "third HCD", "second"]
    a, b = rows[:2]
    assert (a.scan, a.charge, a.precursor_mz) == ("7", 2, 500.25) and [(p.mz, p.intensity) for p in a.peaks] == [(100.5, 10.0), (200.25, 0.0)]
    assert (b.scan, b.charge, b.precursor_mz, b.seq) == (None, None, None, "PEPTIDEK") and b.peaks[0].intensity == 1000
    text = spectra.to_mgf(spectra.read_mgf(spark, str(tmp_path / "a.mgf"))).collect()
    (tmp_path / "c.mgf").write_text("".join(r.block for r in text))
    again = spectra.read_mgf(spark, str(tmp_path / "c.mgf")).orderBy("spec_index").collect()
    assert [(r.title, r.scan, r.charge, r.precursor_mz, r.peaks, r.seq) for r in again] == [(r.title, r.scan, r.charge, r.precursor_mz, r.peaks, r.seq) for r in rows[:2]]


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fasta").write_text("junk\n>P1 some protein\nPEP\nTI de\n>XXX_P2\nAAA\n>P3\n")
    got = {r.accession: (r.description, r.sequence, r.is_decoy) for r in tables.read_fasta(spark, str(tmp_path / "x.fasta")).collect()}
    assert got == {"P1": ("some protein", "PEPTIDE", False), "XXX_P2": ("", "AAA", True), "P3": ("", "", False)}
    (tmp_path / "many").mkdir()
    for name, text in {"a": "junk1\njunk2\n>P1 x\nAA\n>P2\n>P3 y\r\nBB\r\n", "b": ">Q1\n>Q2\nC C\n>\nDD\n>>Q4 z\nE", "c": "", "d": "only junk\n", "e": "\n>R1\nF\n"}.items():
        (tmp_path / "many" / f"{name}.fasta").write_text(text)
    want = {("P1", "x", "AA"), ("P2", "", ""), ("P3", "y", "BB"), ("Q1", "", ""), ("Q2", "", "CC"), ("", "", "DD"), (">Q4", "z", "E"), ("R1", "", "F")}
    for size in ("134217728", "9"):  # whole files, and blocks of nine bytes
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            got = [(r.accession, r.description, r.sequence) for r in tables.read_fasta(spark, str(tmp_path / "many")).collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert len(got) == len(want) and set(got) == want, size
    entries = {r.entry for r in tables.with_decoy_entries(tables.read_fasta(spark, str(tmp_path / "x.fasta"))).where("block = 1").collect()}
    assert ">XXX_P1 some protein\ned ITPEP" in entries


def test_small_files(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("#Peptide\tScanNum\tCharge\tmore\nPEP\t5\t2\tx\n\t6\t2\ty\nAAK\t7\t?\tz\n")
    rows = tables.read_matches(spark, str(tmp_path / "m.tsv")).orderBy("input_pos").collect()
    assert [(r.scan, r.peptide, r.charge, r.more) for r in rows] == [("5", "PEP", 2, "x"), ("7", "AAK", None, "z")]
    (tmp_path / "p.tsv").write_text("5\tPEP\t2\n")
    assert tables.read_matches(spark, str(tmp_path / "p.tsv")).first().charge == 2
    (tmp_path / "f.txt").write_text("# x\nA 0.1\nk 0.2 # y\n")
    assert tables.read_residue_frequencies(spark, str(tmp_path / "f.txt")) == {"A": 0.1, "K": 0.2}
    (tmp_path / "bad.txt").write_text("A 0.1\nB 0.2\n")
    with pytest.raises(ValueError, match=":2"):
        tables.read_residue_frequencies(spark, str(tmp_path / "bad.txt"))
    (tmp_path / "e.txt").write_text("#c\nMine,KR,C,desc\n")
    assert tables.read_enzymes(spark, str(tmp_path / "e.txt"))["Mine"].cleave_at == "KR"


def test_formats(spark):
    row = spark.range(1).select(sinks.scientific(F.lit(1e-10)).alias("a"), sinks.scientific(F.lit(25.0), False).alias("b"), sinks.shortest(F.lit(0.0)).alias("c"), sinks.shortest(F.lit(1 / 3).cast("float")).alias("d"), sinks.scientific(F.lit(None).cast("double")).alias("e")).first()
    assert tuple(row) == ("1.000000E-10", "2.500000e1", "0", "0.33333334", "NA")


@pytest.fixture(scope="module")
def planted(spark):
    seqs = ["MAAGCDEFKLLNPQRSTVWYGHKEEDDPPAAR", "VLSPADKTNVKAAWGKVGAHAGEYGAEALERMFLSFPTTK", "TYFPHFDLSHGSAQVKGHGKKVADALTNAVAHVDDMPNALSALSDLHAHK", "GLSDGEWQQVLNVWGKVEADIAGHGQEVLIRLFTGHPETLEKFDK"]
    proteins = spark.createDataFrame([(f"P{i}", s, False) for i, s in enumerate(seqs)], "accession string, sequence string, is_decoy boolean")
    rows = ad.synthetic_spectra(dig.digest(proteins, dig.Digest(max_missed=1)).select("peptide").distinct()).cache()
    return proteins, rows, tr.train(rows)


def test_model_stream(spark, planted, tmp_path):
    model = planted[2]
    data = mo.encode(model)
    assert mo.encode(mo.decode(data)) == data
    with pytest.raises(ValueError, match="sentinel"):
        mo.decode(data[:-1] + b"\x00")
    with pytest.raises(ValueError, match="ends"):
        mo.decode(data[:-9])
    mo.write_model(spark, model, str(tmp_path / "model"))
    assert mo.encode(mo.read_stored(spark, str(tmp_path / "model"))) == data
    assert mo.tables(spark, model)["ranks"].count() == sum(r.size for r in model.ranks if r is not None)
    assert mo.encode(tr.train(planted[1])) == data  # the same spectra, the same bytes


def test_training_report(spark, planted, tmp_path):
    rows = planted[1].withColumn("seq", F.when(F.col("spec_index") == 0, None).when(F.col("spec_index") == 1, "PEPTIDEA").otherwise(F.col("seq")))
    model, report = tr.train_with_report(rows)
    counts = {r.reason: r.n for r in tr.corpus_counts(rows).collect()}
    seen = report["spectra"]
    assert seen["read"] == rows.count() and seen["kept"] == counts.pop("kept") and {r: n for r, n in seen["rejected"].items() if n} == counts
    relations = mo.tables(spark, model)
    assert report["model"]["bytes"] == len(mo.encode(model)) and report["model"]["partitions"] == relations["partitions"].count() == len(report["partitions"])
    assert report["model"]["precursor_offsets"] == relations["precursors"].count()
    assert report["model"]["ion_types"] == {r.name: r["count"] for r in relations["fragments"].groupBy("name").count().collect()}
    assert sum(p["spectra"] for p in report["partitions"] if p["segment"] == 0) == seen["kept"] == sum(n for _, n in model.charges)
    tr.write_report(spark, report, str(tmp_path / "report"))
    assert json.loads(spark.read.text(str(tmp_path / "report"), wholetext=True).first()[0]) == report


def test_models_have_a_source(spark, planted, tmp_path, monkeypatch):
    proteins, rows, model = planted
    shipped, source = bundled.resolve_model(spark)
    assert bundled.NAME in source and len(shipped.partitions) > 1 and mo.decode(mo.encode(shipped)).partitions == shipped.partitions
    mo.write_model(spark, model, str(tmp_path / "table"))
    (tmp_path / "stream.param").write_bytes(mo.encode(model))
    for path in ("table", "stream.param"):
        found, source = bundled.resolve_model(spark, str(tmp_path / path))
        assert mo.encode(found) == mo.encode(model) and source == str(tmp_path / path)
    found = se.search(rows.drop("seq"), dig.with_decoys(proteins), how=se.Search(digest=dig.Digest(max_missed=1))).join(rows.select("spec_index", "seq"), "spec_index").collect()
    assert {r.model_source for r in found} == {bundled.resolve_model(spark)[1]} and sum(r.peptide[2:-2] == r.seq for r in found) >= 0.9 * len(found)
    monkeypatch.setattr(bundled, "DIGEST", "0" * 64)
    with pytest.raises(ValueError, match="digest"):
        bundled.bundled_model()


def test_trained_scores(planted):
    model = planted[2]
    for own, rows in zip(model.fragments, model.ranks, strict=True):
        first = own[0]
        assert not first.prefix and first.frequency > 0.9
        score = np.log(rows[0] / rows[-1])
        assert score[:10].max() > 0 > score[-1]


def test_screen(spark, planted):
    rows = planted[1].withColumn("seq", F.when(F.col("spec_index") == 0, None).when(F.col("spec_index") == 1, "PEPTIDEA").otherwise(F.col("seq")))
    got = {r.reason: r.n for r in tr.corpus_counts(rows).collect()}
    assert got["no annotation"] == 1 and got["not tryptic"] >= 1


def test_distribution_against_enumeration(planted):
    model = planted[2]
    rng = np.random.default_rng(1)
    mz = np.sort(rng.uniform(50, 400, 30))
    spectrum = sc.Spectrum(model, 2, np.float32(420.0), mz, rng.uniform(1, 100, 30), 420)
    alphabet = sc.Alphabet()
    whole = int(sc.nominal(np.float32(MASSES["G"] + MASSES["A"] + MASSES["K"])))
    sinks_ = [whole, whole - 1]
    low, chances, best = sc.score_distribution(spectrum, whole, sinks_, alphabet, cleave_at="KR", flank=0.1)
    want: dict[int, float] = {}
    for n in range(1, 5):
        for string in itertools.product(range(20), repeat=n):
            at = np.cumsum(alphabet.nominal[list(string)])
            if at[-1] not in sinks_:
                continue
            score, before = 0, 0
            for i, m in enumerate(at):
                if m == at[-1]:
                    pass
                else:
                    score += int(sc.half_up(spectrum.prefix[whole - m] + spectrum.suffix[m])) if m <= whole else 0
                    score += int(spectrum.edge_scores(spectrum.node_mass[[m]], spectrum.node_mass[[before]], alphabet.accurate[string[i]])[0])
                    score += (2 if alphabet.residues[string[0]] in "KR" else -11) if i == 0 else 0
                before = m
            p = float(np.prod(alphabet.probability[list(string)]))
            for s, share in ((2, 0.1), (-11, 0.9)):
                want[score + s] = want.get(score + s, 0.0) + p * share
    got = {low + i: p for i, p in enumerate(chances) if p > 0}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    assert best == max(want)
    threshold = sorted(want)[len(want) // 2]
    low2, cut, best2 = sc.score_distribution(spectrum, whole, sinks_, alphabet, threshold, "KR", 0.1)
    full = dict(zip(range(low, low + len(chances)), chances, strict=True))
    pruned = dict(zip(range(low2, low2 + len(cut)), cut, strict=True))
    assert best2 == best and all(pruned.get(s, 0.0) == full[s] for s in full if s >= threshold)
    assert sc.tail(low, chances, threshold) == sc.tail(low2, cut, threshold)


def test_search_finds_planted(planted):
    proteins, rows, model = planted
    found = se.search(rows.drop("seq"), dig.with_decoys(proteins), model, se.Search(digest=dig.Digest(max_missed=1))).join(rows.select("spec_index", "seq"), "spec_index").collect()
    hits = [r for r in found if r.peptide[2:-2] == r.seq]
    assert len(found) == rows.count() and len(hits) >= 0.95 * len(found)
    assert all(r.raw_score <= r.denovo_score and 0 < r.spec_evalue <= 1 for r in found)
    assert all(abs(r.precursor_error) < 1e-3 and not r.proteins[0].startswith("XXX_") for r in hits)


def test_search_by_index(spark, planted, tmp_path):
    proteins, rows, model = planted
    how = se.Search(digest=dig.Digest(max_missed=1))
    everything = dig.with_decoys(proteins)
    index = build_index(se.search_candidates(everything, how), str(tmp_path / "index"), "mass")
    names = ["spec_index", "charge", "peptide", "raw_score", "spec_evalue", "evalue", "q_value", "proteins"]
    plain = sorted(map(tuple, se.search(rows.drop("seq"), everything, model, how).select(names).collect()))
    for found in (index, open_index(spark, str(tmp_path / "index"))):
        assert sorted(map(tuple, se.search(rows.drop("seq"), everything, model, how, index=found).select(names).collect())) == plain


def test_rescore(spark, planted):
    _, rows, model = planted
    good = rows.select(F.col("spec_index").alias("input_pos"), "scan", F.col("seq").alias("peptide"), F.lit(None).cast("int").alias("charge"), F.lit("kept").alias("extra"))
    bad = spark.createDataFrame([(1000, "none", "PEPK", 2, "kept")], good.schema).unionByName(good.limit(1).withColumns({"input_pos": F.lit(1001).cast("long"), "peptide": F.lit("A!K")}))
    out = {r.input_pos: r for r in se.rescore(good.unionByName(bad), rows, model, db_size=100).collect()}
    assert out[1000].status == "no spectrum" and out[1001].status == "bad peptide" and all(r.extra == "kept" for r in out.values())
    scored = [r for r in out.values() if r.status == "scored"]
    assert len(scored) == rows.count() and all(r.evalue == pytest.approx(100 * r.spec_evalue) for r in scored)


def test_tails_beside_the_exact_one(planted):
    _, rows, model = planted
    list_ = rows.select(F.col("spec_index").alias("input_pos"), "scan", F.col("seq").alias("peptide"), "charge")
    exact = {r.input_pos: r for r in se.rescore(list_, rows, model, tails=se.Tails(estimate=True)).collect()}
    lossy = {r.input_pos: r for r in se.rescore(list_, rows, model, tails=se.Tails(cap=3, share=0.01)).collect()}
    assert exact.keys() == lossy.keys() and any(lossy[i].spec_error > 0 for i in lossy)
    for i, e in exact.items():
        p = lossy[i]
        assert (p.raw_score, p.denovo_score, p.status) == (e.raw_score, e.denovo_score, "scored")
        assert p.spec_evalue <= e.spec_evalue * (1 + 1e-9) and e.spec_evalue <= (p.spec_evalue + p.spec_error) * (1 + 1e-9)
        assert e.spec_evalue <= e.spec_bound * (1 + 1e-9)
    off = [abs(np.log10(e.spec_estimate / e.spec_evalue)) for e in exact.values()]
    assert np.median(off) <= 0.1 and max(off) <= 0.75
    proteins = dig.with_decoys(planted[0])
    how = se.Search(digest=dig.Digest(max_missed=1), tails=se.Tails(estimate=True, cap=10))
    found = se.search(rows.drop("seq"), proteins, model, how).collect()
    assert found and all(r.spec_error >= 0 and r.spec_estimate <= r.spec_bound for r in found)


def test_one_file_over_many_splits(spark, tmp_path):
    blocks = [f"BEGIN IONS\nTITLE=t{i}\nPEPMASS={300 + i}\n" + "".join(f"{100 + k} {k}\n" for k in range(i % 7)) + "END IONS\n" for i in range(120)]
    blocks.insert(50, "stray\nEND IONS\n")
    (tmp_path / "a.mgf").write_text("# head\n" + "".join(blocks) + "tail\n")
    (tmp_path / "b.mgf").write_text("".join(blocks[:9]))
    (tmp_path / "c.mgf").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = spectra.read_mgf(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 3
        got = sorted((r.spec_file[-5:], r.spec_index, r.title) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted([("a.mgf", i, f"t{i}") for i in range(120)] + [("b.mgf", i, f"t{i}") for i in range(9)])


def test_stream(spark, tmp_path):
    """After every batch the stream's q-values are those of all matches at once, and no batch reads the matches before it."""
    rng = np.random.default_rng(3)
    for name in ("in", "m", "s"):
        (tmp_path / name).mkdir()
    folder, matches, state = str(tmp_path / "in"), str(tmp_path / "m"), str(tmp_path / "s")

    def score(rows):
        name = F.col("title")
        return rows.select(F.col("precursor_mz").cast("float").alias("score"), F.substring_index(name, "/", 1).alias("peptide"), name.endswith("d").alias("is_decoy"), "title")

    seen = []
    for n in range(4):
        new = [(f"P{rng.integers(12)}/{n}.{i}{rng.choice(['t', 't', 'd'])}", float(rng.integers(1, 30)) / 2) for i in range(25)]
        seen += new
        (tmp_path / "in" / f"{n}.mgf").write_text("".join(f"BEGIN IONS\nTITLE={t}\nPEPMASS={s}\n100 1\nEND IONS\n" for t, s in new))
        stream.search_stream(stream.stream_mgf(spark, folder), score, matches, state, str(tmp_path / "ckpt")).awaitTermination()
        got = {r.title: (r.q_value, r.pep_q_value) for r in stream.latest(spark, matches, state).collect()}
        every = spark.createDataFrame([(float(s), t.split("/")[0], t.endswith("d"), t) for t, s in seen], "score float, peptide string, is_decoy boolean, title string")
        assert got == {r.title: (r.q_value, r.pep_q_value) for r in assign_q_values(every).collect()}
        if n == 1:  # a batch that is run again replaces what it wrote
            spark.createDataFrame([(1.0, "P1", False, "old")], "score float, peptide string, is_decoy boolean, title string").write.parquet(f"{matches}/batch=77")
            assert "old" not in {r.title for r in stream.latest(spark, matches, state).collect()}
    assert len(list((tmp_path / "s" / "counts").glob("upto=*"))) == 2


def _lines(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*"))).splitlines()


def test_streamed_search_and_reports(spark, planted, tmp_path):
    proteins, rows, model = planted
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.mgf").write_text("".join(r.block for r in spectra.to_mgf(rows.drop("seq").limit(12)).collect()))
    everything = dig.with_decoys(proteins)
    how = se.Search(digest=dig.Digest(max_missed=1))

    def score(batch):
        return se.search(batch, everything, model, how).select(F.col("spec_evalue").cast("float").alias("score"), "peptide", "is_decoy", "scan", "spec_index")

    stream.search_stream(stream.stream_mgf(spark, str(tmp_path / "in")), score, str(tmp_path / "m"), str(tmp_path / "q"), str(tmp_path / "c")).awaitTermination()
    streamed = stream.latest(spark, str(tmp_path / "m"), str(tmp_path / "q")).collect()
    known = {r.scan: r.seq for r in rows.collect()}
    assert len(streamed) == 12 == len({r.spec_index for r in streamed}) and sum(known[r.scan] == r.peptide[2:-2] for r in streamed) >= 11

    found = se.search(rows.drop("seq"), everything, model, how).cache()
    sinks.write_search(found, str(tmp_path / "report"), unroll=True)
    lines = [x.split("\t") for x in _lines(tmp_path / "report")]
    assert lines[0] == sinks.SEARCH_HEADER and len(lines) == 1 + sum(len(r.proteins) for r in found.collect())
    values = [float(x[12]) for x in lines[1:]]
    assert values == sorted(values) and all(x[1].startswith("index=") and x[3] == "HCD" and "E" in x[12] for x in lines[1:])
    list_ = rows.select((100 - F.col("spec_index")).alias("input_pos"), "scan", F.col("seq").alias("peptide"), "charge")
    scored = se.rescore(list_.unionByName(list_.limit(1).withColumns({"input_pos": F.lit(0).cast("long"), "scan": F.lit("none")})), rows, model)
    sinks.write_rescored(scored, str(tmp_path / "rescored"))
    lines = [x.split("\t") for x in _lines(tmp_path / "rescored")]
    assert lines[0] == sinks.RESCORED_HEADER and [x[1] for x in lines[1:]] == [r.peptide for r in list_.orderBy("input_pos").collect()]
    from massspark.operators.fdr import fdr

    table = spark.createDataFrame([(0, "AAK", "P1", "1e-9"), (1, "CCK", "XXX_P2", "0.5"), (2, "DDK", "P3", "none")], "n long, Peptide string, Protein string, SpecEValue string")
    sinks.write_fdr(fdr(table, "peptide", "protein", "specevalue"), "n", str(tmp_path / "fdr"))
    lines = [x.split("\t") for x in _lines(tmp_path / "fdr")]
    assert lines[0] == ["Peptide", "Protein", "SpecEValue", "QValue", "PepQValue"] and [x[0] for x in lines[1:]] == ["AAK", "CCK", "DDK"]
    assert lines[1][3:] == ["0", "0"] and lines[3][3:] == ["NA", "NA"]
