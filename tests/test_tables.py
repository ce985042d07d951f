"""Tab-separated tables that are folders of several files: one header, or one in each file."""

import pytest

from massspark.sources import sinks, tables


def test_report_of_many_files(spark, tmp_path):
    rows = spark.range(500).selectExpr("id", "CAST(id * 3 AS STRING) AS scan", "CASE WHEN id % 7 > 0 THEN 'K.PEP.R' ELSE '' END AS peptide", "id % 4 AS charge")
    path = str(tmp_path / "report")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_report(rows, ["scan", "peptide", "charge"], ["id"], path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "report").glob("part-*"))) > 1
    got = tables.read_tsv(spark, path)
    assert got.columns == ["scan", "peptide", "charge"]
    assert {tuple(r) for r in got.collect()} == {(str(i * 3), "K.PEP.R" if i % 7 else None, str(i % 4)) for i in range(500)}
    found = tables.read_matches(spark, path)
    assert sorted((int(r.scan), r.charge) for r in found.collect()) == [(i * 3, i % 4) for i in range(500) if i % 7]


def test_header_in_each_file(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("#Scan\tPeptide\n1\tAAA\n")
    (tmp_path / "b.tsv").write_text("#Scan\tPeptide\r\n2\t\r\n3\r\n")
    got = tables.read_tsv(spark, str(tmp_path))
    assert got.columns == ["Scan", "Peptide"]
    assert sorted(map(tuple, got.collect()), key=str) == [("1", "AAA"), ("2", None), ("3", None)]


def test_empty(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("\n  \n")
    for read in (tables.read_tsv, tables.read_matches):
        with pytest.raises(ValueError):
            read(spark, str(tmp_path / "a.tsv"))


def test_compressed_report(spark, tmp_path):
    rows = spark.range(300).selectExpr("id", "CAST(id * 3 AS STRING) AS scan", "'K.PEP.R' AS peptide")
    sizes = []
    for compression in (None, "gzip"):
        path = tmp_path / f"report-{compression}"
        sinks.write_report(rows, ["scan", "peptide"], ["id"], str(path), compression)
        assert all(p.suffix == (".gz" if compression else ".txt") for p in path.glob("part-*"))
        assert sorted(int(r.scan) for r in tables.read_tsv(spark, str(path)).collect()) == [i * 3 for i in range(300)]
        sizes.append(sum(p.stat().st_size for p in path.glob("part-*")))
    assert sizes[1] < sizes[0] / 2
