"""The pipeline's stages on the smallest tables, and the queries that have SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from massspark.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.select(*columns).fetchall())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "language_id":
            assert all(any(c.isalpha() for c in t) for t in after.values()) and len(after) == len(before)
        if name == "near_dedup":
            sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in before.items() if (w := t.encode().lower().split())}
            gone = set(before) - set(after)
            assert gone and all(any(10 * len(sets[g] & s) >= 8 * len(sets[g] | s) for d, s in sets.items() if d < g) or any(10 * len(sets[g] & s) >= 8 * len(sets[g] | s) for d, s in sets.items() if d != g) for g in gone)
            kept = sorted(after)
            assert not any(10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) for i, a in enumerate(kept) for b in kept[:i])
        if name == "secret_scan":
            assert not any("AKIA" in t for t in after.values())
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(before)


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, clashing columns and empty tables go through all stages."""
    prose = {"en": "the cat and the dog went over the hill with all of their old friends and came home", "de": "der hund und die katze gingen mit allen alten freunden den berg hinauf und wieder heim"}
    rows = [(i, " ".join(prose[x].split()[(i * 7 + k * 3) % 13] + f" n{i}" for k in range(12)), x, "s", 1) for i in range(40) for x in ["en" if i % 2 else "de"]]
    rows += [(100, None, "en", None, None), (101, "", None, "s", 0), (102, "12 34 !", "en", "s", 7), (None, "password=abcdefghijklmnop the cat and the dog", None, None, None), rows[3], (103, rows[3][1], "de", "s", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key long, part string, comp long, id int"
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], schema).repartition(2)
    spark.createDataFrame([(1, prose["en"] + " and then some more"), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, str(tmp_path))
        assert after.columns == docs.columns and [f.dataType for f in after.schema] == [f.dataType for f in docs.schema]
        assert stage(spark, before.limit(0), str(tmp_path)).count() == 0
        before = after
    kept = before.collect()
    ids = [r.doc_id for r in kept]
    assert not {100, 101, 102, 103} & set(ids) and ids.count(3) == 2 and None in ids  # a group's first document stays, with the rows of its id
    assert next(r for r in kept if r.doc_id is None).text.startswith("[SECRET]") and all(r.n_chars == len(r.text) and r.id == 3 for r in kept)
    packed = corpus_pipeline.STAGES[-1][1](spark, before, str(tmp_path)).collect()
    assert len(packed) == len(kept) and corpus_pipeline.STAGES[-1][1](spark, before.limit(0), str(tmp_path)).count() == 0


def test_language_stage_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words", None, "s", 10)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.language_id(spark, docs, "").count() == 0
