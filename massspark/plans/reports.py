"""Named queries that go through files and whole match lists: what is written is read back, with DuckDB SQL of the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massspark.functions import chem
from massspark.operators import digest as dig
from massspark.operators import fdr as fd
from massspark.operators.scoring import preprocess, precursor_mass
from massspark.operators.search import rescore
from massspark.operators.staging import shared_dir
from massspark.plans.adaptors import MATCHES_SQL, PEAKS_SQL, PROTEINS_SQL, matches, peaks, proteins, table
from massspark.plans.queries import FDR_SQL, MASS_LIST, ORACLE_SQL, PEPTIDES_SQL, QMAP_SQL, peptides, query
from massspark.sources import sinks
from massspark.sources.model import Model
from massspark.sources.spectra import indexed, read_mgf, to_mgf
from massspark.sources.tables import read_fasta, read_matches, read_residue_frequencies, read_tsv, with_decoy_entries


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"""WITH p AS (SELECT 'D' || doc_id AS accession, coalesce(lang, '') AS description, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS s FROM documents)
SELECT accession, description, false AS is_decoy, CAST(length(s) AS INTEGER) AS n, md5(s) AS sequence FROM p
UNION ALL SELECT 'XXX_' || accession, description, true, CAST(length(s) AS INTEGER), md5(reverse(s)) FROM p""")
def decoy_fasta(spark, sf_dir):
    """Whole texts as a FASTA file of lines of 60 letters, its target-decoy file written from it, and that one read."""
    rows = proteins(spark, sf_dir, F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.lit(" "), F.coalesce("lang", F.lit(""))))
    plain, both = _folder(spark, "fasta"), _folder(spark, "decoys")
    rows.select(F.concat(F.lit(">"), "accession", F.lit("\n"), F.regexp_replace("sequence", "(.{60})", "$1\n"))).write.text(plain)
    with_decoy_entries(read_fasta(spark, plain)).select("entry").write.text(both)  # a union keeps its sides in order, so the decoys are in the later files
    return read_fasta(spark, both).select("accession", "description", "is_decoy", F.length("sequence").alias("n"), F.md5("sequence").alias("sequence"))


_SPECTRA_SQL = f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 4 AS INTEGER) END AS charge, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_totalprice AS DOUBLE) END AS precursor_mz,
  count(spec_index) AS n_peaks, coalesce(string_agg(printf('%.5f %.5f', CAST(mz AS DOUBLE), CAST(intensity AS DOUBLE)), chr(10) ORDER BY mz, intensity), '') AS peaks FROM orders LEFT JOIN ({PEAKS_SQL}) ON spec_index = o_orderkey GROUP BY ALL"""


def _spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as spectra; some have no charge, some no precursor."""
    line = peaks(spark, sf_dir).groupBy("spec_index").agg(F.array_sort(F.collect_list(F.struct(F.col("mz").cast("double").alias("mz"), F.col("intensity").cast("double").alias("intensity")))).alias("peaks"))
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        key.alias("spec_index"), F.concat(F.lit("order "), key.cast("string")).alias("title"), key.cast("string").alias("scan"),
        F.when(key % 4 > 0, key % 4).cast("int").alias("charge"), F.when(key % 5 > 0, F.col("o_totalprice").cast("double")).alias("precursor_mz"),
    )
    empty = F.array().cast("array<struct<mz:double,intensity:double>>")
    return rows.join(line, "spec_index", "left").withColumn("peaks", F.coalesce("peaks", empty))


@query(f"""SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS spec_index, 'order ' || o_orderkey AS title, CAST(o_orderkey AS VARCHAR) AS scan, charge, precursor_mz, CAST(n_peaks AS INTEGER) AS n_peaks, md5(peaks) AS peaks FROM ({_SPECTRA_SQL})""")
def mgf_files(spark, sf_dir):
    """Spectra written to MGF files by range of their numbers and read from all of them, numbered anew over the files."""
    path = _folder(spark, "mgf")
    to_mgf(_spectra(spark, sf_dir).orderBy("spec_index")).write.text(path)
    return indexed(read_mgf(spark, path)).select("spec_index", "title", "scan", "charge", "precursor_mz", F.size("peaks").alias("n_peaks"), F.md5(chem.canonical_peaks(F.col("peaks"))).alias("peaks"))


@query(f"{FDR_SQL} SELECT match_id, z.peptide, protein, q_value AS q, pep_q_value AS pep_q FROM z JOIN (SELECT match_id, protein FROM m) USING (match_id)")
def fdr_report(spark, sf_dir):
    """A match list with q-values, written as a report in the order of its rows and read back."""
    path = _folder(spark, "fdr")
    rows = matches(spark, sf_dir).select("match_id", F.col("match_id").alias("id"), "peptide", F.col("protein").alias("Protein"), "score")
    sinks.write_fdr(fd.fdr(rows, "Peptide", "protein", "score"), "match_id", path)
    return read_tsv(spark, path).select(F.col("id").cast("long").alias("match_id"), "peptide", F.col("Protein").alias("protein"), F.col("QValue").cast("float").alias("q"), F.col("PepQValue").cast("float").alias("pep_q"))


@query(f"""WITH r AS ({MATCHES_SQL}), m AS (SELECT score, peptide, bool_and(is_decoy) AS is_decoy FROM r GROUP BY 1, 2), best AS (SELECT peptide, is_decoy, min(score) AS score FROM m GROUP BY 1, 2),
pep AS (SELECT peptide, coalesce(min(score) FILTER (NOT is_decoy), min(score)) AS best FROM best GROUP BY 1),
{QMAP_SQL.format(n='psm_q', src='m')}, {QMAP_SQL.format(n='pep_q', src='best')}
SELECT r.peptide, r.protein, r.score, psm_q.q AS QValue, pep_q.q AS PepQValue FROM r JOIN psm_q ON psm_q.score = r.score JOIN pep USING (peptide) JOIN pep_q ON pep_q.score = pep.best""")
def fdr_unrolled(spark, sf_dir):
    """A list with a row for each protein of a match: rows that differ in it only are one match, a decoy where all proteins are."""
    return fd.fdr(matches(spark, sf_dir).select("peptide", "protein", "score"), "peptide", "protein", "score")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS scan, 'K.' || upper(c_mktsegment) || '.R' AS peptide, CASE WHEN c_custkey % 5 > 0 THEN CAST(c_custkey % 5 AS INTEGER) END AS charge, c_name AS title FROM customer WHERE c_custkey % 7 > 0""")
def match_list(spark, sf_dir):
    """A tab-separated list: charges that are no numbers are null, rows without a scan are skipped, other columns stay."""
    c, path = table(spark, sf_dir, "customer"), _folder(spark, "list")
    key = F.col("c_custkey")
    rows = c.select(
        key.alias("at"), F.when(key % 7 > 0, key.cast("string")).otherwise("").alias("#ScanNum"), F.concat(F.lit("K."), F.upper("c_mktsegment"), F.lit(".R")).alias("Peptide"),
        F.when(key % 5 > 0, (key % 5).cast("string")).otherwise("two").alias("Charge"), F.col("c_name").alias("Title"),
    )
    sinks.write_report(rows, ["#ScanNum", "Peptide", "Charge", "Title"], ["at"], path)
    return read_matches(spark, path).select("scan", "peptide", "charge", "title")


@query(f"SELECT residue, round(frequency, 6) AS probability FROM ({ORACLE_SQL['aa_composition']})")
def residue_frequencies(spark, sf_dir):
    """The composition of all texts through a file of residue probabilities: twenty lines."""
    path = _folder(spark, "residues")
    shares = dig.composition(proteins(spark, sf_dir))
    shares.select(F.concat("residue", F.lit(" "), F.col("frequency").cast("string"), F.lit(" # share"))).coalesce(1).write.text(path)
    return spark.createDataFrame(list(read_residue_frequencies(spark, path).items()), "residue string, probability double").withColumn("probability", F.round("probability", 6))


@query(f"""WITH m(residue, mass) AS (VALUES {MASS_LIST}), d AS (SELECT DISTINCT peptide FROM ({PEPTIDES_SQL})), r AS (SELECT peptide, unnest(string_split(peptide, '')) AS residue FROM d),
x AS (SELECT peptide, sum(mass) AS mass FROM r JOIN m USING (residue) GROUP BY peptide)
SELECT peptide, left(peptide, 1) AS first, CAST(42.011 + CASE WHEN length(peptide) % 2 = 0 THEN -17.027 ELSE 0 END AS DOUBLE) AS delta, round(mass + 42.011 + CASE WHEN length(peptide) % 2 = 0 THEN -17.027 ELSE 0 END + 5e-11, 6) AS mass, 1 AS n_mods, false AS strict FROM x""")
def leading_changes(spark, sf_dir):
    """Annotated sequences with changes before their first letter and white space, which match lists do not allow.

    Masses have ten decimals: half of the last keeps sums away from ties of the rounding.
    """
    rows = peptides(spark, sf_dir).select("peptide").distinct()
    text = F.concat(F.lit("+42.011"), F.when(F.length("peptide") % 2 == 0, "-17.027").otherwise(""), F.substring("peptide", 1, 1), F.lit(" "), F.expr("substring(peptide, 2)"))
    rows = rows.select("peptide", text.alias("text")).withColumn("sites", chem.residues(F.col("text"), leading=True))
    mass = F.aggregate("sites", F.lit(0.0), lambda a, x: a + chem.site_mass(x))
    return rows.select("peptide", F.col("sites")[0]["aa"].alias("first"), F.round(F.col("sites")[0]["delta"], 6).alias("delta"), F.round(mass + 5e-11, 6).alias("mass"), chem.num_mods(F.col("sites")).alias("n_mods"), chem.residues(F.col("text")).isNotNull().alias("strict"))


@query("""WITH s AS (SELECT o_custkey, max(o_orderkey) AS o FROM orders WHERE o_orderkey % 5 > 0 GROUP BY 1)
SELECT c_custkey AS input_pos, c_custkey % 3 AS given, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 3 AS INTEGER) WHEN o % 4 > 0 THEN CAST(o % 4 AS INTEGER) END AS charge,
  CASE WHEN o IS NULL THEN 'no spectrum' WHEN c_custkey % 3 = 0 AND o % 4 = 0 THEN 'no charge' ELSE 'bad peptide' END AS status, CAST(NULL AS INTEGER) AS raw_score FROM customer LEFT JOIN s ON o_custkey = c_custkey""")
def skip_reasons(spark, sf_dir):
    """A match list of strings that are no peptides, rescored: each row stays, with the first reason against it."""
    customers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("spec_index"), F.col("o_custkey").cast("string").alias("scan"))
    spectra = _spectra(spark, sf_dir).drop("scan").join(customers, "spec_index")
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(key.alias("input_pos"), (key % 3).alias("given"), key.cast("string").alias("scan"), F.col("c_name").alias("peptide"), F.when(key % 3 > 0, key % 3).cast("int").alias("charge"))
    return rescore(rows, spectra).select("input_pos", "given", "charge", "status", "raw_score")


_REPORT_SQL = """SELECT l_orderkey AS k, l_linenumber AS i, l_partkey AS p, l_suppkey AS s, CAST(l_extendedprice AS DOUBLE) AS price, CAST(l_quantity AS DOUBLE) AS q, CAST(l_discount AS FLOAT) AS d FROM lineitem"""
_SCI = "upper(replace(regexp_replace(printf('%.6e', {x}), 'e([+-])0*([0-9])', 'e\\1\\2'), 'e+', 'e'))"
_SHORT = "regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"


@query(f"""SELECT 'file' AS SpecFile, 'index=' || k AS SpecID, CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) ELSE '-1' END AS ScanNum, CASE WHEN k % 3 = 0 THEN 'ETD' ELSE 'N/A' END AS FragMethod, printf('%.5f', price) AS Precursor, CAST(i AS VARCHAR) AS IsotopeError,
  printf('%.4f', q) AS "PrecursorError(ppm)", CAST(2 + k % 2 AS VARCHAR) AS Charge, 'K.PEPTIDE.R' AS Peptide, unnest(['P' || p, 'S' || s]) AS Protein, CAST(p AS VARCHAR) AS DeNovoScore, CAST(s AS VARCHAR) AS MSGFScore,
  {_SCI.format(x='q / 1e12')} AS SpecEValue, {_SCI.format(x='q * 1000')} AS EValue, {_SHORT.format(x='d')} AS QValue, {_SHORT.format(x='d')} AS PepQValue FROM ({_REPORT_SQL})""")
def search_report(spark, sf_dir):
    """Matches as the sixteen columns of a search report, a row for each protein, written in order as compressed text and read back."""
    key, path = F.col("l_orderkey"), _folder(spark, "report")
    rows = table(spark, sf_dir, "lineitem").select(
        F.lit("file").alias("spec_file"), key.alias("spec_index"), F.when(key % 2 == 0, key.cast("string")).alias("scan"), F.when(key % 3 == 0, "etd 3").otherwise("none").alias("title"),
        F.col("l_extendedprice").cast("double").alias("precursor_mz"), F.col("l_linenumber").alias("isotope"), F.col("l_quantity").cast("double").alias("precursor_error"), (2 + key % 2).alias("charge"),
        F.lit("K.PEPTIDE.R").alias("peptide"), F.array(F.concat(F.lit("P"), F.col("l_partkey").cast("string")), F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))).alias("proteins"),
        F.col("l_partkey").alias("denovo_score"), F.col("l_suppkey").alias("raw_score"), (F.col("l_quantity").cast("double") / 1e12).alias("spec_evalue"), (F.col("l_quantity").cast("double") * 1000).alias("evalue"),
        F.col("l_discount").cast("float").alias("q_value"), F.col("l_discount").cast("float").alias("pep_q_value"),
    )
    sinks.write_search(rows, path, unroll=True, compression="snappy")
    return read_tsv(spark, path)


#: Two precursor offsets of charge 2, whole and reduced by one charge, emptied within 2,000 of m/z (the peaks' are hundredths).
_EMPTIED = Model(tolerance=2000.0, deconvolute=False, precursors=[(2, 0, 0.0, True, 2000.0, 1.0), (2, 1, 0.0, True, 2000.0, 1.0)])


@query(f"""WITH o AS (SELECT o_orderkey, CAST(10000 + CAST(round(o_totalprice * 100) AS BIGINT) % 150000 AS FLOAT) AS mz0 FROM orders),
c AS (SELECT o_orderkey, CAST(mz0 * CAST(2 AS FLOAT) - CAST(2 AS FLOAT) * CAST(1.0072764669 AS FLOAT) AS FLOAT) AS mass FROM o),
w AS (SELECT o_orderkey, z, CAST((mass + z * CAST(1.00727649 AS FLOAT)) / z AS FLOAT) AS centre FROM c, (SELECT CAST(unnest([1, 2]) AS FLOAT) AS z)),
b AS (SELECT o_orderkey, max(centre) FILTER (z = 1) AS one, max(centre) FILTER (z = 2) AS two FROM w GROUP BY 1),
p AS (SELECT spec_index, mz, CASE WHEN CAST(mz AS FLOAT) BETWEEN one - CAST(2000 AS FLOAT) AND one + CAST(2000 AS FLOAT) OR CAST(mz AS FLOAT) BETWEEN two - CAST(2000 AS FLOAT) AND two + CAST(2000 AS FLOAT) THEN CAST(0 AS FLOAT) ELSE CAST(intensity AS FLOAT) END AS intensity
  FROM ({PEAKS_SQL}) JOIN b ON o_orderkey = spec_index)
SELECT spec_index, CAST(mz AS FLOAT) AS mz, intensity, row_number() OVER (PARTITION BY spec_index ORDER BY intensity DESC, mz DESC) AS rank FROM p""")
def preprocessed_peaks(spark, sf_dir):
    """Peaks as scoring sees them: those at the precursor emptied, then ranked, in single precision."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("spec_index"), (10000 + F.round(F.col("o_totalprice") * 100).cast("bigint") % 150000).cast("double").alias("precursor_mz"))
    line = peaks(spark, sf_dir).groupBy("spec_index").agg(F.collect_list(F.struct(F.col("mz").cast("double").alias("mz"), F.col("intensity").cast("double").alias("intensity"))).alias("p"))
    rows = o.join(line, "spec_index").select("spec_index", "precursor_mz", F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [preprocess(_EMPTIED, 2, precursor_mass(r.precursor_mz, 2), r.mz, r.intensity) for r in batch.itertuples()]
            columns = {n: np.concatenate(c) for n, c in zip(("mz", "intensity", "rank"), zip(*made, strict=True), strict=True)}
            yield pd.DataFrame({"spec_index": np.repeat(batch["spec_index"].to_numpy(), [len(m[0]) for m in made]), **columns})

    return rows.mapInPandas(run, "spec_index long, mz float, intensity float, rank long")
