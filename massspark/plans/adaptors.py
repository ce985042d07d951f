"""The driver's tables seen as proteins, peaks, spectra and matches; each view with the SQL that defines it as well."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from massspark.functions import chem
from massspark.operators.digest import Digest, digest
from massspark.operators.staging import in_ranges, sums_before, written
from massspark.operators.train import train
from massspark.sources.model import Model


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _proteins(rows: DataFrame, accession: Column) -> DataFrame:
    sequence = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""))
    return rows.select(accession.alias("accession"), sequence.alias("sequence"), F.lit(False).alias("is_decoy"))


def proteins(spark: SparkSession, sf_dir: str, accession: Column | None = None) -> DataFrame:
    """Whole document texts, letters only."""
    return _proteins(table(spark, sf_dir, "documents"), F.concat(F.lit("D"), F.col("doc_id").cast("string")) if accession is None else accession)


def short_proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark texts, for what looks at every substring."""
    return _proteins(table(spark, sf_dir, "benchmark"), F.concat(F.lit("B"), F.col("item_id").cast("string")))


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as the peaks of a spectrum; m/z in whole hundredths."""
    line = table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return line.select(F.col("l_orderkey").alias("spec_index"), (10000 + cents % 150000).alias("mz"), F.col("l_quantity").alias("intensity"), cents.alias("cents"), "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as peptide-spectrum matches of a single-precision score, with ties."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("match_id"), F.round(F.coalesce("value", F.lit(0.0)), 1).cast("float").alias("score"),
        F.concat(F.lit("PEP"), F.floor(F.col("user_id") / 2).cast("string")).alias("peptide"), (F.col("user_id") % 2 == 1).alias("is_decoy"),
        F.when(F.col("user_id") % 2 == 1, F.concat(F.lit("XXX_"), "event_type")).otherwise(F.col("event_type")).alias("protein"),
    )


def synthetic_spectra(peptides: DataFrame, background: int = 40) -> DataFrame:
    """Annotated spectra of peptide strings (peptide): all y ions, three of four b ions at half intensity, and noise.

    Everything follows from hashes of the peptide. The charge is 2 or 3; columns are those of read_mgf().
    """
    mass = chem.neutral_mass(F.col("peptide"))
    charge = (2 + F.pmod(F.xxhash64("peptide", F.lit("z")), F.lit(2))).cast("int")

    def share(*x) -> Column:
        return F.pmod(F.xxhash64("peptide", *x), F.lit(100_000)) / 100_000.0

    letters = chem.letters(F.col("peptide"))
    sums = F.transform(F.sequence(F.lit(1), F.length("peptide") - 1), lambda i: F.aggregate(F.slice(letters, F.lit(1), i), F.lit(0.0), lambda a, r: a + F.element_at(chem.masses(), r)))
    y = F.transform(sums, lambda p, i: F.struct((mass - p + chem.PROTON).alias("mz"), (F.lit(200.0) + 100 * share(F.lit("y"), i)).alias("intensity")))
    b = F.filter(F.transform(sums, lambda p, i: F.struct((p + chem.PROTON).alias("mz"), F.when(share(F.lit("b"), i) < 0.75, F.lit(100.0) + 50 * share(F.lit("c"), i)).alias("intensity"))), lambda x: x["intensity"].isNotNull())
    noise = F.transform(F.sequence(F.lit(1), F.lit(background)), lambda i: F.struct((F.lit(100.0) + share(F.lit("n"), i) * mass).alias("mz"), (F.lit(1.0) + 60 * share(F.lit("i"), i)).alias("intensity")))
    rows = in_ranges(peptides.select("peptide").distinct().where(chem.is_standard(F.col("peptide")) & (F.length("peptide") > 1)), "peptide")
    before = sums_before(rows.withColumn("n", F.lit(1)), ["n"])
    place = F.row_number().over(Window.partitionBy("part").orderBy("peptide"))
    return rows.join(before, "part").select(
        F.lit("synthetic").alias("spec_file"), (place - 1 + F.col("n_before")).cast("long").alias("spec_index"), F.concat(F.lit("HCD "), "peptide").alias("title"), F.sha1("peptide").alias("scan"),
        charge.alias("charge"), ((mass + charge * chem.PROTON) / charge).alias("precursor_mz"), F.array_sort(F.concat(y, b, noise)).alias("peaks"), F.col("peptide").alias("seq"),
    )


@functools.lru_cache(maxsize=2)
def _annotated(application: str, sf_dir: str) -> DataFrame:
    spark = SparkSession.active()
    return written(synthetic_spectra(digest(short_proteins(spark, sf_dir), Digest(max_missed=1)).select("peptide").distinct()), "annotated")


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated spectra of the benchmark texts' peptides: written once for all queries of an application."""
    return _annotated(spark.sparkContext.applicationId, sf_dir)


@functools.lru_cache(maxsize=2)
def _model(application: str, sf_dir: str) -> Model:
    return train(_annotated(application, sf_dir))


def model(spark: SparkSession, sf_dir: str) -> Model:
    """The model trained on them, once for all queries of an application, as a user loads one for many searches."""
    return _model(spark.sparkContext.applicationId, sf_dir)


PROTEINS_SQL = "SELECT 'D' || doc_id AS accession, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS sequence FROM documents"
SHORT_PROTEINS_SQL = "SELECT 'B' || item_id AS accession, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS sequence FROM benchmark"
PEAKS_SQL = """SELECT l_orderkey AS spec_index, 10000 + CAST(round(l_extendedprice * 100) AS BIGINT) % 150000 AS mz, l_quantity AS intensity,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_partkey, l_suppkey, l_linenumber, l_shipdate FROM lineitem"""
MATCHES_SQL = """SELECT event_id AS match_id, CAST(round(coalesce(value, 0.0), 1) AS FLOAT) AS score, 'PEP' || CAST(user_id // 2 AS VARCHAR) AS peptide,
  user_id % 2 = 1 AS is_decoy, CASE WHEN user_id % 2 = 1 THEN 'XXX_' || event_type ELSE event_type END AS protein FROM events"""
