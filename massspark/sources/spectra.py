"""Spectra from MGF files as DataFrames: blocks are split by the reader, fields taken by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "spec_file string, spec_index bigint, title string, scan string, charge int, precursor_mz double, peaks array<struct<mz:double,intensity:double>>, seq string"


def _header(key: str) -> Column:
    """The value of the last line KEY=value before the peaks; null if there is none."""
    found = F.filter(F.col("lines"), lambda x: x.startswith(f"{key}="))
    return F.substring(F.try_element_at(found, F.lit(-1)), F.lit(len(key) + 2), F.lit(1 << 30))


def parsed(blocks: DataFrame) -> DataFrame:
    """Columns of a spectrum from `block`, the text of an MGF file between one END IONS and the next.

    What stands before BEGIN IONS is ignored. A peak line starts with a digit; a missing intensity is 0. PEPMASS takes its
    first number, CHARGE its number without the sign behind it, and null where either isn't one. Unknown keys are ignored.
    """
    body = F.regexp_replace(F.substring_index("block", "BEGIN IONS", -1), "\r", "")
    rows = blocks.where(F.contains("block", F.lit("BEGIN IONS"))).withColumn("lines", F.transform(F.split(body, "\n"), lambda x: F.trim(x)))

    def peak(line: Column) -> Column:
        parts = F.split(line, r"\s+")
        return F.struct(parts[0].try_cast("double").alias("mz"), F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("double"), F.lit(0.0)).alias("intensity"))

    peaks = F.filter(F.transform(F.filter("lines", lambda x: x.rlike("^[0-9]")), peak), lambda p: p["mz"].isNotNull())
    return rows.select(
        *[c for c in blocks.columns if c != "block"], _header("TITLE").alias("title"), _header("SCANS").alias("scan"),
        F.regexp_replace(F.trim(_header("CHARGE")), "[+-]$", "").try_cast("int").alias("charge"),
        F.split(F.trim(_header("PEPMASS")), r"\s+")[0].try_cast("double").alias("precursor_mz"), peaks.alias("peaks"), _header("SEQ").alias("seq"),
    )


def read_mgf(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Spectra of MGF files or folders with spec_file and spec_index, which counts from 0 in a file in file order.

    A file is read in as many splits as it takes. A spectrum's number is its place in its split plus the spectra in the splits
    before: what is summed over a file has a row for each split, and spectra stay where they were read.
    """
    text = spark.read.option("lineSep", "END IONS").text(paths if isinstance(paths, list) else [paths])
    named = text.select(F.col("_metadata.file_path").alias("spec_file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("block"))
    sound = F.contains("block", F.lit("BEGIN IONS"))
    # ids of a split's blocks follow each other; blocks that are no spectrum (most often a file's end) are no number's
    splits = named.groupBy("spec_file", "_from").agg(F.min("_at").alias("_first"), F.count_if(sound).alias("_n"), F.collect_list(F.when(~sound, F.col("_at"))).alias("_none"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("spec_file").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.withColumn("_before", before)
    rows = parsed(named.where(sound)).join(splits, ["spec_file", "_from"])
    number = F.col("_at") - F.col("_first") + F.col("_before") - F.size(F.filter("_none", lambda x: x < F.col("_at")))
    return rows.select("spec_file", number.cast("long").alias("spec_index"), "title", "scan", "charge", "precursor_mz", "peaks", "seq")


def indexed(spectra: DataFrame) -> DataFrame:
    """The same with spec_index unique over all files: the files in order of their names, the spectra in their own."""
    sizes = spectra.groupBy("spec_file").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("spec_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per file
    return spectra.join(sizes.select("spec_file", before.alias("_before")), "spec_file").withColumn("spec_index", F.col("spec_index") + F.col("_before")).drop("_before")


def to_mgf(spectra: DataFrame) -> DataFrame:
    """block: each spectrum as MGF text, for DataFrameWriter.text."""
    def line(key: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{key}="), value.cast("string")))

    charge = F.when(F.col("charge").isNotNull(), F.concat(F.abs("charge").cast("string"), F.when(F.col("charge") < 0, "-").otherwise("+")))
    peaks = F.array_join(F.transform("peaks", lambda p: F.concat_ws(" ", p["mz"].cast("string"), p["intensity"].cast("string"))), "\n")
    own = [line("SEQ", F.col("seq"))] if "seq" in spectra.columns else []
    head = [F.lit("BEGIN IONS"), line("TITLE", F.col("title")), line("PEPMASS", F.col("precursor_mz")), line("CHARGE", charge), line("SCANS", F.col("scan")), *own]
    return spectra.select(F.concat_ws("\n", *head, peaks, F.lit("END IONS"), F.lit("")).alias("block"))
