"""Protein databases, match lists and small parameter files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massspark.functions.chem import RESIDUES
from massspark.operators.digest import Enzyme
from massspark.operators.matching import Mods


def read_fasta(spark: SparkSession, path: str, decoy: str = "XXX_") -> DataFrame:
    """accession, description, sequence, is_decoy of a FASTA file or folder, with header and raw lines for writing back.

    What stands before the first `>` at a line's start is ignored. The accession is the header's first word; sequences lose
    white space and become upper case; letters that are no residues stay. An entry of a header alone has an empty sequence,
    one of a `>` alone an empty accession too.
    """
    text = spark.read.option("lineSep", "\n>").text(path).select("value", F.monotonically_increasing_id().alias("_at"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"))
    # only the first piece of a file can hold what precedes its entries, or still has its `>`
    firsts = text.groupBy("_file").agg(F.min(F.struct("_from", "_at")).alias("x")).select(F.col("x._at").alias("_at"), F.lit(True).alias("_first"))
    rows = text.join(F.broadcast(firsts), "_at", "left")  # a row for each file
    first = F.col("_first").isNotNull()
    rows = rows.where(~first | F.col("value").startswith(">"))
    entry = F.when(first, F.substring("value", F.lit(2), F.lit(1 << 30))).otherwise(F.col("value"))
    rows = rows.select(F.regexp_replace(entry, "\r", "").alias("entry"))
    header = F.substring_index("entry", "\n", 1)
    body = F.when(F.contains("entry", F.lit("\n")), F.substring(F.col("entry"), F.length(header) + 2, F.lit(1 << 30))).otherwise("")
    accession = F.regexp_extract(header, r"^\s*(\S*)", 1)
    return rows.select(
        accession.alias("accession"), F.trim(F.regexp_replace(header, r"^\s*\S*", "")).alias("description"), F.upper(F.regexp_replace(body, r"\s", "")).alias("sequence"),
        (F.lit(bool(decoy)) & accession.startswith(decoy)).alias("is_decoy"), header.alias("header"), body.alias("body"),
    )


def with_decoy_entries(fasta: DataFrame, prefix: str = "XXX_") -> DataFrame:
    """entry lines of a target-decoy FASTA: the targets line by line, then each one reversed on one line under the prefix."""
    target = F.concat(F.lit(">"), F.col("header"), F.lit("\n"), F.regexp_replace("body", r"\s+$", ""))
    turned = F.trim(F.reverse(F.regexp_replace("body", "\n", "")))
    decoy = F.concat(F.lit(">" + prefix), F.col("header"), F.lit("\n"), turned)
    return fasta.select(F.lit(0).alias("block"), target.alias("entry")).unionByName(fasta.select(F.lit(1).alias("block"), decoy.alias("entry")))


def _table(spark: SparkSession, path: str) -> tuple[str | None, DataFrame]:
    """The first line of a tab-separated file, or of the first file of a folder by name, and all other lines (value) that hold text.

    A folder is one table: its other files go on where the one before ends. Lines that equal the first are headers again, as in
    files that were written one by one. Blank lines count for nothing.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    for name in sorted(lines.inputFiles()):
        head = spark.read.text(name).where((F.trim("value") != "") & (F.col("_metadata.file_block_start") == 0)).first()
        if head is not None:
            return head[0], lines
    return None, lines


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """input_pos, scan, peptide, charge and all other columns of a tab-separated match list.

    The first line is a header if it has the word peptide; else the columns are scan, peptide and charge. Rows without
    scan or peptide are skipped; a list without rows is an error.
    """
    head, lines = _table(spark, path)
    if head is None:
        raise ValueError(f"{path}: no matches")
    lines = lines.withColumn("input_pos", F.monotonically_increasing_id())
    cells = F.split("value", "\t")
    if "peptide" in head.lower():
        names = [n.strip().lstrip("#").lower() for n in head.split("\t")]
        rows = lines.where(F.col("value") != head)
    else:
        names, rows = ["scan", "peptide", "charge"], lines
    names = ["scan" if n in ("scannum", "scans") else n for n in names]
    out = rows.select("input_pos", *[F.trim(F.try_element_at(cells, F.lit(i + 1))).alias(n) for i, n in enumerate(names)])
    charge = F.col("charge").try_cast("int") if "charge" in names else F.lit(None).cast("int")
    return out.withColumn("charge", charge).where((F.coalesce("scan", F.lit("")) != "") & (F.coalesce("peptide", F.lit("")) != ""))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Every column of a tab-separated table with a header, as strings, empty cells as nulls; a leading # of the header goes."""
    head, lines = _table(spark, path)
    if head is None:
        raise ValueError(f"{path}: no header")
    cells = F.split("value", "\t")
    names = [n.lstrip("#").strip() for n in head.split("\t")]
    return lines.where(F.col("value") != head).select(*[F.nullif(F.try_element_at(cells, F.lit(i + 1)), F.lit("")).alias(n) for i, n in enumerate(names)])


def _lines(spark: SparkSession, path: str) -> list[str]:
    """A parameter file's lines, read through Spark wherever it lies."""
    return spark.read.text(path, wholetext=True).first()[0].splitlines()


def read_residue_frequencies(spark: SparkSession, path: str) -> dict[str, float]:
    """`residue probability` lines with comments behind #."""
    out = {}
    for n, line in enumerate(_lines(spark, path), 1):
        fields = line.split("#")[0].split()
        if not fields:
            continue
        if len(fields) != 2 or fields[0].upper() not in RESIDUES:
            raise ValueError(f"{path}:{n}: expected a residue and its probability")
        try:
            out[fields[0].upper()] = float(fields[1])
        except ValueError as e:
            raise ValueError(f"{path}:{n}: `{fields[1]}` is no number") from e
    return out


def read_mods(spark: SparkSession, path: str) -> Mods:
    try:
        return Mods.parse("\n".join(_lines(spark, path)))
    except ValueError as e:
        raise ValueError(f"{path}: {e}") from e


def read_enzymes(spark: SparkSession, path: str) -> dict[str, Enzyme]:
    lines = [x.split("#")[0].strip() for x in _lines(spark, path)]
    return {e.name: e for e in (Enzyme.parse(x) for x in lines if x)}
