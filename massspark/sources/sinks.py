"""Report lines as tab-separated text, ready for DataFrameWriter.text after an orderBy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massspark.functions.chem import fragmentation_method

# Column names of the search report and of rescored lists.
SEARCH_HEADER = "#SpecFile SpecID ScanNum FragMethod Precursor IsotopeError PrecursorError(ppm) Charge Peptide Protein DeNovoScore MSGFScore SpecEValue EValue QValue PepQValue".split()
RESCORED_HEADER = "scan peptide charge raw_score denovo_score spec_evalue".split()


def scientific(x: Column, upper: bool = True) -> Column:
    """Six decimals and an exponent without padding or plus sign: 1.000000E-10."""
    text = F.regexp_replace(F.format_string("%.6e", x.cast("double")), r"e([+-])0*(\d)", "e$1$2")
    text = F.replace(text, F.lit("e+"), F.lit("e"))
    return F.when(x.isNull() | F.isnan(x), "NA").otherwise(F.upper(text) if upper else text)


def shortest(x: Column) -> Column:
    """A single-precision number in its shortest form, whole numbers without a point; NA if it is none."""
    return F.when(x.isNull() | F.isnan(x), "NA").otherwise(F.regexp_replace(x.cast("float").cast("string"), r"\.0$", ""))


def search_rows(matches: DataFrame, unroll: bool = False) -> DataFrame:
    """The sixteen report columns of matches, proteins joined by ; or, unrolled, on a row each."""
    rows = matches.withColumn("_protein", F.explode_outer("proteins") if unroll else F.array_join("proteins", ";"))
    values = [
        F.col("spec_file"), F.concat(F.lit("index="), F.col("spec_index").cast("string")), F.coalesce("scan", F.lit("-1")), fragmentation_method(F.col("title")),
        F.format_string("%.5f", "precursor_mz"), F.col("isotope").cast("string"), F.format_string("%.4f", "precursor_error"), F.col("charge").cast("string"), F.col("peptide"),
        F.coalesce("_protein", F.lit("")), F.col("denovo_score").cast("string"), F.col("raw_score").cast("string"), scientific(F.col("spec_evalue")), scientific(F.col("evalue")),
        shortest(F.col("q_value")), shortest(F.col("pep_q_value")),
    ]
    return rows.select("spec_index", "spec_evalue", *[v.alias(n) for n, v in zip(SEARCH_HEADER, values, strict=True)])


def tsv(rows: DataFrame, columns: list[str]) -> Column:
    """The columns' strings with tabs between."""
    return F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns])


def write_report(rows: DataFrame, columns: list[str], order: list[str], path: str, compression: str | None = None) -> None:
    """A folder of text files that, read in the order of their names, are the report: the header, then the rows in order.

    Sorting is by range, so each task writes a file of its own. compression: as Spark's text writer takes it, such as gzip; none by default."""
    keys = [f"_key{i}" for i in range(len(order))]
    lines = rows.select(F.lit(1).alias("_part"), *[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)], tsv(rows, columns).alias("value"))
    head = rows.sparkSession.range(1).select(F.lit(0).alias("_part"), *[F.lit(None).cast(lines.schema[k].dataType).alias(k) for k in keys], F.lit("\t".join(columns)).alias("value"))
    head.unionByName(lines).orderBy("_part", *keys).select("value").write.mode("overwrite").text(path, compression=compression)


def write_search(matches: DataFrame, path: str, unroll: bool = False, compression: str | None = None) -> None:
    """The report of a search, the best E-values first."""
    write_report(search_rows(matches, unroll), SEARCH_HEADER, ["spec_evalue", "spec_index", "Protein"], path, compression)


def write_rescored(rescored: DataFrame, path: str) -> None:
    """The scored rows of a rescored match list in the order of the input."""
    scored = rescored.where("status = 'scored'").withColumn("spec_evalue", scientific(F.col("spec_evalue"), upper=False))
    more = ["evalue"] if "evalue" in rescored.columns else []
    scored = scored.withColumn("evalue", scientific(F.col("evalue"), upper=False)) if more else scored
    write_report(scored, [*RESCORED_HEADER, *more], ["input_pos"], path)


def write_fdr(rows: DataFrame, order: str, path: str) -> None:
    """What fdr() returns, in the order of a column that isn't written; rows without a score have NA."""
    named = [c for c in rows.columns if c not in (order, "QValue", "PepQValue")]
    write_report(rows.withColumns({c: shortest(F.col(c)) for c in ("QValue", "PepQValue")}), [*named, "QValue", "PepQValue"], [order], path)
