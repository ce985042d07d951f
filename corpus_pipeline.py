"""The corpus pipeline: language, near duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir), with docs as the stage before has written them, and returns a DataFrame. All but
the last return the columns of documents; the last returns a place in a batch for each document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massspark.llm import decontam, langid, packing, secrets
from massspark.llm.common import table, written
from massspark.llm.neardup import near_duplicates

#: Texts whose grams lie further from every language's profile than this score are rejected with those without a letter.
LEAST_SCORE = 0.15
#: No SQL expresses the language, decontamination and secret stages; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the profiles know; they are learned from docs as they come, held-out ones left out.

    Null texts and texts without a letter are rejected. Without any row that has doc_id, text and lang nothing is learned, and
    every document is rejected.
    """
    return langid.recognised(docs, langid.fit(docs), LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates: five-word shingles, similarity 0.8.

    Null and blank texts are near nothing, and rows without doc_id stay. Rows of one doc_id are one document.
    """
    gone = near_duplicates(docs, k=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no part of a benchmark item; null and empty texts and items hold nothing."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every secret masked, n_chars counted anew; both stay null where the text is."""
    masked = secrets.redacted(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def length_buckets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A bucket, batch and slot for each row; a null text has the length of an empty one."""
    return packing.pack(docs, packing.byte_tokens())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("length_buckets", length_buckets),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
