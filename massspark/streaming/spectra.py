"""MGF folders as a stream: spectra arrive as files do, and q-values follow from counts that are carried from batch to batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from massspark.operators.fdr import best_per_peptide, q_map, q_map_of, score_counts, with_q_values
from massspark.sources.spectra import parsed


def stream_mgf(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """A streaming DataFrame of spectra, as search() takes them. spec_index is a hash of the file and the block's text: a stream
    has no running number, and equal blocks of a file are one spectrum."""
    reader = spark.readStream.format("text").schema("value string").option("lineSep", "END IONS").option("maxFilesPerTrigger", files_per_trigger)
    text = reader.load(folder)
    return parsed(text.select(F.col("_metadata.file_path").alias("spec_file"), F.xxhash64("_metadata.file_path", "value").alias("spec_index"), F.col("_metadata.file_modification_time").alias("arrived"), F.col("value").alias("block")))


def peak_counts(spectra: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Spectra and peaks by charge in tumbling windows of arrival, with a watermark for late files."""
    return spectra.withWatermark("arrived", late).groupBy(F.window("arrived", window), "charge").agg(F.count("*").alias("spectra"), F.sum(F.size("peaks")).alias("peaks"))


def search_stream(spectra: DataFrame, score: Callable[[DataFrame], DataFrame], matches: str, state: str, checkpoint: str) -> StreamingQuery:
    """Score each micro-batch, append its matches (score, peptide, is_decoy, ...) under `matches`, and carry the state on.

    The state is what q-values depend on: targets and decoys of each distinct score, the best score of each peptide, and the
    two maps from a score to its q-value. A batch adds its own counts to those of the batch before, so matches are never
    read again; its cost is its own size and that of the distinct scores and peptides. A batch writes folders of its own, so one
    that is run again after a failure replaces what it had written, and readers of latest() see the last whole state meanwhile.
    The state of the batch before is kept, older ones are deleted.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        done = _states(spark, state, below=number)

        def carried(name: str, new: DataFrame) -> DataFrame:
            return new.unionByName(spark.read.parquet(f"{state}/{name}/upto={done[-1]}")) if done else new

        score(rows).write.mode("overwrite").parquet(f"{matches}/batch={number}")
        scored = spark.read.parquet(f"{matches}/batch={number}").where("score is not null")
        counts = carried("counts", score_counts(scored)).groupBy("score").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        best = carried("best", best_per_peptide(scored)).groupBy("peptide", "is_decoy").agg(F.min("score").alias("score"))
        for name, make in (("counts", lambda: counts), ("best", lambda: best), ("psm", lambda: q_map_of(read("counts"))), ("peptides", lambda: q_map(read("best")))):
            read = lambda x: spark.read.parquet(f"{state}/{x}/upto={number}")
            make().write.mode("overwrite").parquet(f"{state}/{name}/upto={number}")
        for old in done[:-1]:
            for name in ("peptides", "psm", "best", "counts"):
                _delete(spark, f"{state}/{name}/upto={old}")

    return spectra.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    found, files = _path(spark, path)
    files.delete(found, True)


def _states(spark: SparkSession, state: str, below: int = 1 << 62) -> list[int]:
    """The batches whose state has been written whole, ascending: the map of peptides is the last thing that is written."""
    found, files = _path(spark, f"{state}/peptides")
    if not files.exists(found):
        return []
    numbers = [int(f.getPath().getName().split("=")[1]) for f in files.listStatus(found) if f.getPath().getName().startswith("upto=") and files.exists(_path(spark, f.getPath().toString() + "/_SUCCESS")[0])]
    return sorted(n for n in numbers if n < below)


def latest(spark: SparkSession, matches: str, state: str) -> DataFrame:
    """All matches with their q-values after the last batch whose state has been written whole."""
    last = _states(spark, state)[-1]
    read = lambda name: spark.read.parquet(f"{state}/{name}/upto={last}")
    rows = spark.read.parquet(matches).where(F.col("batch") <= last).drop("batch")
    return with_q_values(rows, read("psm"), read("best"), read("peptides"))
