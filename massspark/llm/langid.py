"""Language identification by rank-order profiles: the most frequent 1- to 3-grams of a text against each language's.

Words are runs of letters, lower-cased, with a blank on either side. A gram's code packs its code points, so grams never
collide. Ranks go by count, then by code. The out-of-place distance sums the differences of ranks; a gram that a
language's profile lacks costs the profile's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massspark.llm.common import mapped, slices

#: Grams of a profile.
PROFILE = 300
#: The learner reads so many documents of each language at most, chosen by a hash of doc_id.
FIT_DOCUMENTS = 5000
#: Up to so many languages the table of their sizes is broadcast; with more it is joined.
MOST_LANGUAGES = 10_000
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def grams(texts: list[str | None]) -> list[np.ndarray]:
    """The gram codes of each text, in order of length and place."""
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, low), np.int64, len(low)) + 1
    owner = np.repeat(np.arange(len(low)), lengths)  # the blank before a text is its own
    letter = _letter_table()[points]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # the first of the blanks after a word
    c = np.where(letter, points, 32).astype(np.uint64)[keep]
    owner = np.r_[owner, len(low) - 1][keep]
    blank = c == 32
    owner[:-1][blank[:-1]] = owner[1:][blank[:-1]]  # a blank goes with the word after it
    shift = np.uint64(21)
    two = c[:-1] << shift | c[1:]
    three = two[:-1] << shift | c[2:]
    inner = ~blank[1:-1]
    whose = [owner[~blank], np.where(blank[:-1], owner[:-1], owner[:-1]), owner[:-2][inner]]
    codes = [c[~blank], two, three[inner]]
    # a blank that ends a text stands for the next one's start too: the gram of a word's end is the word's
    edges = [np.searchsorted(w, np.arange(len(low) + 1)) for w in whose]
    return [np.concatenate([x[e[i] : e[i + 1]] for x, e in zip(codes, edges, strict=True)]) for i in range(len(low))]


def ranked(codes: np.ndarray, most: int) -> np.ndarray:
    """Distinct codes by falling count, then by code."""
    distinct, counts = np.unique(codes, return_counts=True)
    if len(distinct) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        distinct, counts = distinct[counts >= least], counts[counts >= least]
    return distinct[np.argsort(-counts, kind="stable")][:most]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        langs = np.array(batch.column("lang").to_pylist(), object)
        each = grams(batch.column("text").to_pylist())
        for lang in sorted(set(langs)):
            codes, counts = np.unique(np.concatenate([each[i] for i in np.flatnonzero(langs == lang)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(documents: DataFrame, profile: int = PROFILE, most: int = FIT_DOCUMENTS) -> dict[str, np.ndarray]:
    """A ranked profile for each language, of documents that are not held out and have a text and a language.

    Where a language has more than `most` documents, a hash of doc_id picks about as many. A profile has a fixed length,
    so what comes to the driver is bounded by the number of languages.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("documents"))
    few = sizes.limit(MOST_LANGUAGES + 1).collect()
    if len(few) <= MOST_LANGUAGES:  # so small that no text need be shuffled by its language
        sizes = F.broadcast(rows.sparkSession.createDataFrame([tuple(r) for r in few], sizes.schema))
    chosen = rows.join(sizes, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) * F.col("documents") < most * 1_000_000)
    counted = chosen.select("lang", "text").transform(mapped, _count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counted.withColumn("place", place).where(F.col("place") <= profile).collect()
    out: dict[str, list] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["place"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(g, np.int64).view(np.uint64) for lang, g in out.items()}


def distances(codes: np.ndarray, union: np.ndarray, ranks: np.ndarray, profile: int) -> tuple[np.ndarray, int]:
    """The out-of-place distance to each language, and the most that it could be."""
    top = ranked(codes, profile)
    at = np.minimum(np.searchsorted(union, top), len(union) - 1)
    known = union[at] == top
    apart = np.abs(ranks[at] - np.arange(len(top))[:, None])
    apart = np.where(known[:, None] & (ranks[at] < profile), apart, profile)
    return apart.sum(axis=0), len(top) * profile


def _predictor(profiles: dict[str, np.ndarray], profile: int):
    langs = sorted(profiles)
    union = np.unique(np.concatenate([profiles[x] for x in langs])) if langs else np.zeros(0, np.uint64)
    ranks = np.full((len(union), len(langs)), profile, np.int64)
    for i, x in enumerate(langs):
        ranks[np.searchsorted(union, profiles[x]), i] = np.arange(len(profiles[x]))

    def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
        preds, scores = [], []
        for codes in grams(texts):
            if not len(codes) or not langs:
                preds.append("und")
                scores.append(0.0)
                continue
            apart, most = distances(codes, union, ranks, profile)
            best = int(np.argmin(apart))
            preds.append(langs[best])
            scores.append(1 - float(apart[best]) / most)
        return preds, scores

    return predict


def _predict(profiles: dict[str, np.ndarray], profile: int):
    predict = _predictor(profiles, profile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            preds, scores = predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(documents: DataFrame, profiles: dict[str, np.ndarray], profile: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred, score (1: every gram at its place, 0: none known): one row per input row.

    Looks at the text only. A null text or one without a letter is `und` at score 0, as is all when nothing was learned.
    Ties go to the language that sorts first. A null doc_id is kept, as not held out. An empty table gives an empty
    result. The profiles travel with the task: their size is bounded by the number of languages.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.transform(mapped, _predict(profiles, profile), "doc_id long, held_out boolean, lang_pred string, score double")


def recognised(documents: DataFrame, profiles: dict[str, np.ndarray], least: float, profile: int = PROFILE) -> DataFrame:
    """The rows, with all their columns, whose text is in a learned language with a score of `least` or more.

    A null text or one without a letter is in none, and without any learned language no row is left. Repeated rows are judged
    each; a null doc_id or lang does not matter; an empty table gives an empty result.
    """
    predict = _predictor(profiles, profile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            preds, scores = predict(batch.column("text").to_pylist())
            yield batch.filter(pa.array([p != "und" and s >= least for p, s in zip(preds, scores, strict=True)], pa.bool_()))

    return documents.transform(mapped, run, documents.schema)
