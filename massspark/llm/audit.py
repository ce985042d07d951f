"""Filter interaction audit: what five text filters remove in each of their 120 orders, and what each removes alone.

Texts are scanned in their Arrow buffers: byte classes by table lookup, counts by prefix sums, distinct words by sorted word
hashes whose equal neighbours are compared byte by byte. A document is then a mask of the filters that it fails, and masks
are counted by part and label before anything else is asked of them.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massspark.llm.common import PASS_BYTES, byte_view, forget, mapped, mix, slices, written

#: Fewest words, least share of distinct words and most capitals, both in percent.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
FILTERS = "ABCDE"

_POINTS = np.arange(256)
_WORD = ~np.isin(_POINTS, [32, 9, 10, 11, 12, 13])
#: Characters that are counted: capitals, symbols, and the first byte of each code point.
_COUNTED = (np.isin(_POINTS, np.arange(65, 91)), np.isin(_POINTS, list(b"#$%&*|")), (_POINTS & 0xC0) != 0x80)
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_OWNER_BITS = np.uint64(20)


def _runs(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end; a word ends at each of the edges."""
    word = _WORD[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = word[edges]
    last[edges - 1] = word[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all bytes of the words on end."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def _hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
    before = np.cumsum(lengths) - lengths
    inside = np.arange(int(lengths.sum())) - np.repeat(before, lengths)
    return mix(np.add.reduceat(_LETTER[data[_gathered(starts, lengths)]] * powers[inside], before))


def distinct(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Indices of one word for each different word of each owner (fewer than 2^20 of them).

    Words are sorted by owner and hash and compared with the first of their run; where other bytes have the same hash, the
    owner's words are told apart by their bytes alone."""
    if not len(starts):
        return np.zeros(0, np.int64)
    key = owner.astype(np.uint64) << (np.uint64(64) - _OWNER_BITS) | hashes >> _OWNER_BITS
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    head = order[new][np.cumsum(new) - 1]  # the first word of each one's run
    again = np.flatnonzero(~new)
    mine, other = order[again], head[again]
    same = lengths[mine] == lengths[other]
    mine, other = mine[same], other[same]
    wrong = [owner[order[again]][~same]]
    step = max(1, len(mine) * PASS_BYTES // max(1, int(lengths[mine].sum())))
    for i in range(0, len(mine), step):
        m, o = mine[i : i + step], other[i : i + step]
        equal = data[_gathered(starts[m], lengths[m])] == data[_gathered(starts[o], lengths[o])]
        if not equal.all():
            wrong.append(np.repeat(owner[m], lengths[m])[~equal])
    found, unsure = order[new], np.unique(np.concatenate(wrong))
    if not len(unsure):
        return found
    exact = [found[~np.isin(owner[found], unsure)]]
    for row in unsure:
        words: dict[bytes, int] = {}
        for i in np.flatnonzero(owner == row):
            words.setdefault(data[starts[i] : starts[i] + lengths[i]].tobytes(), i)
        exact.append(np.fromiter(words.values(), np.int64, len(words)))
    return np.concatenate(exact)


def _long_row(data: np.ndarray, piece: int) -> np.ndarray:
    """The counts of one text, read in pieces that end between words; a word longer than a piece is hashed by itself."""
    counts, words, at = np.zeros(3, np.int64), 0, 0
    kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
    while at < len(data):
        stop, whole = min(len(data), at + piece), True
        if stop < len(data) and _WORD[data[stop]]:
            blank = np.flatnonzero(~_WORD[data[at:stop]])
            stop, whole = (at + int(blank[-1]) + 1, True) if len(blank) else (stop, False)
        if not whole:  # one word and no end of it yet
            while stop < len(data):
                blank = np.flatnonzero(~_WORD[data[stop : stop + piece]])
                stop = stop + int(blank[0]) if len(blank) else min(len(data), stop + piece)
                if len(blank):
                    break
            code = hashlib.blake2b(data[at:stop], digest_size=8).digest()
            new = [np.array([at]), np.array([stop - at]), np.frombuffer(code, np.uint64)]
        else:
            starts, ends = _runs(data[at:stop], np.zeros(0, np.int64))
            new = [starts + at, ends - starts, _hashes(data[at:stop], starts, ends - starts)]
        for a in range(at, stop, piece):
            counts += [int(np.count_nonzero(kind[data[a : min(stop, a + piece)]])) for kind in _COUNTED]
        words += len(new[0])
        kept = [np.concatenate(x) for x in zip(kept, new, strict=True)]
        few = distinct(data, *kept, np.zeros(len(kept[0]), np.int64))
        kept, at = [x[few] for x in kept], stop
    return np.r_[words, len(kept[0]), counts]


def text_counts(data: np.ndarray, offsets: np.ndarray, piece: int = PASS_BYTES) -> np.ndarray:
    """For each row its words, distinct words, capitals, symbols and code points."""
    if len(offsets) == 2 and offsets[1] > piece:
        return _long_row(data, piece)[None, :]
    starts, ends = _runs(data, offsets[1:-1])
    lengths, owner = ends - starts, np.searchsorted(offsets, starts, "right") - 1
    few = distinct(data, starts, lengths, _hashes(data, starts, lengths), owner)
    n = len(offsets) - 1
    columns = [np.bincount(owner, minlength=n), np.bincount(owner[few], minlength=n)]
    for kind in _COUNTED:
        sums = np.r_[0, np.cumsum(kind[data], dtype=np.int64)]
        columns.append(sums[offsets[1:]] - sums[offsets[:-1]])
    return np.stack(columns, axis=1)


def failures(counts: np.ndarray) -> np.ndarray:
    """The mask of the filters A to D that a row of counts fails, A in the lowest bit."""
    words, different, capitals, symbols, points = counts.T
    fails = [words < LEAST_WORDS, 100 * different < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * points, symbols > 0]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        data, offsets = byte_view(batch.column("text"))
        raw = memoryview(data)
        digests = [hashlib.sha256(raw[a:b]).digest() for a, b in itertools.pairwise(offsets.tolist())]
        mask = failures(text_counts(data, offsets))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(mask, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])


def masks(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: how many rows of each part fail which filters, by their labels.

    Copies of a text are one row by digest and part before the least doc_id of a text is looked for, so no task gets all of a
    hot text's copies."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    rows = rows.transform(mapped, _scan, "doc_id long, part string, mask int, digest binary").groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    known = labels.select(F.col("doc_id").cast("long").alias("key"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("key is not null")
    known = known.groupBy("key").agg(*[F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("good", "toxic")]).withColumn("named", F.lit(True))
    # rows without doc_id have no label and are spread by their text
    keyed = rows.withColumns({"key": F.coalesce("doc_id", F.xxhash64("digest", "part")), "named": F.col("doc_id").isNotNull()})
    labelled = keyed.join(known, ["key", "named"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    groups = labelled.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("n_low")
    )
    groups = written(groups, "texts")
    lowest = groups.where("low is not null").groupBy("digest").agg(F.min("low").alias("lowest"))
    found = groups.join(lowest, "digest", "left")
    firsts = F.col("nameless") + F.when(F.col("low") == F.col("lowest"), F.col("n_low")).otherwise(0)
    each = F.explode(F.array(F.struct(F.col("mask"), firsts.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - firsts).alias("n"))))
    out = found.select("part", "good", "toxic", each.alias("e")).select("part", "good", "toxic", "e.*").where("n > 0")
    out = written(out.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")), "masks")
    forget(groups)
    return out


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each part.

    The filters fail a text: A of under 200 words, B of fewer distinct words than half of its words, C of more capitals A-Z
    than 3 in 100 code points, D with any of #$%&*|, E that a row of smaller doc_id has too. A part is a value of lang, null
    being the empty string; a null text is empty, and is a copy of other empty texts. Repeated rows count each; those of the
    same doc_id are no copies of each other. A row without doc_id has no label, is no copy and makes no other row one. A
    document is good or toxic if any of its labels says so. Further columns are ignored; no documents give no rows.
    """
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(FILTERS)])
    bits = lambda names: sum((F.when(F.contains(names, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))
    steps = masks(documents, labels).withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.array(*[F.lit(i) for i in range(1, 6)])))
    own, before = F.substring(F.col("filter_order"), F.col("step"), F.lit(1)), F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1)
    steps = steps.withColumns({"own": own, "bit": bits(own), "before": bits(before)})
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    here = fails & ~gone
    count = lambda which, name: F.sum(F.when(which, F.col("n")).otherwise(0)).alias(name)
    out = steps.groupBy("part", "filter_order", "step", "own").agg(
        count(~fails & ~gone, "kept"), count(here, "removed"), count(fails & gone, "redundant"), count(F.col("mask") == F.col("bit"), "unique_fails"),
        count(here & F.col("good"), "good_lost"), count(here & F.col("toxic"), "toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")


def audit_sql() -> str:
    """audit(documents, labels) in DuckDB SQL."""
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, part, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, length(text) AS points, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals,
  regexp_matches(text, '[#$%&*|]') AS symbols, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS copy FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, ((len(words) < {LEAST_WORDS})::INT
  + 2 * (100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words))::INT + 4 * (100 * capitals > {MOST_CAPITALS} * points)::INT + 8 * symbols::INT + 16 * copy::INT) AS mask
  FROM c LEFT JOIN l USING (doc_id)),
g AS (SELECT part, good, toxic, mask, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT chr(65 + i::INT) AS x, (1 << i)::INT AS bit FROM range(5) t(i)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step::INT AS step, f.x AS own, f.bit, coalesce((SELECT sum(h.bit) FROM f h WHERE contains(filter_order[1:step - 1], h.x)), 0)::INT AS before
  FROM o, range(1, 6) t(step), f WHERE f.x = filter_order[step]),
r AS (SELECT part, filter_order, step, own,
  coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0 AND good), 0)::BIGINT AS good_lost,
  coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0 AND toxic), 0)::BIGINT AS toxic_lost FROM g, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""
