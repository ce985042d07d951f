"""Removal of repeated byte strings by two-stage suffix sorting.

A string of LENGTH bytes that starts again later is removed there. Any such string holds, at the same place wherever it
stands, the k-byte gram of least hash, its anchor. So the anchors that occur once in the corpus rule out nearly all
strings; the others go, as segments of the strings that share an anchor, to the task of that anchor. There the suffixes
smaller than their successors are sorted directly, the rest is induced by bucket scans, and adjacent common prefixes of
LENGTH bytes make the groups of equal strings, of which the earliest stays.

Counts of anchors and equal segments combine before they are shuffled. Strings of an anchor that occurs very often are
dealt by their own hash instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massspark.llm.common import binary, byte_view, forget, mapped, mix, slices, written

LENGTH, GRAM = 100, 32
#: An anchor of more places than this has its strings dealt one by one.
HOT = 50_000
#: Bytes that are suffix-sorted at once (whole anchors), and digests of segments that a task remembers.
CHUNK_BYTES, SEEN = 4 << 20, 300_000
#: Text bytes whose anchors are found in one NumPy pass, so that its arrays stay in the cache.
PIECE_BYTES = 1 << 19

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_LOW = np.uint64(0xFFFFFFFF)


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a number in byte order; zeros follow the end."""
    x = np.r_[data, np.zeros(7, np.uint8)].astype(np.uint64)
    x = x[:-1] << np.uint64(8) | x[1:]
    x = x[:-2] << np.uint64(16) | x[2:]
    return x[:-4] << np.uint64(32) | x[4:]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts: all string starts inside rows; owner: the anchor's position for each; hashes of grams by position."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, np.zeros(0, np.uint64)
    w = _words(data)
    m = n - gram + 1
    h = np.zeros(m, np.uint64)
    for i in range(gram // 8):
        h += w[8 * i : 8 * i + m] * _M[i % 4]
        if i % 4 == 3 and i + 1 < gram // 8:
            h = mix(h)
    h = mix(h)
    least = (h >> np.uint64(32)) << np.uint64(32) | np.arange(m, dtype=np.uint64)
    span, size = length - gram + 1, 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    starts = np.repeat(offsets[:-1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return starts, (least[starts] & _LOW).astype(np.int64), h


def _heads(x: np.ndarray) -> np.ndarray:
    """Whether each element differs from the one before it."""
    return np.r_[True, x[1:] != x[:-1]] if len(x) else np.zeros(0, bool)


def _distinct(owner: np.ndarray) -> np.ndarray:
    return owner[_heads(owner)]


def _gram_counts(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE_BYTES):
            _, owner, h = anchors(*byte_view(batch.column("text")), length, gram)
            found, n = np.unique(h[_distinct(owner)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["gram", "n"])

    return run


def _gram_places(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE_BYTES):
            data, offsets = byte_view(batch.column("text"))
            _, owner, h = anchors(data, offsets, length, gram)
            at = _distinct(owner)
            row = np.searchsorted(offsets, at, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), batch.column("id").take(pa.array(row)), pa.array((at - offsets[row]).astype(np.int64))], ["gram", "id", "place"])

    return run


def _candidates(data, offsets, places, length, gram):
    """starts, owner, gram hashes and hot of the strings whose anchor occurs again. places: of each row, negative if hot."""
    starts, owner, h = anchors(data, offsets, length, gram)
    flag = np.zeros(len(data) + 1, np.int8)
    for i, own in enumerate(places):
        if own is not None and len(own):
            own = np.asarray(own, np.int64)
            flag[offsets[i] + np.where(own < 0, -own - 1, own)] = np.where(own < 0, 2, 1)
    good = flag[owner] > 0
    return starts[good], owner[good], h, flag[owner[good]] == 2


def _segments(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # rows come by ascending id, so the first of equal segments is the earliest
        for batch in slices(batches, "text", PIECE_BYTES):
            data, offsets = byte_view(batch.column("text"))
            ids = batch.column("id").to_numpy()
            starts, owner, h, hot = _candidates(data, offsets, batch.column("places").to_pylist(), length, gram)
            new = np.ones(len(starts), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1) | hot[1:]
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(starts)] - 1
            raw, rows = data.tobytes(), ([], [], [], [])
            row_of = np.searchsorted(offsets, starts[first], "right") - 1
            for a, b, row, key, one in zip(starts[first].tolist(), starts[last].tolist(), row_of.tolist(), h[owner[first]].view(np.int64).tolist(), hot[first].tolist(), strict=True):
                segment = raw[a : b + length]
                digest = hashlib.blake2b(segment, digest_size=16).digest()
                if digest in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(digest)
                for x, v in zip(rows, (int.from_bytes(digest[:8], "little", signed=True) if one else key, int(ids[row]), a - int(offsets[row]), segment), strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in rows[:3]), binary(rows[3])], ["gram", "id", "start", "segment"])

    return run


def two_stage_order(text: np.ndarray, length: int, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
    """Positions of text, ordered by the first `length` bytes of their suffixes at least (positions of equal ones adjoin).

    text: uint8, its last character the least of all. starts, ends: the positions asked for, as ranges whose ends are
    inclusive; all without them. What follows a range up to its first suffix smaller than the successor is ordered too,
    as the range is induced from it. Stage one sorts the
    suffixes that are smaller than their successors, eight bytes at a time, going on with ties only. Stage two scans the
    buckets of the first character in ascending order and puts before each found suffix's predecessor, if it is larger,
    behind what its own bucket has of such; a bucket is scanned as one array, runs of one character in waves.
    """
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1].astype(np.int32))
    step[-1] = 1  # nothing follows the last, which comes first of all
    at = np.where(step != 0, np.arange(n), n)
    larger = step[np.minimum.accumulate(at[::-1])[::-1]] < 0  # than its successor
    if starts is None:
        asked = np.ones(n, bool)
    else:
        following = np.where(larger, n - 1, np.arange(n))
        following = np.minimum.accumulate(following[::-1])[::-1]  # the first at or behind each that is sorted directly
        edge = np.zeros(n + 1, np.int8)
        edge[starts] += 1
        edge[following[ends] + 1] -= 1
        asked = np.cumsum(edge[:-1]) > 0
    small = np.flatnonzero(~larger & asked)
    words = np.r_[_words(text), np.zeros(length + 16, np.uint64)]
    order, group = small, np.zeros(len(small), np.int64)
    active = np.arange(len(small))
    for depth in range(0, length, 8):
        key = words[order[active] + depth]
        own = group[active]
        by = np.lexsort((key, own))
        order[active] = order[active][by]
        key, own = key[by], own[by]
        new = np.r_[True, (own[1:] != own[:-1]) | (key[1:] != key[:-1])] if len(own) else np.zeros(0, bool)
        group[active] = active[np.flatnonzero(new)][np.cumsum(new) - 1]
        tied = ~new | ~np.r_[new[1:], True] if len(new) else new
        active = active[tied]
        if not len(active):
            break
    heads = np.bincount(text, minlength=256)
    queues: list[list[np.ndarray]] = [[] for _ in range(len(heads))]
    edges = np.searchsorted(text[order], np.arange(len(heads) + 1))
    out = []

    def induce(positions: np.ndarray) -> np.ndarray:
        before = positions[positions > 0] - 1
        return before[larger[before] & asked[before]]

    def deal(found: np.ndarray) -> None:
        if not len(found):
            return
        c = text[found]
        by = np.argsort(c, kind="stable")
        found, c = found[by], c[by]
        cuts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        for s, e in zip(cuts, [*cuts[1:], len(c)], strict=True):
            queues[c[s]].append(found[s:e])

    for c in np.flatnonzero(heads):
        wave = np.concatenate(queues[c]) if queues[c] else np.zeros(0, np.int64)
        while len(wave):
            out.append(wave)
            before = induce(wave)
            same = text[before] == c
            deal(before[~same])
            wave = before[same]
        direct = order[edges[c] : edges[c + 1]]
        out.append(direct)
        deal(induce(direct))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def first_strings(segments: list[bytes], ids: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of every string of the segments that no earlier one equals."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    edges = np.r_[0, np.cumsum(sizes + 1)]
    text = np.zeros(edges[-1], np.uint8)
    inside = np.ones(edges[-1], bool)
    inside[edges[1:] - 1] = False  # a zero ends each segment; bytes count from one, and UTF-8 has no byte 255
    text[inside] = np.frombuffer(b"".join(segments), np.uint8) + np.uint8(1)
    order = two_stage_order(text, length, edges[:-1], edges[1:] - 1 - length)
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    offset = np.arange(edges[-1]) - edges[owner]
    order = order[offset[order] + length <= sizes[owner[order]]]
    words = _words(text)
    equal = np.zeros(len(order), bool)
    left = np.arange(1, len(order))
    for depth in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:  # adjacent common prefixes of the length
        left = left[words[order[left] + depth] == words[order[left - 1] + depth]]
    equal[left] = True
    heads = np.flatnonzero(~equal)
    documents = np.unique(ids, return_inverse=True)[1]
    when = (documents[owner[order]].astype(np.int64) << 40) + starts[owner[order]] + offset[order]
    earliest = np.minimum.reduceat(when, heads) if len(heads) else when
    kept = order[when == np.repeat(earliest, np.diff(np.r_[heads, len(order)]))]
    kept.sort()
    return owner[kept], offset[kept]


def _earliest(length: int):
    def found(rows):
        rows = pa.Table.from_batches(rows).combine_chunks()
        ids, starts = (rows.column(c).to_numpy() for c in ("id", "start"))
        equal = rows.column("segment").combine_chunks().dictionary_encode()
        codes = equal.indices.to_numpy()
        by = np.lexsort((starts, ids, codes))
        by = by[_heads(codes[by])]  # of equal segments only the earliest has first strings
        ids, starts = ids[by], starts[by]
        segment, offset = first_strings(equal.dictionary.to_pylist(), ids, starts, length)
        place = starts[segment] + offset
        new = np.r_[True, (segment[1:] != segment[:-1]) | (place[1:] != place[:-1] + 1)] if len(place) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(place)] - 1
        return pa.RecordBatch.from_arrays([pa.array(ids[segment[first]]), pa.array(place[first]), pa.array(place[last] + 1)], ["id", "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            heads = np.flatnonzero(_heads(batch.column("gram").to_numpy()))
            if rows and len(heads) and rows[-1].column("gram")[-1] == batch.column("gram")[0]:
                heads = heads[1:]
            if size >= CHUNK_BYTES and len(heads):  # a chunk ends with an anchor
                yield found([*rows, batch.slice(0, heads[0])])
                rows, size, batch = [], 0, batch.slice(heads[0])
            if len(batch):
                rows.append(batch)
                size += pc.sum(pc.binary_length(batch.column("segment"))).as_py()
        if rows:
            yield found(rows)

    return run


_RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def _removed(length: int, gram: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE_BYTES):
            data, offsets = byte_view(batch.column("text"))
            starts = _candidates(data, offsets, batch.column("places").to_pylist(), length, gram)[0]
            cover = np.zeros(len(data) + 1, np.int32)
            later = np.zeros(len(data) + 1, bool)
            later[starts] = True
            for i, kept in enumerate(batch.column("kept").to_pylist()):
                for k in kept or ():
                    later[offsets[i] + k["from"] : offsets[i] + k["to"]] = False
            at = np.flatnonzero(later)
            cover[at] += 1
            cover[at + length] -= 1
            gone = np.cumsum(cover)[:-1] > 0
            rows = []
            for s, e in zip(offsets[:-1], offsets[1:], strict=True):
                own = gone[s:e]
                edge = np.flatnonzero(np.diff(np.r_[0, own.view(np.int8), 0]))
                spans = [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)]
                rows.append((e - s, int(own.sum()), len(spans), hashlib.sha256(data[s:e][~own].tobytes()).hexdigest(), spans))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), pa.array(columns[4], kind)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def repeated_strings(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges removed): one row per input row.

    A byte of a text (UTF-8) goes if some string of `length` bytes over it starts earlier too: in a document of a smaller
    doc_id, or earlier in its own. A null text is empty. Rows of one doc_id are one document and each gets its result; a
    null doc_id counts as the smallest. Extra columns are ignored; an empty table gives an empty result.
    `gram` is a multiple of 8 below `length`.
    """
    least = F.lit(-(1 << 63)).cast("long")
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), least).alias("id"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text"))
    counts = docs.select("text").transform(mapped, _gram_counts(length, gram), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")
    counts = written(counts, "counts")  # so the join's sides are plain shuffles, and Spark can split the partition of a very common anchor
    places = docs.transform(mapped, _gram_places(length, gram), "gram long, id long, place long").join(counts, "gram")
    flags = places.select("id", F.when(F.col("n") > hot, -F.col("place") - 1).otherwise(F.col("place")).alias("place")).groupBy("id").agg(F.collect_list("place").alias("places"))
    flags = written(flags, "flags")
    forget(counts)
    flagged = docs.join(flags.hint("merge"), "id", "left")
    segments = flagged.where("places is not null").sortWithinPartitions("id").transform(mapped, _segments(length, gram), "gram long, id long, start long, segment binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = segments.repartition(parts, "gram").sortWithinPartitions("gram").transform(mapped, _earliest(length), "id long, `from` long, `to` long")
    kept = kept.groupBy("id").agg(F.collect_list(F.struct("from", "to")).alias("kept"))
    out = flagged.join(kept.hint("merge"), "id", "left").select("id", "text", "places", "kept").transform(mapped, _removed(length, gram), _RESULT)
    return out.withColumn("doc_id", F.when(F.col("id") != least, F.col("id"))).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
