"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification and union-find grouping.

A document's set holds the 64-bit hashes of its distinct word shingles. Each element of a set walks through a random
permutation of the signature's slots and offers rank + fraction to one slot per step, so ranks of an element are
correlated and every slot of a long document is filled in the first steps; a document stops as soon as no slot can
get lower. Bands of slots put documents into buckets. Every candidate pair is checked on the full sets.

Documents with equal sets are one class before any link is made. All members of a bucket are compared with one pivot, which
joins most groups. Where a bucket then holds more than one component, its members meet again in buckets of their rarest
shingles (an exact prefix filter), whose members of the smaller components are compared with all of the others, a
bounded number in each round: no pairs of a group are listed, and no link between two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massspark.llm.common import binary, byte_view, forget, mapped, mix, slices, written
from massspark.llm.graph import components

#: 40 bands of 5 slots: a pair at similarity 0.8 shares no bucket with probability (1 - 0.8^5)^40 = 1.2e-7.
BANDS, ROWS = 40, 5
#: Pivots of an undecided bucket that the first round compares with the bucket's other members; each round takes twice as many,
#: so rounds grow with the log of a bucket.
PIVOTS = 512
#: Longs of a parity sketch, of every set and of those that stay undecided.
_SKETCH, _WIDE = [f"p{i}" for i in range(4)], [f"p{i}" for i in range(16)]
#: Values that a hash draws from.
_DRAWS = 1 << 30
_MEMBER = ["key", "node", "size", "common", "place", "sketch", "weight", "comp"]

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_LETTER[65:91] = _LETTER[97:123]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        _powers[size] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size, base, np.uint64)]) for base in (_BASE, _INVERSE))
    return _powers[size]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, and the row it stands in."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = word[edges]
    last[edges - 1] = word[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts]), np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows on end, and where each row's start."""
    words, row = word_hashes(data, offsets)
    n = len(offsets) - 1
    counts = np.bincount(row, minlength=n)
    grams = words.copy()
    for t in range(1, min(k, len(words))):
        grams[: len(words) - t] = grams[: len(words) - t] * _BASE + words[t:]
    full = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts) <= np.repeat(counts, counts) - k
    sets, ends = mix(grams[full]), np.cumsum(np.maximum(counts - k + 1, 0))
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):  # the whole sequence is one shingle
        at = np.cumsum(counts) - counts
        own = np.zeros(len(short), np.uint64)
        for t in range(k - 1):
            has = counts[short] > t
            own[has] = own[has] * _BASE + words[at[short[has]] + t]
        sets = np.insert(sets, ends[short] - 0, mix(own + counts[short].astype(np.uint64)))
        ends = np.cumsum(np.where((counts > 0) & (counts < k), 1, np.maximum(counts - k + 1, 0)))
    starts = np.r_[0, ends[:-1]] if n else ends
    for s, e in zip(starts, ends, strict=True):
        sets[s:e].sort()
    owner = np.repeat(np.arange(n), ends - starts)
    new = np.ones(len(sets), bool)
    new[1:] = (sets[1:] != sets[:-1]) | (owner[1:] != owner[:-1])
    return sets[new], np.r_[0, np.cumsum(np.bincount(owner[new], minlength=n))]


def super_minhash(elements: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """Signatures of m slots as integers: the rank (step) in the top byte, the fraction below it. m is at most 256."""
    n = len(starts) - 1
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(starts))
    top, low, seven = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(8), np.uint64(56)
    signature = np.full((n, m), top, np.uint64)
    flat, x, places = signature.reshape(-1), elements, None
    for step in range(m):
        draw = mix(x + np.uint64((2 * step + 1) * int(_BASE) & 0xFFFFFFFFFFFFFFFF))
        chosen = step + (((draw >> np.uint64(32)) * np.uint64(m - step)) >> np.uint64(32)).astype(np.int64)
        if step == 0:
            slot = chosen
        else:  # swap the chosen place with this step's: a Fisher-Yates shuffle, one step at a time
            rows = np.arange(len(x))
            slot = places[rows, chosen].astype(np.int64)
            places[rows, chosen] = places[rows, step]
            places[rows, step] = slot
        np.minimum.at(flat, owner * m + slot, (np.uint64(step) << seven) | (mix(draw) >> low))
        if step + 1 == m:
            break
        open_rows = signature.max(axis=1) >> seven > step  # a slot may still get lower
        keep = open_rows[owner]
        if not keep.any():
            break
        first = chosen[keep] if step == 0 else None
        x, owner = x[keep], owner[keep]
        if step == 0:
            places = np.tile(np.arange(m, dtype=np.uint8), (len(x), 1))
            rows = np.arange(len(x))
            places[rows, 0] = first
            places[rows, first] = 0
        elif len(keep) > len(x):
            places = places[keep]
    return signature


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _BASE, parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * _BASE + parts[:, :, r])
    return key


def parities(elements: np.ndarray, counts: np.ndarray, longs: int) -> np.ndarray:
    """For each set the parity of how many elements fall on each of 64 * longs bits. Two sets differ in no fewer elements
    than their parities in bits."""
    size, owner = 64 * longs, np.repeat(np.arange(len(counts)), counts)
    bits = np.bincount(owner * size + (mix(elements + np.uint64(3)) & np.uint64(size - 1)).astype(np.int64), minlength=size * len(counts)) & 1
    return np.packbits(bits.astype(np.uint8).reshape(-1, size), axis=1).view(np.int64)


def _sign(k: int, bands: int, rows: int, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, 1 << 20):
            elements, starts = shingle_sets(*byte_view(batch.column(column)), k)
            counts = np.diff(starts)
            some = np.flatnonzero(counts)
            sums = [np.zeros(len(counts), np.uint64) for _ in range(2)]
            if len(some):
                for s, salt in zip(sums, (1, 2), strict=True):
                    s[some] = np.add.reduceat(mix(elements + np.uint64(salt)), starts[some])
            parity = parities(elements, counts, len(_SKETCH))
            keys = band_keys(super_minhash(elements, starts, bands * rows), bands, rows).view(np.int64)
            keys_of = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), *(pa.array(s.view(np.int64)) for s in sums), *(pa.array(np.ascontiguousarray(parity[:, i])) for i in range(4)), keys_of], ["doc_id", "n_shingles", "k1", "k2", *_SKETCH, "keys"])

    return run


_OF_PIVOT = ["size", "common", "place", "comp", "sketch"]
_SIGNED = "doc_id long, n_shingles long, k1 long, k2 long, p0 long, p1 long, p2 long, p3 long, keys array<long>"


def _sets(k: int, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            elements, starts = shingle_sets(*byte_view(batch.column(column)), k)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), binary([elements[s:e].tobytes() for s, e in zip(starts[:-1], starts[1:], strict=True)])], ["node", "elements"])

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "elements"):
        data, starts = byte_view(batch.column("elements"))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(), np.diff(starts) // 8)), pa.array(np.frombuffer(data.tobytes(), np.int64))], ["node", "key"])


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "elements", 1 << 20):
        data, starts = byte_view(batch.column("elements"))
        found = parities(np.frombuffer(data.tobytes(), np.uint64), np.diff(starts) // 8, len(_WIDE))
        yield pa.RecordBatch.from_arrays([batch.column("node"), *(pa.array(np.ascontiguousarray(found[:, i])) for i in range(len(_WIDE)))], ["node", *_WIDE])


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(p) > len(q):
                    p, q = q, p
                if 100 * len(p) < percent * len(q):
                    found.append(False)
                    continue
                at = np.searchsorted(q, p)
                both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                found.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(found, pa.bool_()))

    return run


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets (node, elements) meet the similarity."""
    joined = pairs.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a")
    out = written(joined.select("a", "b", "x", "y").transform(mapped, _verify(percent), "a long, b long"), "verified")
    forget(pairs)
    return out


def _undecided(buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """The buckets whose members are in more than one component, with it as comp."""
    named = buckets.drop("comp").join(groups.select("node", F.col("root").alias("comp")), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # written, so that the join reads both sides as they lie and a hot key's partition can be split
    several = written(named.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key"), "several")
    return named.join(several, "key", "left_semi").select(_MEMBER)


def _joined(groups: DataFrame, found: DataFrame) -> DataFrame:
    """The components (node, root) after further links: these are read as links of roots, and only they are searched anew."""
    if found.isEmpty():
        return groups
    ends = found
    for end in ("a", "b"):
        ends = ends.join(groups.select(F.col("node").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    tops = written(components(ends.where("a <> b"), "a", "b"), "tops")
    moved = groups.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    out = written(moved.unionByName(tops.join(groups, "node", "left_anti")), "groups")
    forget(tops)
    forget(groups)
    return out


def _buckets(keyed: DataFrame, about: DataFrame) -> DataFrame:
    """The members (key, node, what is known about it, weight, comp) of all buckets of two members or more. weight: the members of all buckets of a node;
    a text from which copies were made meets more of them than the copies meet of each other, so it makes the best pivot."""
    spread = keyed.select(F.col("doc_id").alias("node"), F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = written(spread.join(shared, "key"), "buckets")
    weight = buckets.groupBy("node").agg(F.sum("n").alias("weight")).join(about, "node")
    out = written(buckets.select("key", "node").join(weight, "node").withColumns({"comp": F.col("node"), "common": F.col("size"), "place": F.lit(1).cast("long")}), "weighed")
    forget(buckets)
    return out


def _hubs(named: DataFrame) -> DataFrame:
    """One pivot for each bucket, by partial aggregates only."""
    top = named.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"), "size", "common", "place", "comp", "sketch")).alias("top"))
    return top.select("key", (-F.col("top.minus")).alias("pivot"), *[F.col(f"top.{c}").alias(f"pivot_{c}") for c in _OF_PIVOT])


def _strangers(named: DataFrame, most: int) -> DataFrame:
    """About `most` members of each bucket, of its smallest components first: when all but the largest have gone, it is decided.
    A bucket of no more gives all. Components of one size are counted together before anything is ordered, and a bucket of
    n members has at most sqrt(2 n) sizes; of the last size that has room a hash draws as many as fit on average."""
    share = written(named.groupBy("key", "comp").agg(F.count("*").alias("share")), "shares")
    before = Window.partitionBy("key").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    sizes = share.groupBy("key", "share").agg(F.sum("share").alias("members"))
    room = sizes.withColumn("room", most - F.coalesce(F.sum("members").over(before), F.lit(0))).where("room > 0")
    last = written(room.groupBy("key").agg(F.max(F.struct("share", "room", "members")).alias("last")), "last-sizes")
    # both written, so that a hot bucket's partition is one of plain joins, which can be split
    placed = written(named.join(share, ["key", "comp"]), "shared")
    draw = F.pmod(F.xxhash64("key", "node", F.lit(most)), F.lit(_DRAWS)) * F.col("last.members") < F.col("last.room") * _DRAWS
    chosen = placed.join(last, "key").where((F.col("share") < F.col("last.share")) | ((F.col("share") == F.col("last.share")) & draw))
    out = written(chosen.select("key", F.col("node").alias("pivot"), *[F.col(c).alias(f"pivot_{c}") for c in _OF_PIVOT]), "pivots")
    for df in (share, last, placed):
        forget(df)
    return out


def _pairs(named: DataFrame, pivots: DataFrame, percent: int, sketch: list[str]) -> DataFrame:
    """The members of each bucket with its pivots, where exact bounds leave the similarity possible: what both may have in
    common, in all and from the key's place in the order of rarity on (the first key that two sets share must meet it),
    and the differing bits of their parity sketches."""
    whole = F.col("size") + F.col("pivot_size")
    apart = sum((F.bit_count(F.col(f"sketch.{p}").bitwiseXOR(F.col(f"pivot_sketch.{p}"))) for p in sketch), F.lit(0))
    most = F.least("common", "pivot_common", F.col("size") - F.col("place") + 1, F.col("pivot_size") - F.col("pivot_place") + 1)
    close = ((100 + percent) * most >= percent * whole) & ((100 + percent) * apart <= (100 - percent) * whole)
    pairs = named.join(pivots, "key").where(close & F.expr("comp <> pivot_comp"))
    return written(pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), "pairs")


def _prefixes(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Buckets of what is undecided by the rarest shingles, an exact filter: two sets of a similarity of p percent or more
    share one of each set's n - ceil(p n / 100) + 1 rarest elements. Texts that have but a long passage in common, with
    a fifth or more of their own, thus meet nowhere. common: the elements that another undecided text has too."""
    nodes = rest.select("node", "size").distinct()
    wide = sets.join(nodes.select("node"), "node", "left_semi").transform(mapped, _parities, "node long, " + ", ".join(f"{p} long" for p in _WIDE))
    nodes = nodes.join(wide.select("node", F.struct(*_WIDE).alias("sketch")), "node")
    spread = written(sets.join(rest.select("node").distinct(), "node", "left_semi").transform(mapped, _spread, "node long, key long"), "elements")
    shared = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    common = spread.join(shared, "key")
    order = Window.partitionBy("node").orderBy("n", "key")
    placed = common.withColumn("place", F.row_number().over(order)).withColumn("common", F.count("*").over(Window.partitionBy("node"))).join(nodes, "node")
    length = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    placed = placed.withColumn("place", F.col("place") + F.col("size") - F.col("common"))
    out = placed.where(F.col("place") <= length).select("key", "node", "size", "common", F.col("place").cast("long").alias("place"), "sketch", F.lit(0).cast("long").alias("weight"))
    out = written(out, "prefixes")
    forget(spread)
    return out


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Links two documents when 100 * |A & B| >= percent * |A | B| for their sets of distinct k-word shingles (one shingle
    when a text has fewer words). Null or blank texts have an empty set, link with nothing and are their own component.
    Rows with one doc_id are one node of the graph: give them distinct ids. A row without doc_id is returned with its
    count, a null component and a null kept. Other columns are ignored; an empty table gives an empty result.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("string").alias(column))
    signed = written(docs.transform(mapped, _sign(k, bands, rows, column), _SIGNED), "signed")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    # written, so that a class of very many copies is a skewed join that can be split
    classes = written(some.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    members = written(some.select("doc_id", "k1", "k2", "n_shingles").join(classes, ["k1", "k2", "n_shingles"]).select("doc_id", "rep"), "members")
    forget(classes)
    copies = members.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    reps = members.where("doc_id = rep").select("doc_id").distinct()
    reps = signed.join(reps, "doc_id", "left_semi")
    about = reps.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("size"), F.struct(*_SKETCH).alias("sketch"))
    named = _buckets(reps.select("doc_id", "keys"), about)
    nodes = named.select(F.col("node").alias("doc_id")).distinct()
    # the one shuffle of texts; merged at every size, as what is in buckets grows with the input
    sets = docs.join(nodes.hint("merge"), "doc_id", "left_semi").transform(mapped, _sets(k, column), "node long, elements binary")
    sets = written(sets, "sets")
    pivots = written(_hubs(named), "pivots")
    links = linked(_pairs(named, pivots, percent, _SKETCH), sets, percent)
    groups = components(links.unionByName(copies), "a", "b")
    forget(pivots)
    rest = written(_undecided(named, groups), "undecided")
    forget(named)
    if not rest.isEmpty():
        prefixes = _prefixes(rest, sets, percent)
        forget(rest)
        rest = written(_undecided(prefixes, groups), "undecided")
        forget(prefixes)
    most, groups = PIVOTS, written(groups, "groups")
    while not rest.isEmpty():
        pivots, most = _strangers(rest, most), 2 * most
        found = linked(_pairs(rest, pivots, percent, _WIDE), sets, percent)
        groups = _joined(groups, found)
        following = written(_undecided(rest.drop("comp").join(pivots.select("key", F.col("pivot").alias("node")), ["key", "node"], "left_anti"), groups), "undecided")
        for df in (pivots, found, rest):
            forget(df)
        rest = following
    forget(rest)
    result = signed.select("doc_id", "n_shingles").join(groups.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
    component = F.coalesce("root", "doc_id")
    return result.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
