"""Benchmark decontamination: q-gram lemma filter over diagonal bands, then banded alignment.

Texts and items are compared as lower-cased bytes with every run of blanks and punctuation as one blank. An item is searched
by its windows from every byte on, so a leak of WINDOW compared bytes, wherever it was cut, holds a whole one; what is shorter than a window is found only where it is the whole item. A window of w bytes with at most e
edits shares w + 1 - q - q e q-grams with its match, all on diagonals at most e apart: hits are counted in bands two steps
wide, a step (at least e) apart, and only bands that reach the bound are aligned.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massspark.llm.common import byte_view, forget, mapped, slices, written

#: Bytes of a q-gram and of a window, and edits allowed as a share of a window.
Q, WINDOW, EDITS = 8, 100, 0.08
#: Windows that are aligned at once.
ALIGNED = 1 << 13
#: Pairs of a text's and an item's q-gram that are counted at once. A text with more is taken in stretches, and stretches of equal
#: bytes once; a stretch is a multiple of the bands' step and of most short periods.
HITS, STRETCH, MARGIN = 1 << 20, 5040, 64
#: Zeros between texts: more than a window's edits, so that nothing matches across.
GAP = 16
#: Items of so many bytes are searched in one pass over the documents; more take more passes. An index takes some 60 times this.
BLOCK_BYTES = 1 << 20

_FOLD = np.full(256, 32, np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum():
        _FOLD[_c] = ord(chr(_c).lower()) if _c < 128 else _c
_FACTOR, _BITS = np.uint64(0x9E3779B97F4A7C15), 22
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compared bytes with GAP zeros after each row, where each row's start, and where each byte came from."""
    x = _FOLD[data]
    blank = x == 32
    keep = np.ones(len(x), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    first = offsets[:-1][np.diff(offsets) > 0]
    keep[first] = ~blank[first]
    at = np.flatnonzero(keep)
    edges = np.searchsorted(at, offsets)
    rows = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    out, source = np.zeros(len(at) + GAP * (len(edges) - 1), np.uint8), np.zeros(len(at) + GAP * (len(edges) - 1), np.int64)
    to = np.arange(len(at)) + GAP * rows
    out[to], source[to] = x[at], at
    return out, edges + GAP * np.arange(len(edges)), source


def compared(text: str | None) -> np.ndarray:
    """An item's compared bytes."""
    raw = np.frombuffer((text or "").encode("utf-8"), np.uint8)
    x = folded(raw, np.array([0, len(raw)]))[0][:-GAP]
    return x[: len(x) - 1] if len(x) and x[-1] == 32 else x


def qgrams(x: np.ndarray, q: int = Q) -> np.ndarray:
    """The q bytes (8 at most) from each position on as a number; the last q - 1 positions have none."""
    if len(x) < q:
        return np.zeros(0, np.uint64)
    out, size = x.astype(np.uint64), 1
    while 2 * size <= q:
        out = out[:-size] | out[size:] << np.uint64(8 * size)
        size *= 2
    if size < q:  # the last bytes overlap those before
        rest = q - size
        out = out[:-rest] | out[rest:] << np.uint64(8 * rest)
    return out


_WIDTH, _MIDDLE = 1 << 36, 1 << 35


def _runs(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1 and so on, so many of each."""
    return np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class Windows:
    """The index of a block of items. Windows of equal bytes, of whatever items, are one class, which its first window stands for;
    only q-grams of first windows are stored, so an item of one repeated unit has no more of them than a unit and a window."""

    def __init__(self, items: list[tuple[int, str | None]], q: int = Q, window: int = WINDOW, edits: float = EDITS):
        if int(window * edits) >= GAP:
            raise ValueError("a window's edit budget must be below GAP")
        self.q, self.window, self.step = q, window, max(8, int(window * edits))
        self.items, texts, codes = [], [], []
        for item, text in items:
            x = compared(text)
            if len(x) < q:  # no q-gram, so nothing to search by
                continue
            self.items.append(item)
            texts.append(x)
            codes.append(qgrams(x, q))
        lengths = np.array([len(t) for t in texts], np.int64)
        self.text, self.text_at = np.concatenate([*texts, np.zeros(0, np.uint8)]), np.cumsum(lengths) - lengths
        # by item: the size, edits and q-gram bound of its windows, where the last starts, and the first one's number
        self.sizes = np.minimum(lengths, window)
        self.budgets = np.minimum((self.sizes * edits).astype(np.int64), (self.sizes - q) // q)
        self.bounds = self.sizes + 1 - q - q * self.budgets
        self.last = lengths - self.sizes
        self.n = self.last + 1
        self.base = np.cumsum(self.n) - self.n
        twin = self._twins()
        self.first_of_class = twin == np.arange(len(twin))
        # by class: the items that have it, and how many windows of each
        owners = np.repeat(np.arange(len(texts)), self.n)
        pairs, self.class_n = np.unique(twin * max(1, len(texts)) + owners, return_counts=True)
        self.class_of, self.class_item = pairs // max(1, len(texts)), pairs % max(1, len(texts))
        owner = np.repeat(np.arange(len(texts)), lengths - q + 1)
        places = np.concatenate([*(np.arange(len(c)) for c in codes), np.zeros(0, np.int64)])
        codes = np.concatenate([*codes, np.zeros(0, np.uint64)])
        self.first_code = codes[np.flatnonzero(places <= self.last[owner])] if len(codes) else codes  # of each window
        firsts = np.flatnonzero(self.first_of_class)
        item, start = self.item_of(firsts)
        begin = start + (np.cumsum(lengths - q + 1) - (lengths - q + 1))[item] if len(firsts) else firsts
        cover = np.zeros(len(codes) + 1, np.int64)
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + self.sizes[item] - q + 1, -1)
        kept = np.cumsum(cover[:-1]) > 0
        codes, owner, places = codes[kept], owner[kept], places[kept]
        order = np.argsort(codes, kind="stable")
        self.owner, self.place = owner[order].astype(np.int32), places[order].astype(np.int32)
        self.codes, first = np.unique(codes[order], return_index=True)
        self.first, self.count = first.astype(np.int32), np.diff(np.r_[first, len(order)]).astype(np.int32)
        self.table = np.zeros(1 << _BITS, bool)
        self.table[self._slots(self.codes)] = True

    def _twins(self) -> np.ndarray:
        """For each window the first one of the same bytes: what they are aligned as."""
        window = np.arange(int(self.n.sum()))
        if not len(window):
            return window
        item, start = self.item_of(window)
        size, at = self.sizes[item], self.text_at[item] + start
        power, inverse = (np.cumprod(np.r_[np.uint64(1), np.full(len(self.text), x, np.uint64)]) for x in (_FACTOR, _INVERSE))
        sums = np.r_[np.uint64(0), np.cumsum((self.text.astype(np.uint64) + np.uint64(1)) * power[1:])]
        key = (sums[at + size] - sums[at]) * inverse[at] + size.astype(np.uint64)
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        twin = first[back]
        for part in np.array_split(np.flatnonzero((twin != window) & (size == size[twin])), max(1, len(window) >> 14)):
            reach = np.arange(int(size[part].max(initial=0)))
            mine, other = (self.text[np.minimum(x[:, None] + reach, len(self.text) - 1)] for x in (at[part], at[twin[part]]))
            window[part[((mine == other) | (reach >= size[part][:, None])).all(axis=1)]] = -1  # equal hashes of other bytes stay apart
        return np.where(window < 0, twin, np.arange(len(window)))

    def item_of(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items of windows, and where in them the windows start."""
        item = np.searchsorted(self.base, window, "right") - 1
        return item, window - self.base[item]

    @staticmethod
    def _slots(codes: np.ndarray) -> np.ndarray:
        return (codes * _FACTOR) >> np.uint64(64 - _BITS)

    def _hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of x whose q-gram an item has, near enough to others to be a match, and the q-gram's number."""
        grams = qgrams(x, self.q)
        hit = self.table[self._slots(grams)]
        # a match has its q-grams inside a stretch of a window and its edits
        sums = np.r_[0, np.cumsum(hit, dtype=np.int32)]
        span, least = int((self.sizes + self.budgets).max()), int(self.bounds.min())
        full = sums[np.minimum(np.arange(len(grams)) + span, len(grams))] - sums[:-1] >= least
        near = np.zeros(len(grams) + 1, np.int32)
        starts = np.flatnonzero(full)
        np.add.at(near, starts, 1)
        np.add.at(near, np.minimum(starts + span, len(grams)), -1)
        at = np.flatnonzero(hit & (np.cumsum(near[:-1]) > 0))
        slot = np.searchsorted(self.codes, grams[at])
        known = self.codes[np.minimum(slot, len(self.codes) - 1)] == grams[at]
        return at[known], slot[known]

    def bands(self, at: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, band) of those hits that reach the bound, first windows of their classes only; band b spans the diagonals
        [b step, (b + 2) step).

        Hits are sorted by item, band and place, so what a window holds is a difference of two places in that order: no hit is
        listed for every window that it is in.
        """
        counts = self.count[slot]
        index = _runs(self.first[slot].astype(np.int64), counts)
        item, place, at = self.owner[index].astype(np.int64), self.place[index].astype(np.int64), np.repeat(at, counts)
        band = (at - place) // self.step + _MIDDLE
        # a match of a window is in a band of its item as well: what reaches no bound there is in no window that does
        key = item * _WIDTH + band
        groups, inverse, n = np.unique(np.concatenate([key, key - 1]), return_inverse=True, return_counts=True)
        good = n >= self.bounds[groups // _WIDTH]
        kept = good[inverse]
        if not kept.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        number = np.cumsum(good) - 1
        groups, group, place = groups[good], number[inverse[kept]], np.concatenate([place, place])[kept]
        wide = int(self.last.max()) + self.window + 1
        order = np.sort(group * wide + place)
        own = np.unique(order)
        group, place = own // wide, own % wide
        item = groups[group] // _WIDTH
        low, high = np.maximum(place + self.q - self.sizes[item], 0), np.minimum(place, self.last[item])
        low[1:] = np.where(group[1:] == group[:-1], np.maximum(low[1:], high[:-1] + 1), low[1:])  # windows that no earlier hit has listed
        counts = np.maximum(high - low + 1, 0)
        start, group = _runs(low, counts), np.repeat(group, counts)
        item = groups[group] // _WIDTH
        first = self.first_of_class[self.base[item] + start]
        start, group, item = start[first], group[first], item[first]
        held = np.searchsorted(order, group * wide + start + self.sizes[item] - self.q, "right") - np.searchsorted(order, group * wide + start, "left")
        good = held >= self.bounds[item]
        return self.base[item[good]] + start[good], groups[group[good]] % _WIDTH - _MIDDLE

    def _exact(self, x: np.ndarray, window: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Where in x each (window, band) ends that stands there byte for byte, the first place of the band; -1 if there is none."""
        item, start = self.item_of(window)
        size, ends = self.sizes[item], np.full(len(window), -1)
        grams = qgrams(x, self.q)
        for lane in range(2 * self.step):
            to = start + band * self.step + lane
            some = np.flatnonzero((ends < 0) & (to >= 0) & (to + size <= len(x)))
            some = some[grams[to[some]] == self.first_code[window[some]]]
            for part in np.array_split(some, max(1, len(some) // ALIGNED)):
                reach = np.arange(int(size[part].max(initial=0)))
                mine = x[np.minimum(to[part][:, None] + reach, len(x) - 1)]
                equal = mine == self.text[np.minimum((self.text_at[item[part]] + start[part])[:, None] + reach, len(self.text) - 1)]
                same = (equal | (reach >= size[part][:, None])).all(axis=1)
                ends[part[same]] = (to + size)[part[same]]
        return ends

    def aligned(self, x: np.ndarray, window: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least edits of each (window, band) on its diagonals and those an edit budget around, and where in x it ends."""
        if not len(window):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        item, start = self.item_of(window)
        sizes = self.sizes[item]
        slack = int(self.budgets[item].max())
        width, rows = 2 * self.step + 2 * slack, int(sizes.max())
        left = start + band * self.step - slack
        padded = np.concatenate([np.zeros(rows + width + abs(int(min(0, left.min()))), np.uint8), x, np.zeros(rows + 2 * width, np.uint8)])
        shift = len(padded) - len(x) - (rows + 2 * width)
        places = np.arange(rows)
        source = np.minimum((self.text_at[item] + start)[:, None] + places, len(self.text) - 1)
        pattern = np.where(places < sizes[:, None], self.text[source], np.uint8(255))
        lanes = np.arange(width)
        costs, best, ends = np.zeros((len(window), width), np.int64), np.zeros(len(window), np.int64), np.zeros(len(window), np.int64)
        for i in range(rows):
            text = padded[left[:, None] + lanes + i + shift]
            turned = costs + (text != pattern[:, i : i + 1])
            turned[:, :-1] = np.minimum(turned[:, :-1], costs[:, 1:] + 1)
            costs = np.minimum.accumulate(turned - lanes, axis=1) + lanes
            done = np.flatnonzero(sizes == i + 1)
            if len(done):
                lane = costs[done].argmin(axis=1)
                best[done], ends[done] = costs[done, lane], left[done] + lane + i + 1
        return best, ends

    def _whole_words(self, x: np.ndarray, item: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether an item shorter than a window stands between word edges, give or take its edits; True for all others."""
        good, padded = np.ones(len(item), bool), np.r_[np.zeros(GAP, np.uint8), x, np.zeros(2 * GAP, np.uint8)]
        edge = (padded == 32) | (padded == 0)
        for k in np.flatnonzero(self.last[item] == 0):
            if self.sizes[item[k]] < self.window:
                b, e, n = int(self.budgets[item[k]]), int(end[k]) + GAP, int(self.sizes[item[k]])
                good[k] = edge[e - b : e + b + 1].any() and edge[max(0, e - n - 1 - b) : e - n + b].any()
        return good

    def _found(self, x: np.ndarray, at: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Rows of (window, edits, start, end) that those hits lead to; start is the earliest that the edits allow."""
        window, band = self.bands(at, slot)
        item = self.item_of(window)[0]
        end = self._exact(x, window, band)
        best = np.where(end >= 0, 0, np.int64(1) << 40)
        rest = np.flatnonzero(end < 0)
        for part in (rest[i : i + ALIGNED] for i in range(0, len(rest), ALIGNED)):
            best[part], end[part] = self.aligned(x, window[part], band[part])
        good = np.flatnonzero(best <= self.budgets[item])
        good = good[self._whole_words(x, item[good], end[good])]
        return np.stack([window[good], best[good], end[good] - best[good] - self.sizes[item[good]], end[good]], axis=1)

    def found(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Rows of (window, edits, start, end), stretch by stretch of x; one may come twice where stretches meet."""
        if not len(self.items) or len(x) < self.q:
            return
        at, slot = self._hits(x)
        sums = np.r_[0, np.cumsum(self.count[slot], dtype=np.int64)]
        if sums[-1] <= HITS:
            if len(at):
                yield self._found(x, at, slot)
            return
        reach = int(self.sizes.max()) + 2 * self.step  # what the hits of one window and band span
        known: dict[bytes, np.ndarray] = {}
        work = [(a, a + STRETCH) for a in range(0, len(x), STRETCH)][::-1]
        while work:
            a, b = work.pop()
            i, j = np.searchsorted(at, [a, b + reach])
            if sums[j] - sums[i] > HITS and b - a > MARGIN:
                middle = a + (b - a) // 2 // self.step * self.step
                work += [(middle, b), (a, middle)]
                continue
            if i == j:
                continue
            whole = MARGIN <= a and b + reach + 2 * MARGIN <= len(x)
            mark = hashlib.blake2b(x[max(0, a - MARGIN) : b + reach + 2 * MARGIN], digest_size=16).digest() + bytes([a % self.step]) if whole else None
            rows = known.get(mark)
            if rows is None:
                rows = self._found(x, at[i:j], slot[i:j]) - [0, 0, a, a]
                if whole:
                    known[mark] = rows
            yield rows + [0, 0, a, a]

    def by_item(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows of found(): which row, an item that has its window, and how many windows of the item are equal to it."""
        low, high = np.searchsorted(self.class_of, rows[:, 0], "left"), np.searchsorted(self.class_of, rows[:, 0], "right")
        at = _runs(low, high - low)
        return np.repeat(np.arange(len(rows)), high - low), self.class_item[at], self.class_n[at]

    def search(self, x: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, edits, start, end) of every window found in x, one for each item that has it."""
        out = set()
        for rows in self.found(x):
            which, item, _ = self.by_item(rows)
            out |= {(self.items[k], *map(int, rows[r, 1:])) for r, k in zip(which, item, strict=True)}
        return sorted(out, key=lambda h: (h[0] is not None, h))


_FOUND = "doc_id long, item_id long, edits long, n_windows long, start long, end long"


@functools.lru_cache(maxsize=1)
def _index(items: tuple[tuple[int, str], ...], q: int, window: int, edits: float) -> Windows:
    """One for all tasks of a worker."""
    return Windows(list(items), q, window, edits)


def _regions(index: Windows, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(row, item, edits, windows, start, end) for each row and item found in the rows' compared bytes, edges inside the row."""
    parts = []
    for found in index.found(x):
        row = np.searchsorted(starts, found[:, 3] - 1, "right") - 1
        which, item, n = index.by_item(found)
        f = found[which]
        table = np.stack([row[which], item, f[:, 1], f[:, 0], n, np.maximum(f[:, 2], starts[row[which]]), np.minimum(f[:, 3], starts[row[which] + 1] - GAP)], axis=1)
        # a window found in two bands or stretches counts once
        table = table[np.lexsort((table[:, 2], table[:, 3], table[:, 1], table[:, 0]))]
        parts.append(table)
        if sum(map(len, parts)) > 1 << 18:
            parts = [_merged(np.concatenate(parts))]
    if not parts:
        return np.zeros((0, 6), np.int64)
    table = _merged(np.concatenate(parts))
    first = np.flatnonzero(np.r_[True, (np.diff(table[:, :2], axis=0) != 0).any(axis=1)]) if len(table) else np.zeros(0, int)
    if not len(first):
        return np.zeros((0, 6), np.int64)
    return np.stack([table[first, 0], table[first, 1], np.minimum.reduceat(table[:, 2], first), np.add.reduceat(table[:, 4], first), np.minimum.reduceat(table[:, 5], first), np.maximum.reduceat(table[:, 6], first)], axis=1)


def _merged(table: np.ndarray) -> np.ndarray:
    """One line for each row, item and window: the fewest edits, and from the first to the last place."""
    table = table[np.lexsort((table[:, 3], table[:, 1], table[:, 0]))]
    if not len(table):
        return table
    first = np.flatnonzero(np.r_[True, (np.diff(table[:, [0, 1, 3]], axis=0) != 0).any(axis=1)])
    out = table[first]
    out[:, 2], out[:, 5], out[:, 6] = np.minimum.reduceat(table[:, 2], first), np.minimum.reduceat(table[:, 5], first), np.maximum.reduceat(table[:, 6], first)
    return out


def _search(*how):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(*how)
        for batch in slices(batches, "text", 1 << 20):
            data, offsets = byte_view(batch.column("text"))
            x, starts, source = folded(data, offsets)
            rows, ids = [], batch.column("doc_id").to_pylist()
            regions: dict[tuple, list[int]] = {}
            for row, item, edits, n, start, end in _regions(index, x, starts).tolist():
                own = regions.setdefault((row, index.items[item]), [edits, 0, start, end])
                own[:] = min(own[0], edits), own[1] + n, min(own[2], start), max(own[3], end)
            points, of = None, None
            for (row, item), (edits, n, start, end) in sorted(regions.items(), key=lambda x: (x[0][0], x[0][1] is not None, x[0][1] or 0)):
                if row != of:
                    points, of = np.r_[0, np.cumsum((data[offsets[row] : offsets[row + 1]] & 0xC0) != 0x80)], row
                first, last = (source[p] - offsets[row] for p in (start, end - 1))
                rows.append((ids[row], item, edits, n, int(points[first]), int(points[last + 1])))
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in _FOUND.split(", ")])

    return run


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, text, digest of the compared bytes (null if there are none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("compared", pa.array([compared(t).tobytes() or None for t in batch.column("text").to_pylist()], pa.binary()))

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.transform(mapped, run, "item_id long, text string, compared binary").select("item_id", "text", F.sha2("compared", 256).alias("digest"))


def item_classes(benchmark: DataFrame) -> DataFrame:
    """item_id, class_id: each item with the smallest id of the items whose compared bytes equal its own.

    An item without compared bytes is in no class (null); so is one of a class without an id."""
    items = _items(benchmark).drop("text")
    return items.join(items.where("digest is not null").groupBy("digest").agg(F.min("item_id").alias("class_id")), "digest", "left").select("item_id", "class_id")


def _blocks(benchmark: DataFrame) -> Iterator[tuple[tuple[int, str], ...]]:
    """One item of each class, in blocks of bounded size: all that is in the driver at a time."""
    classes = _items(benchmark).where("digest is not null").groupBy("digest").agg(F.min("item_id").alias("item_id"), F.min("text").alias("text"))
    classes = written(classes, "items")
    size = classes.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    for i in range(blocks):
        own = classes.where(F.pmod(F.xxhash64("digest"), F.lit(blocks)) == i).orderBy("item_id", "digest").collect()
        yield tuple((r["item_id"], r["text"]) for r in own)
    forget(classes)


def contaminated(documents: DataFrame, benchmark: DataFrame, q: int = Q, window: int = WINDOW, edits: float = EDITS, column: str = "text") -> DataFrame:
    """doc_id, item_id, edits, n_windows, start, end: the documents that hold a part of a benchmark item, a row for each item.

    A part is a window of the item within the edit budget, or the whole of a shorter item between word edges. Items of the
    same compared bytes are searched as one: item_id is the smallest of theirs, item_classes() has the others. edits: of the
    best window; n_windows: the item's windows that were found; start and end: the code points over which they lie. Null or empty texts hold
    nothing; null or empty items and those of fewer than q compared bytes are held by nothing; a null doc_id or item_id is
    reported as it is. Repeated documents are reported each. Extra columns are ignored; an empty table gives an empty
    result.

    The items are the query set: they are read in blocks of bounded size, each one pass over the documents, which stay
    where they are. Documents are not shuffled. With more than one block, each pass is run and written before the next.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("string").alias("text"))
    blocks = _blocks(benchmark)
    out = docs.transform(mapped, _search(next(blocks), q, window, edits), _FOUND)
    for k, items in enumerate(blocks):
        out = out if k else written(out, "found")
        out = out.unionByName(written(docs.transform(mapped, _search(items, q, window, edits), _FOUND), "found"))
    return out


def clean(documents: DataFrame, benchmark: DataFrame, q: int = Q, window: int = WINDOW, edits: float = EDITS) -> DataFrame:
    """The rows, with all their columns, whose text holds no part of a benchmark item (nulls and texts as contaminated()).

    Items of one block filter the rows where they are. With more, the digests of the texts that a pass finds are written,
    and rows of such texts are left out at the end."""

    def held(batches: Iterator[pa.RecordBatch], how: tuple) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        index = _index(*how)
        for batch in slices(batches, "text", 1 << 20):
            x, starts, _ = folded(*byte_view(batch.column("text")))
            hit = np.zeros(len(batch), bool)
            for rows in index.found(x):
                hit[np.searchsorted(starts, rows[:, 3] - 1, "right") - 1] = True
                if hit.all():
                    break
            yield batch, hit

    def without(*how):
        return lambda batches: (batch.filter(pa.array(~hit)) for batch, hit in held(batches, how))

    def within(*how):
        return lambda batches: (batch.filter(pa.array(hit)) for batch, hit in held(batches, how))

    blocks = _blocks(benchmark)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return documents.transform(mapped, without(first, q, window, edits), documents.schema)
    texts, gone = documents.select("text"), None
    for items in itertools.chain((first, second), blocks):
        found = written(texts.transform(mapped, within(items, q, window, edits), texts.schema).select(F.sha2("text", 256).alias("digest")), "held")
        gone = found if gone is None else gone.unionByName(found)
    return documents.join(gone.distinct(), F.sha2("text", 256).eqNullSafe(F.col("digest")), "left_anti")
