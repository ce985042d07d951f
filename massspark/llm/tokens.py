"""Token ids as a binary output: ids ranked by frequency, byte-aligned variable-length coding, control bytes apart.

A block holds whole documents: magic, the number of documents, which of them have an id, their ids, token counts, the size
of the control bytes, then all control bytes (four 2-bit lengths each), then all data bytes (1 to 4 for each rank, low byte
first). Blocks lie in a Parquet table as binary values, in ascending order of doc_id, so Spark's committer writes them on
any store.
"""

from __future__ import annotations

import functools
import json
import os
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from massspark.llm.common import byte_view, forget, mapped, runs, slices, written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END = 2
_MAGIC = b"MTB2"
#: Data of a block before it is closed, and words of which a worker keeps the ids.
BLOCK_BYTES, KEPT_WORDS = 1 << 20, 500_000
#: Words that the tokenizer gets as one string, and strings of one call.
JOINED, CALL = 64, 64
_LENGTHS = np.stack([(np.arange(256) >> s & 3) + 1 for s in (0, 2, 4, 6)], axis=1).astype(np.uint8)
#: Bytes that start no white space (of Unicode, too): a blank before one of them starts a word.
_SOLID = np.ones(256, bool)
_SOLID[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = False
#: ASCII letters, digits and other signs; the apostrophe and what else may go with both sides have none.
_CLASS = np.zeros(256, np.uint8)
for _of, _signs in enumerate((string.ascii_letters, string.digits, string.punctuation.replace("'", "")), 1):
    _CLASS[[ord(c) for c in _signs]] = _of


class Encoder:
    """Ids of whole texts. A byte-level tokenizer's own pattern cuts at a blank before a word, whatever stands beside, so
    texts are cut there, and where ASCII letters, digits and signs meet, which the pattern never keeps together. Each distinct
    word goes through the tokenizer once; other tokenizers get the texts as they are.
    Texts that hold a special token's string are never cut."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker on each core
        self.tokenizer = Tokenizer.from_file(path)
        how = json.loads(self.tokenizer.to_str())
        self.cuts = (how.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not how.get("normalizer") and not how["pre_tokenizer"].get("add_prefix_space")
        self.classes = self.cuts and how["pre_tokenizer"].get("use_regex", True)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # a blank's stand-in in byte-level vocabularies
        self.opens[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.large_binary())
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _call(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for i in range(0, len(texts), CALL) for e in self.tokenizer.encode_batch_fast(texts[i : i + CALL], add_special_tokens=False)]

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Add words to those known, and say where they are. Words with one blank, at the start, go to the tokenizer in joined
        strings, where its stand-in tells them apart."""
        data, offsets = byte_view(new)
        blanks = np.r_[0, np.cumsum(data == 32)][offsets]
        single = np.diff(blanks) == 1
        single[single] = data[offsets[:-1][single]] == 32
        together = np.flatnonzero(single)
        data, offsets = byte_view(new.take(pa.array(together)))
        edges = np.r_[np.arange(0, len(together), JOINED), len(together)]
        found = self._call([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[edges[:-1]], offsets[edges[1:]], strict=True)])
        starts = [np.flatnonzero(self.opens[x]) for x in found]
        good = np.array([len(x) == n and x[0] == 0 for x, n in zip(starts, np.diff(edges), strict=True)], bool)
        lost = np.flatnonzero(~good)
        alone = np.r_[np.flatnonzero(~single), *(together[edges[i] : edges[i + 1]] for i in lost)].astype(np.int64)
        rest = self._call([w.decode("utf-8", "replace") for w in new.take(pa.array(alone)).to_pylist()])
        sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(np.r_[s, len(x)]) for x, s, ok in zip(found, starts, good, strict=True) if ok), np.array([len(x) for x in rest], np.int64)])
        order = np.r_[together[np.repeat(good, np.diff(edges))], alone]
        where = np.empty(len(new), np.int64)
        where[order] = len(self.words) + np.arange(len(order))
        self.words = pa.concat_arrays([self.words, new.take(pa.array(order))])
        self.start = np.r_[self.start, len(self.ids) + np.cumsum(sizes) - sizes]
        self.size = np.r_[self.size, sizes]
        self.ids = np.concatenate([self.ids, *(x for x, ok in zip(found, good, strict=True) if ok), *rest])
        return where

    def encode(self, column: pa.Array, tail: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column on end, and where each row's start (one more for the end); tail ends each row."""
        data, offsets = byte_view(column)
        rows = len(offsets) - 1
        first = np.zeros(len(data) + 1, bool)
        if self.cuts and len(data):
            first[:-2] = (data[:-1] == 32) & _SOLID[data[1:]]
            first[offsets[1:] - 1] = False  # a text's last byte, whatever the next text starts with
            kind = _CLASS[data]
            first[1:-1] |= self.classes & (kind[:-1] != kind[1:]) & (kind[:-1] > 0) & (kind[1:] > 0)
            for special in self.specials:
                for row in np.flatnonzero(pc.fill_null(pc.match_substring(column, special), False).to_numpy(zero_copy_only=False)):
                    first[offsets[row] : offsets[row + 1]] = False
        first[offsets[:-1]] = True
        first[-1] = False
        at = np.flatnonzero(first)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.r_[at, len(data)].astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        if len(self.words) > KEPT_WORDS:
            self._forget()
        known = pc.index_in(pieces.dictionary, value_set=self.words)
        place = pc.fill_null(known, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        place[place < 0] = self._learn(pieces.dictionary.filter(known.is_null()))
        word = place[pieces.indices.to_numpy()]
        sizes = self.size[word]
        ids = self.ids[runs(self.start[word], sizes)]
        ends = np.r_[0, np.cumsum(sizes)][np.searchsorted(at, offsets)]
        if tail is None:
            return ids, ends
        return np.insert(ids, ends[1:], tail), ends + np.arange(rows + 1)


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def _rows(flat: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The items from one edge to the next as a binary value each."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer((edges * flat.itemsize).astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())


def _tokenise(path: str, end: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in slices(batches, "text"):
            ids, edges = encoder.encode(batch.column("text"), end)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _rows(ids.astype(kind), edges)], ["doc_id", "ids"])

    return run


def _count(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(byte_view(batch.column("ids"))[0].view(kind))
            if len(own) > len(counts):
                counts = np.r_[counts, np.zeros(len(own) - len(counts), np.int64)]
            counts[: len(own)] += own
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["id", "n"])

    return run


def coded(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks below 2^32."""
    sizes = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = sizes - 1
    four = padded.reshape(-1, 4)
    controls = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return controls.astype(np.uint8).tobytes(), raw[np.arange(4) < sizes[:, None]].tobytes()


def decoded(controls: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    sizes = _LENGTHS[controls].reshape(-1)[:n]
    at = np.cumsum(sizes, dtype=np.int64) - sizes
    out = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(sizes > k)
        if not len(more):
            break
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def block(doc_ids: list[int | None], sizes: list[int], ranks: np.ndarray) -> bytes:
    """Whole documents of so many ranks each, on end."""
    controls, data = coded(ranks)
    head = _MAGIC + struct.pack("<IQ", len(doc_ids), len(controls)) + bytes(i is not None for i in doc_ids)
    return head + np.array([i or 0 for i in doc_ids], "<i8").tobytes() + np.array(sizes, "<u8").tobytes() + controls + data


def documents_in(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """The doc_ids of a block, the number of ranks of each, and all ranks."""
    if data[:4] != _MAGIC:
        raise ValueError("not a block of token ids")
    n, controls = struct.unpack("<IQ", data[4:16])
    ids = np.frombuffer(data, "<i8", n, 16 + n)
    sizes = np.frombuffer(data, "<u8", n, 16 + 9 * n).astype(np.int64)
    raw, at = np.frombuffer(data, np.uint8), 16 + 17 * n
    return [int(i) if has else None for i, has in zip(ids, data[16 : 16 + n], strict=True)], sizes, decoded(raw[at : at + controls], raw[at + controls :], int(sizes.sum()))


def _blocks(order: bytes, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(order, "<u4")
        rank = np.zeros(int(known.max()) + 1 if len(known) else 1, np.uint32)
        rank[known] = np.arange(len(known), dtype=np.uint32)
        ids, sizes, streams, total, part, before = [], [], [], 0, 0, 0

        def closed():
            made = block(ids, sizes, np.concatenate(streams))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([total], pa.int64()), pa.array([made], pa.binary())], ["part", "before", "n_tokens", "block"])

        for batch in batches:
            for doc_id, own, p in zip(batch.column("doc_id"), batch.column("ids"), batch.column("part"), strict=True):
                part = p.as_py()
                ids.append(doc_id.as_py())
                streams.append(rank[np.frombuffer(own.as_buffer(), kind)])
                sizes.append(len(streams[-1]))
                total += sizes[-1]
                if 2 * total >= BLOCK_BYTES:
                    yield closed()
                    before += total
                    ids, sizes, streams, total = [], [], [], 0
        if ids:
            yield closed()

    return run


class TokenFiles:
    """blocks: part, before (tokens of the part before the block), n_tokens, block. ids: the id of each rank."""

    def __init__(self, blocks: DataFrame, ids: np.ndarray):
        self.blocks, self.ids = blocks, ids

    def read(self, ids: bool = True) -> DataFrame:
        """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit, left out if not asked for), ids_crc32, in no order."""
        totals = self.blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row per range
        starts, at = [], 0
        for r in totals:
            starts.append((r["part"], at))
            at += r["n"]
        spark = self.blocks.sparkSession
        offsets = spark.createDataFrame(starts, "part int, first long")
        order = self.ids.astype("<u4").tobytes()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.frombuffer(order, "<u4")
            for batch in batches:
                for start, data in zip(batch.column("start").to_pylist(), batch.column("block"), strict=True):
                    doc_ids, sizes, ranks = documents_in(data.as_buffer().to_pybytes())
                    edges = np.r_[0, np.cumsum(sizes)]
                    found = table[ranks]
                    sums = [zlib.crc32(found[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                    columns = {"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(start + edges[:-1]), "n_tokens": pa.array(sizes)} | ({"ids": _rows(found, edges)} if ids else {}) | {"ids_crc32": pa.array(sums, pa.int64())}
                    yield pa.RecordBatch.from_pydict(columns)

        blocks = self.blocks.join(F.broadcast(offsets), "part").select((F.col("first") + F.col("before")).alias("start"), "block")
        return blocks.transform(mapped, run, f"doc_id long, start long, n_tokens long,{' ids binary,' if ids else ''} ids_crc32 long")


def token_files(documents: DataFrame, path: str = VOCABULARY, end: int = END, column: str = "text") -> TokenFiles:
    """Write every document's token ids and the end id, in ascending order of doc_id.

    A null text is empty: the end id alone. A null doc_id is kept and comes first; repeated ids stay, ordered by their
    tokens. An empty table gives no blocks. Extra columns are ignored. Texts are tokenised where they lie; only ids are
    shuffled, into ranges of doc_id.
    """
    kind = "<u2" if max(_encoder(path).tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else "<u4"
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("string").alias("text"))
    plain = written(docs.transform(mapped, _tokenise(path, end, kind), "doc_id long, ids binary"), "ids", "zstd")
    counts = plain.select("ids").transform(mapped, _count(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # bounded by the vocabulary
    order = np.array([r["id"] for r in sorted(counts, key=lambda r: (-r["n"], r["id"]))], np.uint32)
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = plain.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids").withColumn("part", F.spark_partition_id())
    blocks = written(ranges.transform(mapped, _blocks(order.astype("<u4").tobytes(), kind), "part int, before long, n_tokens long, block binary"), "blocks", "zstd")
    forget(plain)
    return TokenFiles(blocks, order)
