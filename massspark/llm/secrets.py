"""Secret scan: a worklist unwraps nested URL, Unicode, base64 and compressed layers until nothing new appears.

Every layer keeps, for each of its characters, the span of the source text that it was decoded from, so that what is found
in a layer is reported as a span of the source. A layer that was seen before over the same span ends its branch.
"""

from __future__ import annotations

import base64
import bisect
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massspark.llm.common import mapped

KINDS = ("assign", "access", "hex")
_PATTERNS = (
    ("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)
_KEYWORDS = (b"passw", b"secret", b"token", b"key")
_HEX_RUN = bytes(97 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
_B64_RUN = bytes(97 if chr(i) in _B64 else 32 for i in range(256))
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
#: What follows a sign in an escape, and escapes of the signs themselves, with which chains of escapes begin.
_TAILS = {
    "%": re.compile(r"[0-9A-Fa-f]{2}"),
    "\\": re.compile(r"u\{[0-9a-fA-F]{1,6}\}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{2}"),
    "&": re.compile(r"#[0-9]{1,7};|#[xX][0-9a-fA-F]{1,6};"),
}
_SIGN = re.compile(r"%(?:25|26|5[cC])|\\(?:u00|u\{0{0,4}|U000000|x)(?:25|26|5[cC])|&#(?:0*(?:37|38|92)|[xX]0*(?:25|26|5[cC]));")
#: Escapes of signs that are undone at once, all but the last.
_LEVELS = 4
_ESCAPE = re.compile(r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u\{[0-9a-fA-F]{1,6}\}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\x[0-9a-fA-F]{2}|&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};")
#: Escapes that writers of byte strings use beside _ESCAPE; they are undone where compressed bytes may lie under them.
_SHORT = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "v": "\v", "a": "\a", "0": "\0", "\\": "\\", "'": "'", '"': '"', "/": "/"}
_BYTE_ESCAPE = re.compile(r"\\[nrtbfva0\\'\"/]|" + _ESCAPE.pattern)
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 broken into lines; the break may itself be written as \n.
_BREAK = r"[\x20\t]*(?:\r?\n|(?:\\r)?\\n)[\x20\t]*"
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{_BREAK}[A-Za-z0-9+/_-]++)+={{0,2}}")
_WRAPPED_BYTES = re.compile(_WRAPPED.pattern.encode("ascii"))
_AT_BREAK = re.compile(_BREAK)
_MAGIC = r"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|[\x50-\x5f]\x2a\x4d\x18"
_PACKED, _PACKED_BYTES = re.compile(_MAGIC), re.compile(_MAGIC.encode("ascii"), re.S)
_WIDE = re.compile("[^\x00-\xff]")
#: Bytes without any of these hold neither a secret nor a further layer: every secret has 12 letters or signs on end, which stand
#: as they are, escaped or in base64, with breaks between or a zero beside each, or inside compressed bytes.
_UNIT, _GAP = rb"[A-Za-z0-9+/_.=%\\&#;{}-]", rb"[\x20\t\r\n]"
_WORTH_RUNS = rb"(?:%b%b{0,4}){12}|(?:%b\0(?:%b\0){0,4}){12}|(?:\0%b(?:\0%b){0,4}){12}|" % (_UNIT, _GAP, _UNIT, _GAP, _UNIT, _GAP)
#: Compressed data is put in its place in the text up to this many bytes. What unfolds to more is scanned in windows of
#: about this size, cut where no secret and no layer can reach across, and only its first and last EDGE bytes are put there.
WINDOW, EDGE = 8 << 20, 1 << 16
#: The same for members that together unfold to more than a window, each of them scanned as a layer of its own.
SHORT_EDGE = 1 << 12
_SAFE = re.compile(rb"[^A-Za-z0-9+/_.=\-\"':%&#;{}\\\s\x80-\xff\0]|\0{4}")
_PIECE = 1 << 20
#: What compressed bytes, a character each, start with in UTF-8.
_MARKS = tuple(x.encode("utf-8") for x in ("\x1f\x8b\x08", "x\x01", "x^", "x\x9c", "x\xda", "BZh", "7zXZ", "(\xb5/\xfd", "*M\x18"))
_WORTH = re.compile(_WORTH_RUNS + _MAGIC.encode("ascii") + b"|" + b"|".join(re.escape(x) for x in _MARKS if not x.isascii()), re.S)


def find(text: str, raw: bytes | None = None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of one layer's secrets. raw: its UTF-8 bytes, for cheap tests of what cannot match."""
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    found = []
    for kind, pattern, group, least in _PATTERNS:
        if kind == "assign":
            low = raw.lower()
            if not any(k in low for k in _KEYWORDS):
                continue
        elif b"AKIA" not in raw if kind == "access" else b"a" * 16 not in raw.translate(_HEX_RUN):
            continue
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return found


class _Members:
    """What compressed members or frames hold that follow each other in data from a place on, piece by piece. end: behind the
    last one that began; None if there is none. running: data ended inside of it."""

    def __init__(self, data: bytes, at: int, stop: int):
        self.data, self.at, self.stop, self.end, self.running = data, at, stop, None, False

    def __iter__(self) -> Iterator[bytes]:
        while _PACKED_BYTES.match(self.data, self.at, self.stop):
            if self.data[self.at + 1 : self.at + 4] == b"\x2a\x4d\x18":  # a frame of zstd that holds nothing
                self.at += 8 + int.from_bytes(self.data[self.at + 4 : self.at + 8], "little")
                self.running = self.at > self.stop
                self.at = self.end = min(self.stop, self.at)
                continue
            yield from self._member()
            while self.end == self.at and self.data[self.at : min(self.at + 1, self.stop)] == b"\0":  # padding between members
                self.at += 1
            if self.end is None or self.running:
                return

    def _member(self) -> Iterator[bytes]:
        head, step = self.data[self.at : self.at + 4], 4096
        if head[:3] == b"BZh":
            unpacker = bz2.BZ2Decompressor()
        elif head[:1] == b"\xfd":
            unpacker = lzma.LZMADecompressor(lzma.FORMAT_XZ)
        elif head[:1] == b"\x28":
            unpacker, step = zstandard.ZstdDecompressor().decompressobj(), 256  # a block of 4 bytes may hold 128 KiB
        else:
            unpacker = zlib.decompressobj(47)
        limited, at, some = hasattr(unpacker, "needs_input"), self.at, False
        try:
            while at < self.stop and not unpacker.eof:
                part = self.data[at : min(at + step, self.stop)]
                at += len(part)
                out = unpacker.decompress(part, _PIECE) if limited else unpacker.decompress(part)
                while True:
                    if out:
                        some = True
                        yield out
                    if not limited or unpacker.eof or unpacker.needs_input:
                        break
                    out = unpacker.decompress(b"", _PIECE)
        except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError, zstandard.ZstdError):
            if some:
                self.end = self.stop
            self.at = self.stop
            return
        self.running = not unpacker.eof
        self.at = self.end = at - (len(unpacker.unused_data) if unpacker.eof else 0)


def _windows(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of pieces in windows that end where no secret, no encoded run and no compressed member goes on."""
    held, most = b"", WINDOW
    parts: list[bytes] = []
    size = 0
    for piece in pieces:
        parts.append(piece)
        size += len(piece)
        if size < most:
            continue
        held = b"".join(parts)
        cut = next((last.end() for back in (1 << 12, 1 << 18, len(held)) for last in deque(_SAFE.finditer(held, max(0, len(held) - back)), 1)), 0)
        at = 0
        while cut and (m := _PACKED_BYTES.search(held, at, cut)):
            members = _Members(held, m.start(), len(held))
            for _ in members:
                pass
            if members.running or members.end and members.end > cut:
                cut = m.start()
            at = max(m.end(), members.end or 0)
        if cut:
            yield held[:cut]
        most = WINDOW if cut else 2 * len(held)
        parts, size = [held[cut:]], len(held) - cut
    yield b"".join(parts)


def _readings(data: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """The texts that bytes may be, with the edges of each one's characters in the bytes.

    UTF-16 where a byte order mark says so; else UTF-8, or Latin-1 where that fails or may hold compressed bytes. Bytes
    with zeros may be UTF-16 without a mark, and are read as such too.
    """

    def wide(codec: str, start: int) -> tuple[str, np.ndarray]:
        text = data[start : start + (len(data) - start) // 2 * 2].decode(codec, "surrogatepass")
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        return text, start + np.r_[0, np.cumsum(np.where(codes > 0xFFFF, 4, 2))]

    marked = {b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}.get(data[:2])
    if marked:
        yield wide(marked, 2)
    try:
        text = data.decode("utf-8")
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        yield text, np.r_[0, np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))]
        plain = data.isascii() or not _PACKED_BYTES.search(data)
    except UnicodeDecodeError:
        plain = False
    if not plain:
        yield data.decode("latin-1"), np.arange(len(data) + 1)
    if b"\0" in data:
        for codec in ("utf-16-le", "utf-16-be"):
            yield wide(codec, 0)
            yield wide(codec, 1)


class _Layer:
    """A text; starts[i] and ends[i]: the source span of its character i, None if it is the source."""

    def __init__(self, text: str, starts=None, ends=None):
        self.text, self.starts, self.ends = text, starts, ends

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.starts is None else (int(self.starts[a]), int(self.ends[b - 1]))

    def replaced(self, pieces: list[tuple[int, int, str, list[int] | None]]) -> _Layer:
        """pieces: [a, b) becomes a text, whose characters come from so many characters each (None: all from all)."""
        text, starts, ends, at = [], [], [], 0
        own = np.arange(len(self.text) + 1)
        first, last = (own[:-1], own[1:]) if self.starts is None else (self.starts, self.ends)
        for a, b, new, widths in pieces:
            text += [self.text[at:a], new]
            starts += [first[at:a]]
            ends += [last[at:a]]
            if widths is None:
                starts.append(np.full(len(new), first[a]))
                ends.append(np.full(len(new), last[b - 1]))
            else:
                edge = a + np.r_[0, np.cumsum(widths)]
                starts.append(first[edge[:-1].astype(int)])
                ends.append(last[edge[1:].astype(int) - 1])
            at = b
        return _Layer("".join([*text, self.text[at:]]), np.concatenate([*starts, first[at:]]), np.concatenate([*ends, last[at:]]))

    def cut(self, new: str, first: np.ndarray, last: np.ndarray) -> _Layer:
        """A layer whose characters are decoded from the characters from first up to last (each one's end)."""
        return _Layer(new, first if self.starts is None else self.starts[first], last if self.ends is None else self.ends[last - 1])


def _unescaped(token: str) -> str:
    if token[0] == "\\" and len(token) == 2:
        return _SHORT[token[1]]
    if token[0] == "&":
        code = int(token[3:-1], 16) if token[2] in "xX" else int(token[2:-1])
    elif len(token) == 12:
        code = 0x10000 + ((int(token[2:6], 16) - 0xD800) << 10) + int(token[8:], 16) - 0xDC00
    else:
        code = int(token[2:].strip("{}"), 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"


def _unquoted(layer: _Layer) -> Iterator[_Layer]:
    """The layer with URL escapes undone: as UTF-8 where that is sound, and as bytes where they may hold compressed ones."""
    as_text, as_bytes = [], []
    for m in _PERCENT.finditer(layer.text):
        data = bytes.fromhex(m.group().replace("%", ""))
        try:
            new = data.decode("utf-8")
            widths = [3 * len(c.encode("utf-8")) for c in new]
        except UnicodeDecodeError:
            new, widths = data.decode("latin-1"), [3] * len(data)
        as_text.append((m.start(), m.end(), new, widths))
        as_bytes.append((m.start(), m.end(), data.decode("latin-1"), [3] * len(data)))
    if not as_text:
        return
    yield layer.replaced(as_text)
    blanks = [(m.start(), m.end(), " ", [1]) for m in re.finditer(r"\+", layer.text)]
    for pieces in ([as_bytes] if any(a[2] != b[2] for a, b in zip(as_text, as_bytes, strict=True)) else []) + ([sorted(as_bytes + blanks)] if blanks else []):
        got = layer.replaced(pieces)
        if _PACKED.search(got.text):
            yield got


def _unpacked(layer: _Layer) -> Iterator[_Layer]:
    """The layer with compressed bytes, a character each, replaced by the texts they hold."""
    if not _PACKED.search(layer.text):
        return
    data, found, at, total = layer.text.encode("latin-1", "replace"), [], 0, 0
    wide = [m.start() for m in _WIDE.finditer(layer.text)]
    while m := _PACKED.search(layer.text, at):
        stop = bisect.bisect_left(wide, m.start())
        members = _Members(data, m.start(), wide[stop] if stop < len(wide) else len(data))
        pieces, parts, size = iter(members), [], 0
        for piece in pieces:
            parts.append(piece)
            size += len(piece)
            if size > WINDOW:
                break
        if size > WINDOW:
            first, last = b"".join(parts)[:EDGE], b""

            def rest(parts=parts, pieces=pieces):
                nonlocal last
                for piece in itertools.chain(parts, pieces):
                    last = (last + piece)[-EDGE:]
                    yield piece

            for window in _windows(rest()):
                if _WORTH.search(window):
                    for text, _ in _readings(window):
                        yield _Layer(text, *(np.broadcast_to(np.int64(x), len(text)) for x in layer.span(m.start(), members.stop)))
            found.append((m.start(), members.end or members.stop, first + b"\0" + last))
        elif members.end and size:
            inner, total = b"".join(parts), total + size
            if total > WINDOW:  # all together would be too much for one layer, so this one has layers of its own
                for text, _ in _readings(inner):
                    yield _Layer(text, *(np.broadcast_to(np.int64(x), len(text)) for x in layer.span(m.start(), members.end)))
                inner = inner if size <= 2 * SHORT_EDGE else inner[:SHORT_EDGE] + b"\0" + inner[-SHORT_EDGE:]
            found.append((m.start(), members.end, inner))
        at = max(m.end(), members.end or 0) if size else m.end()
    # all members at once, each read in each of its ways: replaced one by one they would be found again in each other's layers
    texts = [[text for text, _ in _readings(inner)] for *_, inner in found]
    for k in range(max(map(len, texts), default=0)):
        yield layer.replaced([(a, b, own[min(k, len(own) - 1)], None) for (a, b, _), own in zip(found, texts, strict=True)])


def _chains(text: str) -> list[tuple[int, int, str, None]]:
    """Runs of escapes of escapes, of whatever kinds, as pieces: each becomes the sign of its last escape, in one pass."""
    out, at = [], 0
    while m := _SIGN.search(text, at):
        sign, end, levels = text[m.start()], m.start() + 1, 0
        while tail := _TAILS[sign].match(text, end):
            new = chr(int(tail.group(), 16)) if sign == "%" else _unescaped(sign + tail.group())
            if new not in _TAILS:
                break
            sign, end, levels = new, tail.end(), levels + 1
        if levels >= _LEVELS:
            out.append((m.start(), end, sign, None))
        at = max(m.end(), end)
    return out


def _unwrapped(layer: _Layer) -> Iterator[_Layer]:
    """The layers right below one, each made when it is asked for."""
    text = layer.text
    chains = _chains(text)
    if chains:
        yield layer.replaced(chains)
        return
    yield from _unpacked(layer)
    if "%" in text:
        yield from _unquoted(layer)
    if "\\" in text or "&#" in text:
        pieces = [(m.start(), m.end(), _unescaped(m.group()), None) for m in _ESCAPE.finditer(text)]
        if pieces:
            yield layer.replaced(pieces)
            as_bytes = layer.replaced([(m.start(), m.end(), _unescaped(m.group()), None) for m in _BYTE_ESCAPE.finditer(text)])
            if _PACKED.search(as_bytes.text):
                yield as_bytes
    for m in _BASE64.finditer(text):
        yield from _decoded(layer, m.group().rstrip("="), lambda i, at=m.start(): at + i)
    for m in _WRAPPED.finditer(text) if "\n" in text or "\\n" in text else ():
        breaks = [x.span() for x in _AT_BREAK.finditer(text, m.start(), m.end())]
        lines = list(zip([m.start(), *(b for _, b in breaks)], [*(a for a, _ in breaks), m.end()], strict=True))
        body, places = "".join(text[a:b] for a, b in lines).rstrip("="), np.concatenate([np.arange(a, b) for a, b in lines])
        if len(body) >= 16:
            yield from _decoded(layer, body, places.__getitem__)


def _decoded(layer: _Layer, run: str, place) -> Iterator[_Layer]:
    """What a run of base64 characters decodes to; place: where in the layer they stand. A path or word before the code, on
    the line before even, is part of the run, so it is read from each of its first four characters on."""
    run = run.replace("-", "+").replace("_", "/")
    for shift in range(min(4, len(run) - 1)):
        body = run[shift : len(run) - ((len(run) - shift) % 4 == 1)]
        data = base64.b64decode(body + "=" * (-len(body) % 4))
        if not _WORTH.search(data):
            continue
        for text, edges in _readings(data):
            if text:
                yield layer.cut(text, place(shift + edges[:-1] * 4 // 3), place(shift + np.minimum(-(-edges[1:] * 4 // 3), len(body)) - 1) + 1)


def scan(text: str, raw: bytes | None = None) -> tuple[list, list, int]:
    """Base (start, kind, end); all of them with those of inner layers; layers opened.

    The worklist is a stack of layers that make the next one below them when asked, so no more than one path is held."""
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    base = find(text, raw)
    if not (b"%" in raw or b"\\" in raw or b"&#" in raw or b"a" * 16 in raw.translate(_B64_RUN) or b"\n" in raw and any(m.end() - m.start() > 16 for m in _WRAPPED_BYTES.finditer(raw)) or any(x in raw for x in _MARKS)):
        return base, base, 0
    everything, work, seen, layers = set(base), [_unwrapped(_Layer(text))], set(), 0
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.text:
            continue
        mark = hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), layer.span(0, len(layer.text))
        if mark in seen:
            continue
        seen.add(mark)
        layers += 1
        for a, kind, b in find(layer.text):
            s, e = layer.span(a, b)
            everything.add((s, kind, e))
        work.append(_unwrapped(layer))
    return base, list(everything), layers


def _joined(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(found, key=lambda x: (x[0], KINDS.index(x[1]), x[2])))


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long"


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            base, everything, layers = scan(text or "")
            counts = [sum(x[1] == k for x in base) for k in KINDS]
            rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(everything), layers))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.string() if i in (3, 4) else pa.int64()) for i, c in enumerate(columns))], [x.split()[0] for x in _SCHEMA.split(", ")])


def secret_spans(documents: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans (kind:start:end of the text's code points), n_layers.

    One row per input row, repeated rows included. A null or empty text has no spans; a null doc_id is kept. Other
    columns are ignored. An empty table gives an empty result. Partitions are scanned where they are: no shuffle.
    """
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("string").alias("text")).transform(mapped, _scan_batches, _SCHEMA)


def redact(text: str | None, mask: str = "[SECRET]") -> str | None:
    """The text with every span, of whatever layer, replaced."""
    if not text:
        return text
    out, at = [], 0
    spans = sorted((s, e) for s, _, e in scan(text)[1])
    for i, (s, e) in enumerate(spans):
        if s < at:
            at = max(at, e)
            continue
        out += [text[at:s], mask]
        at = e
    return "".join([*out, text[at:]])


def redacted(documents: DataFrame, column: str = "text") -> DataFrame:
    """The same rows and columns, the column's secrets masked, however deep they are wrapped. Null stays null, an empty text empty;
    repeated rows are masked each; an empty table gives an empty result. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(column)
            yield batch.set_column(i, batch.schema.field(i), pa.array([redact(x) for x in batch.column(i).to_pylist()], batch.schema.field(i).type))

    return documents.transform(mapped, run, documents.schema)
