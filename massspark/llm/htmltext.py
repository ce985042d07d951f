"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut at its block elements into leaf blocks, each with the tags and the class and id words of its ancestors and
some features of its text. The field scores blocks as main text or not and the changes between neighbours; it is trained
by its exact gradient (forward-backward) on labelled pages and decoded by Viterbi.
"""

from __future__ import annotations

import bisect
import functools
import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massspark.llm.common import mapped

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_OPENING = re.compile(r"</?[a-zA-Z]")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
#: Elements that end the block before them and start their own.
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never part of a page's prose; that of all others is left to the field.
_HIDDEN = frozenset("script style title textarea select template head".split())
#: Elements that may stand in head. Any other, and text, ends it, as its end tag and the body's start tag may be omitted.
_IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
_RAW = frozenset("script style title textarea".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "body": {"head"}}


class Path:
    """Names of tags, classes and ids that the elements around a block have, as a list linked upwards: names are those that no
    element further out has. So blocks of one element share it, however deep they stand."""

    __slots__ = ("parent", "names", "sums")

    def __init__(self, parent: Path | None, names: tuple[str, ...]):
        self.parent, self.names, self.sums = parent, names, None

    def __iter__(self) -> Iterator[str]:
        at: Path | None = self
        while at is not None:
            yield from at.names
            at = at.parent


_ROOT = Path(None, ())


class Block:
    """A leaf block: its text, the share of it inside links, its ancestors' names, and the innermost one's."""

    __slots__ = ("text", "linked", "path", "inner")

    def __init__(self, text: str, linked: int, path: Path = _ROOT, inner: str = ""):
        self.text, self.linked, self.path, self.inner = text, linked, path, inner


class _Tokens:
    """Comments, declarations and tags of a page, from a place on. A `<` that starts none of them is text; that is known from
    the quotes and `>` behind it, all looked at once, so a page of broken tags costs no more than another."""

    def __init__(self, source: str):
        self.source, self.end, self.ends = source, source.rfind(">"), None

    def _closes(self, at: int) -> bool:
        if self.ends is None:
            self.places = [m.start() for m in re.finditer("[\"'>]", self.source)]
            self.ends, after = [False] * (len(self.places) + 1), {'"': len(self.places), "'": len(self.places)}
            for i in range(len(self.places) - 1, -1, -1):
                c = self.source[self.places[i]]
                self.ends[i] = c == ">" or self.ends[min(after[c] + 1, len(self.places))]
                if c != ">":
                    after[c] = i
        return self.ends[bisect.bisect_left(self.places, at)]

    def search(self, at: int) -> re.Match | None:
        while (at := self.source.find("<", at)) >= 0:
            if at < self.end or self.source.startswith("<!--", at):
                if self.ends is None or not self.source[at + 1 : at + 2].strip("!?") or self._closes(at):
                    if m := _TOKEN.match(self.source, at):
                        return m
                    if _OPENING.match(self.source, at):
                        self._closes(at)
            at += 1
        return None


def blocks(source: str | None) -> list[Block]:
    """The leaf blocks with text, in page order. Unclosed and stray tags are taken as browsers would, roughly.

    Takes time in proportion to the page, whatever stands in it."""
    source = source or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], Path, str]] = []
    opened: Counter[str] = Counter()  # by tag
    named: Counter[str] = Counter()
    outer: list[int] = []  # the block elements' places in the stack
    pieces: list[str] = []
    tokens = _Tokens(source)
    linked, hidden, at = 0, 0, 0

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            out.append(Block(text, min(linked, len(text)), *(stack[-1][2:] if stack else ())))
        pieces.clear()
        linked = 0

    def push(tag: str, names: tuple[str, ...]) -> None:
        nonlocal hidden
        path, inner = stack[-1][2:] if stack else (_ROOT, "")
        own = (tag, *names) if tag in _BLOCKS or names else ()
        new = tuple(dict.fromkeys(n for n in own if not named[n]))
        named.update(own)
        opened[tag] += 1
        if tag in _BLOCKS:
            outer.append(len(stack))
        stack.append((tag, own, Path(path, new) if new else path, own[-1] if own else inner))
        hidden += tag in _HIDDEN

    def pop(depth: int) -> None:
        """The elements from this depth on end."""
        nonlocal hidden
        for tag, own, *_ in stack[depth:]:
            hidden -= tag in _HIDDEN
            opened[tag] -= 1
            named.subtract(own)
        del stack[depth:]
        while outer and outer[-1] >= depth:
            outer.pop()

    def leave_head() -> None:
        if opened["head"] and not opened["template"]:
            pop(next(i for i, x in enumerate(stack) if x[0] == "head"))

    while at < len(source):
        m = tokens.search(at)
        if hidden and stack[-1][0] == "head" and source[at : m.start() if m else len(source)].strip():
            leave_head()
        if not hidden:
            piece = source[at : m.start() if m else len(source)]
            pieces.append(piece)
            linked += len(piece) if opened["a"] else 0
        if m is None:
            break
        at, tag = m.end(), (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            if opened[tag]:
                i = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
                if outer and outer[-1] >= i:
                    close()
                pop(i)
            continue
        if hidden and tag not in _IN_HEAD:
            leave_head()
        if tag in _BLOCKS:
            close()
            gone = _CLOSES.get(tag, set()) | ({"p"} if tag not in ("html", "body", "head") else set())
            for i in reversed(outer):
                if stack[i][0] in gone:
                    pop(i)
                    break
                if stack[i][0] != "p":
                    break
        if tag in _VOID:
            pieces.append(" " if tag == "br" else "")
            continue
        names = []
        for n in _NAMES.finditer(m.group(3)):
            value = re.sub(r"([a-z])([A-Z])", r"\1 \2", n.group(1) or n.group(2) or n.group(3) or "")
            names += ["." + w for w in _SPLIT.split(value.lower()) if w]
        if not m.group(3).endswith("/"):
            push(tag, tuple(names))
            if tag in _RAW:  # no markup inside: go to its end tag
                end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = end.start() if end else len(source)
    close()
    return out


def features(block: Block) -> list[str]:
    return ["bias", f"in:{block.inner}", *(f"a:{x}" for x in block.path)]


def text_features(block: Block) -> list[str]:
    n = len(block.text)
    share = block.linked / n
    return [
        f"len:{min(7, int(math.log2(n)))}",
        f"link:{0 if share == 0 else 1 if share < 0.5 else 2}",
        f"stop:{block.text.rstrip(chr(34))[-1:] in ('.', '!', '?', ':', ';', '…')}",
        f"sign:{any(c in block.text for c in '©®|»›·')}",
    ]


class Field:
    """weights: of each feature for the two labels; change: of label after label."""

    def __init__(self, weights: dict[str, tuple[float, float]], change: np.ndarray):
        self.weights, self.change = weights, change

    def _sum(self, names: list[str]) -> tuple[float, float]:
        pairs = [self.weights[n] for n in names if n in self.weights]
        return sum(p[0] for p in pairs), sum(p[1] for p in pairs)

    def _path(self, path: Path) -> tuple[float, float]:
        """The sums of a path's names, kept with it."""
        new, at = [], path
        while at is not None and (at.sums is None or at.sums[0] is not self):
            new.append(at)
            at = at.parent
        total = at.sums[1:] if at is not None else (0.0, 0.0)
        for x in reversed(new):
            own = self._sum([f"a:{n}" for n in x.names])
            total = total[0] + own[0], total[1] + own[1]
            x.sums = (self, *total)
        return total

    def scores(self, page: list[Block]) -> list[tuple[float, float]]:
        out = []
        for b in page:
            p, t = self._path(b.path), self._sum(["bias", f"in:{b.inner}", *text_features(b)])
            out.append((p[0] + t[0], p[1] + t[1]))
        return out

    def decode(self, page: list[Block]) -> list[int]:
        """Viterbi: the labels of the greatest total score (0 on a tie)."""
        if not page:
            return []
        (aa, ab), (ba, bb) = self.change.tolist()
        scores = self.scores(page)
        x, y, back = *scores[0], []
        for s, t in scores[1:]:
            back.append((int(y + ba > x + aa), int(y + bb > x + ab)))
            x, y = max(x + aa, y + ba) + s, max(x + ab, y + bb) + t
        label, out = int(y > x), []
        for b in reversed(back):
            out.append(label)
            label = b[label]
        return [*out, label][::-1]


def gradient(rows: list[np.ndarray], labels: np.ndarray, w: np.ndarray, change: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The log likelihood of a page's labels, by forward-backward, and its derivatives by the weights and the changes.

    rows: the features of each block."""
    n = len(rows)
    emit = np.array([w[r].sum(axis=0) for r in rows])
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    forward[0] = emit[0]
    for i in range(1, n):
        forward[i] = np.logaddexp(forward[i - 1, 0] + change[0], forward[i - 1, 1] + change[1]) + emit[i]
        j = n - 1 - i
        ahead = emit[j + 1] + backward[j + 1]
        backward[j] = np.logaddexp(change[:, 0] + ahead[0], change[:, 1] + ahead[1])
    total = np.logaddexp(*forward[-1])
    apart = -np.exp(forward + backward - total)
    apart[np.arange(n), labels] += 1
    by_change = np.zeros_like(change)
    for i in range(1, n):
        by_change -= np.exp(forward[i - 1][:, None] + change + (emit[i] + backward[i])[None, :] - total)
        by_change[labels[i - 1], labels[i]] += 1
    by_weight = np.zeros_like(w)
    for r, a in zip(rows, apart, strict=True):
        by_weight[r] += a
    own = emit[np.arange(n), labels].sum() + change[labels[:-1], labels[1:]].sum()
    return float(own - total), by_weight, by_change


def train(pages: list[tuple[list[Block], list[int]]], passes: int = 12, rate: float = 0.3, ridge: float = 1e-3) -> Field:
    """The field that fits labelled pages, by AdaGrad steps along the exact gradient of the log likelihood."""
    index: dict[str, int] = {}
    coded = []
    for page, labels in pages:
        if page:
            rows = [[index.setdefault(f, len(index)) for f in features(b) + text_features(b)] for b in page]
            coded.append(([np.array(r) for r in rows], np.array(labels)))
    w, change = np.zeros((len(index), 2)), np.zeros((2, 2))
    seen_w, seen_c = np.full_like(w, 1e-8), np.full_like(change, 1e-8)
    order = random.Random(0)
    for _ in range(passes):
        order.shuffle(coded)
        for rows, labels in coded:
            _, step_w, step_c = gradient(rows, labels, w, change)
            step_w -= ridge * w * (step_w != 0)
            step_c -= ridge * change
            seen_w += step_w**2
            seen_c += step_c**2
            w += rate * step_w / np.sqrt(seen_w)
            change += rate * step_c / np.sqrt(seen_c)
    return Field({f: (float(w[i, 0]), float(w[i, 1])) for f, i in index.items()}, change)


_ASIDE = {
    "nav": ["menu", "nav", "navigation", "breadcrumb", "topnav", "navbar", "links"], "header": ["header", "masthead", "top", "branding", "site header"],
    "footer": ["footer", "bottom", "copyright", "legal", "site footer"], "aside": ["sidebar", "aside", "widget", "related", "rail", "tags", "trending"],
    "ad": ["ad", "ads", "advert", "advertisement", "banner", "sponsored", "sponsor", "promo"], "notice": ["notice", "cookie", "consent", "alert", "disclaimer", "popup", "modal", "gdpr", "subscribe", "newsletter", "message"],
    "form": ["form", "login", "search", "signup", "contact"], "comments": ["comments", "comment", "replies", "respond", "discussion", "disqus", "comment list", "comment body"], "share": ["share", "social", "author", "byline", "meta", "toolbar"],
}
_MAIN = ["article", "content", "main", "post", "entry", "story", "body", "text", "post content", "article body", "main content", "entry content"]


def labelled_pages(count: int, seed: int = 0) -> list[tuple[str, list[str]]]:
    """Made-up pages with the main text's blocks, over the layouts in common use. The same seed gives the same pages."""
    rng = random.Random(seed)

    def word() -> str:
        return "".join(rng.choice("bcdfghlmnprst") + rng.choice("aeiouéü") for _ in range(rng.randint(1, 4)))

    def prose(low: int, high: int) -> str:
        text = " ".join(word() for _ in range(rng.randint(low, high)))
        return text[0].upper() + text[1:] + rng.choice([".", ".", "!", "", "?", "..."])

    def named(tags: list[str], names: list[str], inner: str) -> str:
        tag = rng.choice(tags)
        plain = tag in ("nav", "footer", "aside", "header", "form", "article", "main")
        return f"<{tag}>{inner}</{tag}>" if plain and rng.random() < 0.6 else f'<{tag} {rng.choice(["class", "id"])}="{rng.choice(names)}">{inner}</{tag}>'

    def boilerplate(kind: str) -> str:
        items = [prose(1, 4 if kind in ("nav", "header", "share") else 25).rstrip(".") for _ in range(rng.randint(1, 7))]
        style = rng.random()
        if kind == "nav" or kind in ("aside", "footer", "share") and style < 0.4:
            inner = "<ul>" + "".join(f'<li><a href="/{word()}">{x}</a></li>' for x in items) + "</ul>"
        elif kind == "form":
            inner = "".join(f"<label>{x}</label><input name=q>" for x in items[:3]) + "<button>" + word() + "</button>"
        elif style < 0.7 or kind == "ad":
            inner = rng.choice(["", "&copy; "]) * (kind == "footer") + items[0] + rng.choice(["", f" &middot; {prose(3, 20)}"]) * (kind == "footer")
        else:
            inner = "".join(f"<p>{x}</p>" for x in items[:4])
        tags = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "form": ["form"]}.get(kind, ["div", "section"] if kind != "ad" else ["div", "aside", "p"])
        return named(tags, _ASIDE[kind], inner)

    out = []
    for _ in range(count):
        title, texts = prose(3, 9), [prose(1, 60) if rng.random() < 0.8 else prose(1, 4) for _ in range(rng.randint(1, 9))]
        main, parts = [], []
        if rng.random() < 0.8:
            main.append(title)
            parts.append(f"<h1>{title}</h1>")
        for t in texts:
            kind = rng.random()
            main.append(t)
            if kind < 0.12:
                parts.append(f"<h2>{t}</h2>")
            elif kind < 0.2:
                parts.append(f"<ul><li>{t}</li></ul>")
            elif kind < 0.26:
                parts.append(f"<blockquote>{t}</blockquote>")
            elif kind < 0.34:
                parts.append(f"<p><b>{t}<br>")
            else:
                parts.append(f"<p>{t}</p>" if rng.random() < 0.8 else f"<p>{t}")
            if rng.random() < 0.08:
                parts.append(boilerplate(rng.choice(["ad", "share", "notice", "aside"])))
        if rng.random() < 0.2:
            parts.append(boilerplate("comments"))
        body = named(["article", "article", "article", "main", "div", "section"], _MAIN, "".join(parts))
        if rng.random() < 0.25:
            body = named(["main", "div"], ["wrapper", "container", "page", "main", "row"], body)
        before = [boilerplate(k) for k in ("header", "nav", "notice", "ad", "form") if rng.random() < 0.5]
        after = [boilerplate(k) for k in ("aside", "comments", "ad", "form", "share", "footer") if rng.random() < 0.5]
        out.append((f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a='<p>';</script></head><body>{''.join(before)}<!-- x -->{body}{''.join(after)}</body></html>", main))
    return out


def labelled_blocks(source: str, main: list[str]) -> tuple[list[Block], list[int]]:
    """A page's blocks, labelled 1 where their text is the next of the main text's."""
    page, labels, want = blocks(source), [], [" ".join(html.unescape(m).split()) for m in main]
    for b in page:
        hit = bool(want) and b.text == want[0]
        labels.append(int(hit))
        if hit:
            want.pop(0)
    return page, labels


@functools.lru_cache
def default_field(count: int = 500) -> Field:
    """Trained on `count` made-up labelled pages: the bounded sample that the model is fitted on."""
    return train([labelled_blocks(*p) for p in labelled_pages(count)])


def _extract(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source in batch.column("html").to_pylist():
                page = blocks(source)
                texts.append("\n".join(b.text for b, keep in zip(page, field.decode(page), strict=True) if keep))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars: the main text's blocks of each page, joined by line feeds; one row per input row.

    Null, empty and text-free pages give an empty text; null ids and urls are kept; extra columns are ignored; an empty
    table gives an empty result. Pages are worked on where they are; the field (some hundred weights) travels along.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.transform(mapped, _extract(field or default_field()), "page_id long, url string, text string, n_chars long")
