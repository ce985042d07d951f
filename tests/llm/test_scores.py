"""Filter audit, quality classifier and whitening: brute force, gradients, held-out accuracy, awkward inputs."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from massspark.llm import audit, quality, whitening

DOCS = "doc_id long, text string, lang string, source string, n int, part string, mask int, quality int, digest string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)


def brute_counts(text):
    words = WORD.findall(text)
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(re.findall(r"[#$%&*|]", text)), len(text)]


def some_texts(rng):
    words = ["a", "A", "é", "Word", "x" * 70, "#", "$5", "\x00", "naïve", "日本", "tail", "\x85", "\u2003x"]
    return ["", " ", "\t\n", "one", *(rng.choice(["", " "]) + "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\x0b", "\r"]) for _ in range(rng.randrange(60))) for _ in range(60))]


def test_counts():
    texts = some_texts(random.Random(1))
    assert audit.text_counts(*packed(texts)).tolist() == [brute_counts(t) for t in texts]
    for t in texts:
        for piece in (1, 3, 16, 50):  # a long text is read in pieces, however long its words are
            assert audit.text_counts(*packed([t]), piece=piece).tolist() == [brute_counts(t)]


def test_equal_hashes_of_other_words(monkeypatch):
    monkeypatch.setattr(audit, "_hashes", lambda data, starts, lengths: (lengths % 2).astype(np.uint64) << np.uint64(60))
    texts = some_texts(random.Random(2))
    assert audit.text_counts(*packed(texts)).tolist() == [brute_counts(t) for t in texts]


def brute_audit(docs, labels):
    good, toxic = ({d for d, *x in labels if x[i] == 1 and d is not None} for i in (0, 1))
    fails = []
    for d, text, lang in docs:
        w, u, c, s, n = brute_counts(text or "")
        copy = d is not None and any(e is not None and e < d and (t or "") == (text or "") for e, t, _ in docs)
        fails.append((lang or "", {x for x, f in zip("ABCDE", (w < 200, 100 * u < 50 * w, 100 * c > 3 * n, s > 0, copy), strict=True) if f}, d in good, d in toxic))
    out, total = [], {}
    for part, order in itertools.product({f[0] for f in fails}, itertools.permutations("ABCDE")):
        left = [f for f in fails if f[0] == part]
        every = left
        for step, x in enumerate(order, 1):
            here = [f for f in left if x in f[1]]
            left = [f for f in left if x not in f[1]]
            failing = [f for f in every if x in f[1]]
            out.append((part, "".join(order), step, len(left), len(here), len(failing) - len(here), sum(f[1] == {x} for f in every), sum(f[2] for f in here), sum(f[3] for f in here)))
            total[part, x] = total.get((part, x), 0) + len(here)
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    long = [" ".join(rng.sample(words, 220)), " ".join(["same"] * 210), "ABC " * 201, "x# " + " ".join(rng.sample(words, 210))]
    texts = [None, "", "short", *long, *long]
    docs = [(i if i % 9 else None, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(90)]
    docs += [docs[5], (docs[5][0], docs[5][1], "en"), (200, None, "en"), (201, "", "fr")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 90, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None), (999, 1, 1)]
    df = spark.createDataFrame([(*d, "s", 1, "p", 2, 1, "x") for d in docs], DOCS).repartition(3)
    known = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string")
    out = audit.audit(df, known)
    got = sorted(map(tuple, out.collect()))
    assert got == brute_audit(docs, labels)
    assert all(g[4] + g[3] <= len(docs) for g in got) and audit.audit(df.limit(0), known).count() == 0
    assert {r.good_lost for r in audit.audit(df, known.limit(0)).collect()} == {0}


def test_gradient_of_the_network():
    rng = np.random.default_rng(5)
    texts = ["", "a", "some words of a text " * 12, "!!! $$$ " * 30, "é" * 90]
    data, offsets = packed(texts)
    labels = np.array([0, 1, 1, 0, 1])
    net = quality.Network(*(x.astype(np.float64) for x in (rng.normal(size=(256, 8)), 0.3 * rng.normal(size=(64, 24)), rng.normal(size=24) - 1, rng.normal(size=72), rng.normal(size=1))))
    _, slopes = quality.gradients(net, data, offsets, labels)
    for part, slope in zip(net.parts(), slopes, strict=True):
        for at in rng.choice(part.size, min(part.size, 25), replace=False):
            was, loss = part.flat[at], []
            for h in (1e-6, -1e-6):
                part.flat[at] = was + h
                loss.append(quality.gradients(net, data, offsets, labels)[0])
            part.flat[at] = was
            assert slope.flat[at] == pytest.approx((loss[0] - loss[1]) / 2e-6, abs=1e-5)


def test_chunks_cover_the_text():
    rng = np.random.default_rng(6)
    net = quality.Network(*(x.astype(np.float32) for x in (rng.normal(size=(256, 8)), 0.2 * rng.normal(size=(64, 24)), np.zeros(24), rng.normal(size=72), np.zeros(1))))
    for n in [*range(0, 20), 127, 128, 129, 223, 224, 225, 226, 1000, 100_001]:
        raw = rng.integers(32, 120, n).astype(np.uint8)
        flat, starts, ends, row = quality._laid_out(raw, np.array([0, n]))
        covered = np.zeros(len(flat), bool)
        for s, e in zip(starts, ends, strict=True):
            covered[s:e] = True
            assert quality.WIDTH <= e - s <= quality.CHUNK and s % quality.STRIDE == 0
        assert covered.all() and all(s < e for s, e in zip(starts[1:], ends[:-1], strict=True))
        x = net.embedding[flat]  # filter by filter, place by place
        plain = np.array([[max((x[p : p + 8].ravel() @ net.filters).astype(np.float64)[f] for p in range(s, e - 7, 2)) for f in range(24)] for s, e in zip(starts, ends, strict=True)]) if n < 300 else None
        got = quality.pooled(net, flat, starts, ends)
        assert plain is None or np.abs(got - np.tanh(plain)).max() < 1e-4
        together = quality.score_texts(net, np.r_[raw, raw[: n // 2]], np.array([0, n, n, n + n // 2]))
        alone = [float(quality.score_texts(net, r, np.array([0, len(r)]))[0]) for r in (raw, raw[:0], raw[: n // 2])]
        assert together == pytest.approx(alone, abs=1e-6)


def test_quality(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(200)]
    prose = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(30, 200))).capitalize() + ". End, of it."
    junk = [lambda: " ".join(w + "$$$" for w in prose().split()), lambda: prose().upper(), lambda: " ".join([rng.choice(words)] * 150)]
    rows = [(i, prose() if i % 3 else rng.choice(junk)(), int(i % 3 > 0)) for i in range(900)]
    docs = [(i, t, "en", "s", 1, "p", 2, 1 - q, "x") for i, t, q in rows] + [(1000, None, None, None, 1, "p", 2, 1, "x"), (1001, "", "en", "s", 1, "p", 2, 1, "x"), (None, "a b", "en", "s", 1, "p", 2, 1, "x")]
    docs += [docs[0]]
    # labels of held-out rows are all turned: they must not teach
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    labels = [(i, 1 - q if i in held else q, 0) for i, _, q in rows] + [(3, 0, 0), (5, 0, 0), (5, 1, 0), (None, 1, 1), (7, None, 0), (8, 9, 0)]
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    net = quality.fit(df, known)
    got = {}
    for r in quality.score(df, net).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got) == 903 and len(got[0]) == 2 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for x in got.values() for r in x)
    assert all(got[i][0].held_out == (i in held) for i, *_ in rows) and got[None][0].held_out is False
    assert got[1000][0].score == got[1001][0].score
    right = [got[i][0].predicted == q for i, _, q in rows if i in held]
    assert sum(right) / len(right) >= 0.95
    assert quality.score(df.limit(0), net).count() == 0
    for some, share in ((known.limit(0), 0.5), (known.where("quality = 1"), None)):
        scores = {r.score for r in quality.score(df, quality.fit(df, some)).collect()}
        assert len(scores) == 1 and (scores == {share} if share else min(scores) > 0.9)
    again = quality.fit(df, known)
    assert all((a == b).all() for a, b in zip(net.parts(), again.parts(), strict=True))


EMBEDDINGS = "vec_id long, embedding array<float>, component int, x string, n int"


def test_whitening(spark):
    rng = np.random.default_rng(8)
    vectors = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) * 0.3).astype(np.float32)
    rows = [(i, v.tolist(), 1, "x", 2) for i, v in enumerate(vectors)]
    rows += [rows[3], (None, rows[4][1], 1, "x", 2)]
    bad = [(500, None, 1, "x", 2), (501, [None] * 12, 1, "x", 2), (502, [math.nan] + [0.0] * 11, 1, "x", 2), (503, [math.inf] + [0.0] * 11, 1, "x", 2), (504, [1.0], 1, "x", 2), (505, [], 1, "x", 2)]
    df = spark.createDataFrame(rows + bad, EMBEDDINGS).repartition(3)
    x = np.floor(1024 * np.array([r[1] for r in rows], np.float32).astype(np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    want = centred @ vectors / np.sqrt(values)
    out = whitening.whitened(df).collect()
    assert len(out) == 8 * n and {r.n for r in out} == {n} and {r.component for r in out} == set(range(1, 9))
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    by = {}
    for r in out:
        by.setdefault((r.vec_id, r.component), []).append(r)
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(v), rel=1e-9) and r.identity_error < 1e-9
    for k in range(8):
        sign = np.sign(by[0, k + 1][0].whitened * want[0, k])
        for i, (vec, *_) in enumerate(rows):
            assert all(r.whitened == pytest.approx(sign * want[i, k], abs=1e-8) and r.deviation == deviation[i] for r in by[vec, k + 1])
    assert len(by[3, 1]) == 2


def test_whitening_of_little(spark):
    frame = lambda rows: spark.createDataFrame([(i, r, 1, "x", 2) for i, r in enumerate(rows)], EMBEDDINGS)
    assert whitening.whitened(frame([[1.0, 2.0]]).limit(0)).count() == 0
    assert whitening.whitened(frame([[1.0, 2.0]])).count() == 0 and whitening.whitened(frame([[1.0, 2.0]] * 3)).count() == 0
    flat = whitening.whitened(frame([[0.5, 0.5], [1.0, 1.0], [2.0, 2.0]])).collect()  # one component has no variance
    assert {r.component for r in flat} == {1} and {round(r.explained, 9) for r in flat} == {1.0} and np.mean([r.whitened**2 for r in flat]) == pytest.approx(1)
    huge = whitening.whitened(frame([[1e30, 0.0], [-1e30, 1.0], [0.0, 0.5]])).collect()
    assert {r.vec_id for r in huge} == {0, 1, 2} and all(r.deviation is None or r.deviation >= 0 for r in huge)


def test_whitening_in_several_passes(spark, monkeypatch):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, rng.normal(size=5).tolist(), 1, "x", 2) for i in range(50)], EMBEDDINGS)
    want = whitening.fit(whitening.grid(df))
    monkeypatch.setattr(whitening, "PAIRS", 4)
    got = whitening.fit(whitening.grid(df))
    assert np.abs(want.values - got.values).max() < 1e-9 * want.trace and got.sums == want.sums
