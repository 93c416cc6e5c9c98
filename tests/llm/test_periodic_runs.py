import functools
import hashlib
import random
import zlib

import numpy as np
import pytest

from corefkit.llm import periodic_runs as op
from tests.llm.conftest import ordered, pairs


@functools.cache
def brute_runs(words):
    """(start, length, period) of all runs, period by period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            length = e - s + q
            if e > s and length >= max(6, 4 * q):
                found.setdefault((s, length), q)  # the smallest comes first
            s = e + 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def row_of(doc_id, words):
    runs = brute_runs(tuple(words))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def edited(doc_id, words):
    """The contract's edit, word by word."""
    n = len(words)
    if doc_id is None or not n or zlib.crc32(str(doc_id).encode()) % 10:
        return words
    g = zlib.crc32(str(doc_id).encode()) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def texts():
    """Words with runs of many lengths, exponents just below and above the limit, nested and touching ones."""
    rng = random.Random(7)
    out = ["a " * 400, "a b " * 90, "a a b " * 50, "a " * 5, "a " * 6, "a b a b a b a", "a b a b a b a b", "x a a a a a a b b b b b b y",
           ("a " * 7 + "b ") * 40]
    for _ in range(60):
        words = []
        while len(words) < rng.choice([10, 60, 300, 700]):
            if rng.random() < 0.6:
                words += [f"n{rng.randrange(50)}" for _ in range(rng.randrange(6))]
            q = rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 33, 64])
            unit = [rng.choice("abc") for _ in range(q)]
            words += (unit * 12)[:rng.randrange(2 * q, 7 * q + 2)]
        out.append(" ".join(words))
    fib = ["a", "a b"]
    while len(fib) < 14:
        fib.append(f"{fib[-1]} {fib[-2]}")
    return out + [fib[-1], " ".join(rng.choice("ab") for _ in range(1500))]


def test_z_function():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.randrange(2) for _ in range(rng.randrange(1, 40))]
        want = [0] + [next((k for k in range(len(s) - i) if s[i + k] != s[k]), len(s) - i) for i in range(1, len(s))]
        assert op.z_function(s, len(s)) == want


def test_solve_tile():
    rng = random.Random(2)
    for octave in [1, 2, 4, 8]:
        for _ in range(100):
            words = [rng.randrange(2) for _ in range(rng.randrange(octave + 1, 4 * octave + 1))]
            at = octave if len(words) > 2 * octave else 0
            periods, back, ahead = op.solve_tile(words[:at + 3 * octave], at, octave)
            for q, b, f in zip(periods.tolist(), back.tolist(), ahead.tolist()):
                same = lambda i: 0 <= i and i + q < len(words) and words[i] == words[i + q]
                assert f == next((k for k in range(octave) if not same(at + k)), octave)
                assert b == next((k for k in range(octave) if not same(at - 1 - k)), octave)


@pytest.mark.parametrize("split", [16, 32, 128])
def test_slices_together_give_the_fragments_of_the_whole(split):
    for text in texts():
        words = text.encode().split()
        whole = op.stretch_fragments(words, 0, op.octaves_of(len(words)), 0, len(words))
        parts = [op.stretch_fragments(words[low:high], low, octaves, first, last)
                 for low, high, octaves, first, last in op.slices(len(words), split)]
        together = op.joined(np.concatenate(parts, axis=1)) if parts else np.zeros((3, 0))
        assert together.tolist() == whole.tolist()


@pytest.mark.parametrize("split", [16, 64, op.SPLIT])
def test_equals_brute_force(spark, docs, rows, split):
    more = [(500 + k, t) for k, t in enumerate(texts())] + [(500, texts()[0])]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = op.find_runs(both, split=split, with_text=False)
    assert ordered(got.collect()) == ordered(row_of(i, (t or "").encode().split()) for i, t in pairs(rows) + more)


def test_query_edit(docs, rows):
    got = op.find_runs(docs, split=64, with_text=False, edit=op.planted)
    want = [row_of(i, edited(i, (t or "").encode().split())) for i, t in pairs(rows)]
    assert ordered(got.collect()) == ordered(want)
    assert sum(r[1] for r in want) > 3


def test_texts_and_runs(docs, rows):
    plain = op.find_runs(docs, split=64, with_text=False)
    full = op.find_runs(docs, split=64, with_text=True)
    assert ordered(full.select(*plain.columns).collect()) == ordered(plain.collect())
    for r in full.collect():
        assert hashlib.sha256(r.collapsed_text.encode()).hexdigest() == r.collapsed_sha256
        listed = "".join(f"{x.start},{x.length},{x.period}\n" for x in r.runs)
        assert hashlib.sha256(listed.encode()).hexdigest() == r.runs_sha256


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a " * 9, 3, "x")], "doc_id long, text string, row long, words string")
    assert op.find_runs(docs).first().length == 9


def test_empty_table(no_docs):
    assert op.find_runs(no_docs).count() == 0
    assert op.find_runs(no_docs, with_text=False).count() == 0
