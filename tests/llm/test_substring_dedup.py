import hashlib
from collections import Counter

import numpy as np
import pytest

from corefkit.llm import substring_dedup as op
from tests.llm.conftest import ordered, pairs


def brute(rows, window):
    split = [(i, (t or "").encode().split()) for i, t in pairs(rows)]
    seen = Counter(tuple(w[k:k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k:k + window])] > 1:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return ordered(out)


@pytest.mark.parametrize("window", [5, 35])
def test_equals_brute_force(docs, rows, window):
    got = op.cut_repeats(docs, window, batch_bytes=20_000)
    assert ordered(got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == brute(rows, window)
    for r in got.collect():
        assert sum(b - a for a, b in r.spans) == r.n_removed
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_repeats_inside_one_document(spark):
    text = "a b c d e " * 4 + "tail"
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert op.cut_repeats(one, 5).first().n_removed == 20


def test_empty_table(no_docs):
    assert op.cut_repeats(no_docs).count() == 0


def test_rolling_hash_depends_on_order_and_not_on_place():
    words = op.word_hashes([b"a", b"b", b"c", b"a", b"b", b"c", b"b"])
    h = op.rolling(words, 3, op.BASES[0])
    assert h[0] == h[3] and len(set(h.tolist())) == len(h) - 1


def test_merged():
    assert op.merged(np.array([0, 1, 4, 20]), 5) == [(0, 9), (20, 25)]
    assert op.merged(np.array([0, 5]), 5) == [(0, 10)]
