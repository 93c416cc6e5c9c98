import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from corefkit.llm import bpe as op
from tests.llm.conftest import ordered, pairs


@pytest.fixture(scope="module")
def data():
    with open(P.path(op.RANK_FILE), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def reference(data):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(data):
    return op.Encoder(op.read_ranks(data), P.PATTERN)


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


def test_random_texts(encoder, reference):
    rng = random.Random(2)
    for _ in range(2000):
        text = "".join(rng.choice("aabeth  \n\t'stréßeñ漢😀012!?-\x1c\x85　") for _ in range(rng.randrange(60)))
        assert ids(encoder, text) == reference.encode_ordinary(text)
        assert encoder.decode(encoder.encode(text)) == text.encode()


def test_every_kind_of_character(encoder, reference):
    for c in [*range(0x3100), *range(0xA000, 0xD800, 7), *range(0xE000, 0x20000, 11)]:
        text = f"a{chr(c)}{chr(c)}1 {chr(c)}"
        assert ids(encoder, text) == reference.encode_ordinary(text), hex(c)


@pytest.mark.parametrize("text", ["a" * 60_000, "abcab" * 9_000, " " * 30_000 + "x", "é" * 20_000, "=-" * 20_000])
def test_very_long_pretokens(encoder, reference, text):
    assert ids(encoder, text) == reference.encode_ordinary(text)


def test_small_cache_gives_the_same(data, reference, monkeypatch):
    monkeypatch.setattr(op, "CACHE_ENTRIES", 3)
    small = op.Encoder(op.read_ranks(data), P.PATTERN)
    text = " ".join(f"word{k % 7} other{k % 5}" for k in range(100))
    assert ids(small, text) == reference.encode_ordinary(text)


def test_documents(docs, rows, reference, monkeypatch):
    monkeypatch.setattr(op, "OUT_TOKENS", 500)
    got = op.production(docs, with_ids=True)
    want = []
    for i, t in pairs(rows):
        x = np.array(reference.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((i, len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), x))
    assert ordered((*r[:4], bytes(r.ids)) for r in got.collect()) == ordered(want)


def test_empty_table(no_docs):
    assert op.production(no_docs, with_ids=False).count() == 0
