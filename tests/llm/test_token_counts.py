import random

import public_tokenizers as P
import pytest
import sentencepiece

from corefkit.llm import token_counts as op
from tests.llm.conftest import ordered, pairs


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.path(op.MODEL_FILE))


@pytest.fixture(scope="module")
def tokenizer():
    with open(P.path(op.MODEL_FILE), "rb") as f:
        return op.Tokenizer(f.read())


def spliced(tokenizer, text, chunk, overlap):
    """Counts by chunks, or None where a seam does not align."""
    pieces = op.cut(text, chunk, overlap)
    last = len(pieces) - 1
    parts = [tokenizer.chunk(p, overlap if k else 0, overlap if k < last else 0) for k, p in enumerate(pieces)]
    twice = [op.surplus(a[2], b[1]) for a, b in zip(parts, parts[1:])]
    return None if None in twice else sum(p[0] for p in parts) - sum(twice)


def test_aligned_seams_give_the_count_of_the_whole(tokenizer, library):
    rng = random.Random(4)
    aligned = 0
    for kind in ["ab", "a b", "the andin ", "aé漢😀 \n<s>", "==-- \t\n", "aaaaab", "▁ a", "0123 .,"]:
        for _ in range(150):
            text = "".join(rng.choice(kind) for _ in range(rng.randrange(20, 600)))
            chunk = rng.choice([16, 24, 50])
            got = spliced(tokenizer, text, chunk, rng.choice([4, 8, chunk]))
            if got is not None:
                aligned += 1
                assert got == len(library.encode(text)), text
    assert aligned > 500


def test_misaligned_runs_are_found(tokenizer):
    assert spliced(tokenizer, "a" * 999, 101, 8) is None


def test_cut_covers_the_text():
    text = "".join(chr(97 + k % 26) for k in range(1000))
    for chunk, overlap in [(10, 3), (64, 64), (999, 5), (1000, 1), (5000, 7)]:
        pieces = op.cut(text, chunk, overlap)
        assert "".join(p[:chunk] for p in pieces[:-1]) + pieces[-1] == text
        assert all(len(p) >= chunk for p in pieces) or len(pieces) == 1


@pytest.mark.parametrize("chunk, overlap", [(op.CHUNK, op.OVERLAP), (64, 8)])
def test_documents(docs, rows, library, chunk, overlap, spark):
    more = [(900 + k, t) for k, t in enumerate(["<s> </s> <unk>", "q" * 7001, "ab" * 2000 + " c" * 900, " " * 5000, "\x00a " * 90, "漢" * 3000])]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = op.count_tokens(both, P.path(op.MODEL_FILE), token_limit=300, chunk=chunk, overlap=overlap)
    want = []
    for i, t in pairs(rows) + more:
        n = len(library.encode(t or ""))
        want.append((i, len((t or "").encode()), n, n > 300))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert ordered(got.collect()) == ordered(want)


def test_clashing_columns(spark, library):
    docs = spark.createDataFrame([(1, "a b " * 100, 5, "x")], "doc_id long, text string, row long, n_tokens string")
    assert op.count_tokens(docs, P.path(op.MODEL_FILE), chunk=32, overlap=8).first().n_tokens == len(library.encode("a b " * 100))


def test_empty_table(no_docs):
    assert op.count_tokens(no_docs, P.path(op.MODEL_FILE)).count() == 0
