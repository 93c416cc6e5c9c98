"""Encoder inputs for a text pair.

The default tokenizer is whitespace words with md5-hashed ids, entirely
JVM-side. ``[CLS] a [SEP] b [SEP]`` is truncated to ``max_len`` (the longer
side gives way first) and padded with an attention mask. A real sub-word
tokenizer can be plugged in with ``encode_with`` (a pandas UDF over Arrow
batches).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

from corefkit.functions.text import _c, hash_int, let, words
from corefkit.operators.workers import once_per_worker

PAD_ID, CLS_ID, SEP_ID = 0, 1, 2
N_SPECIAL = 3
VOCAB_SIZE = 30_000
MAX_LEN = 512


def token_ids(text) -> Column:
    """Word ids in ``[3, VOCAB_SIZE)``: md5 of the word, modulo the vocabulary."""
    return F.transform(words(text), lambda w: (hash_int(w) % (VOCAB_SIZE - N_SPECIAL) + N_SPECIAL).cast("int"))


def pair_budget(n1: Column, n2: Column, max_len: int) -> tuple[Column, Column]:
    """Tokens kept from each side: the shorter keeps ``min(len, B // 2)``, the
    other takes the rest of ``B = max_len - 3``."""
    b = max_len - N_SPECIAL
    fits = n1 + n2 <= b
    half = F.lit(b // 2)
    k1 = F.when(fits, n1).when(n1 <= n2, F.least(n1, half)).otherwise(F.lit(b) - F.least(n2, half))
    k2 = F.when(fits, n2).when(n1 <= n2, F.lit(b) - F.least(n1, half)).otherwise(F.least(n2, half))
    return k1, k2


def encode_ids(ids_a: Column, ids_b: Column, max_len: int = MAX_LEN) -> tuple[Column, Column]:
    """``input_ids`` and ``attention_mask`` of length ``max_len``."""
    k1, k2 = pair_budget(F.size(ids_a), F.size(ids_b), max_len)
    seq = F.concat(F.array(F.lit(CLS_ID)), F.slice(ids_a, 1, k1), F.array(F.lit(SEP_ID)),
                   F.slice(ids_b, 1, k2), F.array(F.lit(SEP_ID)))
    used = F.size(seq)
    pad = F.array_repeat(F.lit(PAD_ID), F.lit(max_len) - used)
    input_ids = F.concat(seq, pad)
    mask = F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(max_len) - used))
    return input_ids, mask


def encode_pairs(df: DataFrame, text_a: str = "text_a", text_b: str = "text_b", label: str = "label",
                 max_len: int = MAX_LEN) -> DataFrame:
    """M6 encode every pair (M7: run once over a table carrying a ``split`` column).

    Kept as plain column expressions: whole-stage codegen evaluates the
    repeated id arrays once (common subexpressions); binding them with
    ``let`` was measured slower here because it forces interpretation.
    """
    ids, mask = encode_ids(token_ids(F.col(text_a)), token_ids(F.col(text_b)), max_len)
    return df.withColumns({"input_ids": ids, "attention_mask": mask, "label": F.col(label).cast("int")})


def encode_with(df: DataFrame, tokenize: Callable, text_a: str = "text_a", text_b: str = "text_b",
                max_len: int = MAX_LEN) -> DataFrame:
    """M6 with a pluggable tokenizer ``tokenize(pd.Series) -> pd.Series[list[int]]``.

    The tokenizer runs in a pandas UDF (Arrow batches); truncation, special
    tokens and padding stay column expressions.
    """
    @pandas_udf(ArrayType(IntegerType()))
    def _tok(s: pd.Series) -> pd.Series:
        return tokenize(s)

    # The tokenizer runs once per text: its output is bound before the
    # budget, slices and padding read it several times.
    toks = df.withColumns({"_ids_a": _tok(F.col(text_a)), "_ids_b": _tok(F.col(text_b))})
    ids, mask = encode_ids(F.col("_ids_a"), F.col("_ids_b"), max_len)
    return toks.withColumns({"input_ids": ids, "attention_mask": mask}).drop("_ids_a", "_ids_b")


def subword_tokenizer(model_json: str) -> Callable:
    """A tokenizer for :func:`encode_with` from the JSON text of a ``tokenizers`` model.

    The text travels with the function and each Python worker builds the tokenizer once. No
    special tokens are added; strings that look like them are ordinary text.
    """
    def make():
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(model_json)
        tokenizer.encode_special_tokens = True
        return tokenizer

    tokenizer_of = once_per_worker(make)

    def tokenize(texts: pd.Series) -> pd.Series:
        found = tokenizer_of().encode_batch_fast(texts.fillna("").tolist(), add_special_tokens=False)
        return pd.Series([x.ids for x in found], index=texts.index)

    return tokenize


def within_budget(text, max_tokens: int) -> Column:
    """M13 ``len(tokens) <= max_tokens`` with the default tokenizer."""
    return F.size(words(_c(text))) <= max_tokens


def truncate_tokens(text, max_tokens: int) -> Column:
    """M13 the text cut to its first ``max_tokens`` words (joined by one blank)."""
    return F.array_join(F.slice(words(_c(text)), 1, max_tokens), " ")


def budget(text, max_tokens: int, keep: int | None = None) -> Column:
    """M13 in one pass: ``struct(n_tokens, fits, head)`` with the text split once."""
    k = max_tokens if keep is None else keep
    return let(words(_c(text)), lambda w: F.struct(
        F.size(w).alias("n_tokens"), (F.size(w) <= max_tokens).alias("fits"),
        F.array_join(F.slice(w, 1, k), " ").alias("head")))
