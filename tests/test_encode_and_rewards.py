"""Pluggable parts: a real sub-word tokenizer in the encoder inputs, a user's own rewards."""

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corefkit.functions import rewards as R
from corefkit.operators import encode as E
from corefkit.operators import prompts as P
from corefkit.plans import fixtures as fx
from tests.conftest import SF_SMALL


def test_subword_inputs_equal_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    pairs = P.encoder_text(fx.splits(spark, SF_SMALL)).where("pair_id % 7 = 0")
    max_len, n = 64, 0
    with open(path, encoding="utf-8") as f:
        got = E.encode_with(pairs, E.subword_tokenizer(f.read()), max_len=max_len)
    for r in got.select("text_a", "text_b", "input_ids", "attention_mask").collect():
        a, b = (library.encode(t, add_special_tokens=False).ids for t in (r.text_a, r.text_b))
        room = max_len - 3
        if len(a) + len(b) > room:
            # the shorter keeps its tokens up to half of the room, the other takes the rest
            if len(a) <= len(b):
                a = a[: room // 2]
                b = b[: room - len(a)]
            else:
                b = b[: room // 2]
                a = a[: room - len(b)]
        ids = [E.CLS_ID, *a, E.SEP_ID, *b, E.SEP_ID]
        assert r.input_ids == ids + [E.PAD_ID] * (max_len - len(ids))
        assert r.attention_mask == [1] * len(ids) + [0] * (max_len - len(ids))
        n += 1
    assert n > 50


def test_subword_tokenizer_takes_nulls_and_special_strings(spark):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenize = E.subword_tokenizer(f.read())
    df = spark.createDataFrame([("a <|endoftext|> b", None), ("", "x")], "text_a string, text_b string")
    rows = E.encode_with(df, tokenize, max_len=32).collect()
    assert 50256 not in rows[0].input_ids and sum(rows[0].attention_mask) > 5
    assert rows[1].input_ids[:2] == [E.CLS_ID, E.SEP_ID]


def test_own_rewards_are_added(spark):
    df = spark.createDataFrame([("yes maybe", "Yes"), ("<answer>Yes</answer>", "Yes")], "completion string, answer string")
    own = ("length", lambda comp, ans: F.length(comp).cast("double"))
    plain = R.score(df).orderBy("completion").collect()
    more = R.score(df, extra=[own]).orderBy("completion").collect()
    for a, b in zip(plain, more):
        assert b.reward_length == len(b.completion) and b.reward == a.reward + b.reward_length
    only = R.score(df, rewards=dict([own]))
    assert only.columns == ["completion", "answer", "reward_length", "reward"]
