"""The two trained operators: held-out accuracy, their methods, and the odd rows."""
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corefkit.llm import quality_fm, toxicity
from tests.llm.conftest import SCHEMA

SF = "/root/testdata/sf0.1"


def held_out_scores(spark, query, label):
    scored = query(spark, SF).where("held_out")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return scored.join(labels, "doc_id").select(F.col(label).alias("y"), "score", "predicted").toPandas()


def auc(y, score):
    order = score.rank()
    pos = y == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize("query,label,least", [(quality_fm.query, "quality", 0.98), (toxicity.query, "toxic", 0.93)])
def test_held_out_accuracy(spark, query, label, least):
    got = held_out_scores(spark, query, label)
    assert auc(got.y, got.score) > least
    assert (got.y == got.predicted).mean() > 0.96


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    size = len(quality_fm.STATISTICS)
    d = quality_fm.BUCKETS + size
    m = quality_fm.Machine(0.3, rng.normal(size=d), rng.normal(size=(d, 3)) / 3, np.zeros(size), np.ones(size))
    words, stats = [[3, 9, 400], [], [7]], rng.normal(size=(3, size))
    for k, score in enumerate(m.scores(words, stats)):
        x = np.zeros(d)
        x[words[k]] = 1 / math.sqrt(max(1, len(words[k])))
        x[quality_fm.BUCKETS:] = m.dense(stats)[k]
        y = 0.3 + m.linear @ x + sum(m.factors[i] @ m.factors[j] * x[i] * x[j]
                                     for i, j in itertools.combinations(np.flatnonzero(x), 2))
        assert score == pytest.approx(1 / (1 + math.exp(-y)))


@pytest.mark.parametrize("module,label", [(quality_fm, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, docs, rows, no_docs, module, label):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(40)] + [(3, None, None), (None, 1, 1), (4, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    model = module.fit(docs, labels)
    got = module.score_documents(docs, model)
    assert got.count() == len(rows)
    assert got.where("score is null or score < 0 or score > 1 or predicted is null or held_out is null").count() == 0
    # equal texts have equal scores, whatever the other columns hold
    empty = {r.score for r in got.join(docs.where("coalesce(text, '') = ''").select("doc_id"), "doc_id").collect() if r.doc_id is not None}
    assert len(empty) == 1
    assert module.score_documents(no_docs, model).count() == 0
    for few in (labels.where("doc_id < 0"), labels.where(f"{label} = 1"), labels.where(f"{label} = 0")):
        assert module.score_documents(docs, module.fit(docs, few)).count() == len(rows)


def test_held_out_rows_teach_nothing(spark):
    import zlib

    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    docs = spark.createDataFrame([(k, "you are a zorgblat today" if k % 2 else "a fine day") for k in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in ids], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels).lexicon == {}


def test_grammar_tells_matches_apart():
    machine = toxicity.grammar()

    def read(symbols):
        state, out = 0, ""
        for s in symbols:
            state, o = machine.step(state, s)
            out += o
        return out

    assert read("OIO") == "OIO"
    assert read("TOI") == "OOJ"  # bound to a target
    assert read("IOT") == "IOB"  # the target comes after
    assert read("NOI") == "OOi"  # negated
    assert read("NOOOI") == "OOOOI"  # out of scope
    assert read("ROI") == "OOq"  # reported
    assert read("R.I") == "O.I"  # another clause
    assert read("TH") == "OK" and read("NH") == "Oh"


def test_composition_equals_running_one_after_the_other():
    import random

    rng = random.Random(1)
    parts, whole = [toxicity.negation(), toxicity.reported(), toxicity.target()], toxicity.grammar()
    for _ in range(300):
        text = [rng.choice("IHTNRO.") for _ in range(20)]
        states, one, state, two = [p.start for p in parts], [], whole.start, []
        for s in text:
            x = s
            for k, p in enumerate(parts):
                states[k], x = p.step(states[k], x)
            one.append(x)
            state, y = whole.step(state, s)
            two.append(y)
        assert one == two


def test_copies_do_not_make_insults(spark):
    """Words of one toxic text that was copied often have one surrounding, so they are no pattern."""
    def name(k):
        return "w" + "".join(chr(97 + int(c)) for c in str(k))

    copied = "alpha beta gamma delta zorgblat " * 3
    texts = [(k, copied, 1) for k in range(60)]
    texts += [(100 + k, f"{name(k)} zorgblat and {name(k + 1)} other", 1) for k in range(60)]
    texts += [(300 + k, f"{name(k)} calm and {name(k + 1)} other", 0) for k in range(200)]
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(t[0], t[2]) for t in texts], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels).lexicon
    assert "zorgblat" in lexicon and "alpha" not in lexicon and "gamma" not in lexicon


def test_only_attacks_make_a_strong_clause():
    m = toxicity.Matcher({"idiot": 2.0})
    plain, negated, told = (m.features(t)[-1] for t in ("you are an idiot", "you are not an idiot", "she said you idiot"))
    assert plain > 0 and negated == 0 and told == 0


def test_repeated_labelled_ids_give_one_row_each(spark):
    from corefkit.llm.common import labelled_sample

    docs = spark.createDataFrame([(i, f"t{k}") for i in range(40) for k in range(5)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2, "doc_id long, toxic int")
    rows, _ = labelled_sample(docs, labels, "toxic", {1: 1000, 0: 1000})
    got = rows.collect()
    assert len(got) == len({r.doc_id for r in got}) and {r.text for r in got} == {"t0"}


def test_the_fit_reaches_its_minimum_where_full_steps_bounce():
    g, n = np.random.default_rng(5), 300
    y = (np.arange(n) % 3 == 0).astype(float)
    hits = np.where(y > 0, g.integers(1, 40, n), g.random(n) < 0.03)
    all_hits, most = np.log1p(8.0 * hits), np.log1p(8.0 * np.minimum(hits, g.integers(1, 4, n)))
    x, weight = np.column_stack([all_hits, np.where(g.random(n) < 0.5, all_hits, 0), most]), np.where(y > 0, 2.8, 12.3)
    w = toxicity.fit_logistic(x, y, weight)
    z = x @ w[:-1] + w[-1]
    gradient = x.T @ (weight * (1 / (1 + np.exp(-z)) - y)) + 0.1 * w[:-1]
    assert np.abs(gradient).max() < 0.01
    assert ((z > 0) == (y > 0)).mean() > 0.95
