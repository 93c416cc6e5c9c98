"""Metrics against the published reports (golden vectors) and invariants."""

import json
import os

import pytest
from pyspark.sql import functions as F

from corefkit.operators import metrics as M

GOLDEN = json.load(open(os.path.join(os.path.dirname(__file__), "golden", "reports.json")))


def _rows_from_counts(spark, tn, fp, fn, tp, invalid=0):
    cells = [(0, 0, tn), (0, 1, fp), (1, 0, fn), (1, 1, tp), (1, None, invalid)]
    base = spark.createDataFrame(cells, "label int, pred int, n long")
    return base.select("label", "pred", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k")).where("n > 0")


@pytest.mark.parametrize("case", GOLDEN, ids=lambda c: f"tp{c['tp']}")
def test_report_matches_published(spark, case):
    df = _rows_from_counts(spark, case["tn"], case["fp"], case["fn"], case["tp"])
    r = M.report_columns(M.confusion(df)).first()
    rep = case["report"]
    checks = {
        ("Not Coreferent", "precision"): r.precision0, ("Not Coreferent", "recall"): r.recall0,
        ("Not Coreferent", "f1-score"): r.f1_0, ("Not Coreferent", "support"): r.support0,
        ("Coreferent", "precision"): r.precision1, ("Coreferent", "recall"): r.recall1,
        ("Coreferent", "f1-score"): r.f1_1, ("Coreferent", "support"): r.support1,
        ("macro avg", "precision"): r.macro_precision, ("macro avg", "f1-score"): r.macro_f1,
        ("weighted avg", "recall"): r.weighted_recall, ("weighted avg", "f1-score"): r.weighted_f1,
    }
    for (section, metric), got in checks.items():
        assert got == pytest.approx(rep[section][metric], abs=1e-12), (section, metric)
    assert r.accuracy == pytest.approx(rep["accuracy"], abs=1e-12)


def test_invalid_accounting(spark):
    case = next(c for c in GOLDEN if c.get("invalid_count"))
    df = _rows_from_counts(spark, case["tn"], case["fp"], case["fn"], case["tp"], case["invalid_count"])
    r = M.evaluate_with_invalid(df).first()
    assert r.total_samples == case["total_samples"]
    assert r.tn + r.fp + r.fn + r.tp + r.invalid_count == r.total_samples
    assert r.invalid_rate == pytest.approx(case["invalid_count"] / case["total_samples"], abs=1e-15)
    w = M.accuracy_invalid_as_wrong(df).first()
    assert w.accuracy == pytest.approx((r.tp + r.tn) / r.total_samples)


def test_multiclass_equals_per_class_binary(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("b", "c"), ("c", "c"), ("a", "a")]
    df = spark.createDataFrame(rows, "label string, pred string")
    got = {r.cls: r for r in M.multiclass(df).collect()}
    assert set(got) == {"a", "b", "c"}
    for c, r in got.items():
        tp = sum(1 for t, p in rows if t == c and p == c)
        fp = sum(1 for t, p in rows if t != c and p == c)
        fn = sum(1 for t, p in rows if t == c and p != c)
        assert (r.tp, r.fp, r.fn, r.tn) == (tp, fp, fn, len(rows) - tp - fp - fn)
        assert r.precision == pytest.approx(tp / (tp + fp + 1e-10))
    macro = M.multiclass_macro(M.multiclass(df)).first()
    assert macro.accuracy == pytest.approx(4 / 7)


def test_dataset_stats(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "a"), (None, "a")], "sentence1 string, sentence2 string")
    r = M.dataset_stats(df).first()
    assert (r.unique_sentence1, r.unique_sentence2, r.unique_sentences) == (2, 3, 3)
