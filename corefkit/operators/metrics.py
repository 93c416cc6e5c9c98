"""Evaluation metrics (A1-A14) as single-pass aggregations.

Invalid predictions are NULL. Every metric says how it treats them:
``confusion`` and the reports skip them (they match no cell), ``accuracy_
invalid_as_wrong`` counts them as errors, ``evaluate_with_invalid`` reports
their count and rate next to a report over the valid rows.

All functions take ``by`` (grouping columns) so one job scores many runs or
sources at once; the aggregation is partial per task and final per group,
so no group is ever collected in one place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corefkit.functions.text import eps_div, safe_div

EPS = 1e-10

# Class names and section names of the reference's reports.
CLASS_NAMES = ("Not Coreferent", "Coreferent")
MACRO = "macro avg"
WEIGHTED = "weighted avg"


def _cnt(cond: Column) -> Column:
    return F.count_if(cond)


def confusion(df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """A4/A5 tn, fp, fn, tp in one aggregate (NULL predictions match no cell)."""
    lab, prd = F.col(label), F.col(pred)
    g = df.groupBy(*by)
    return g.agg(
        _cnt((lab == 0) & (prd == 0)).alias("tn"),
        _cnt((lab == 0) & (prd == 1)).alias("fp"),
        _cnt((lab == 1) & (prd == 0)).alias("fn"),
        _cnt((lab == 1) & (prd == 1)).alias("tp"),
    )


def matrix(df: DataFrame) -> Column:
    """``[[tn, fp], [fn, tp]]`` from a confusion row."""
    return F.array(F.array("tn", "fp"), F.array("fn", "tp"))


def binary_eps(counts: DataFrame) -> DataFrame:
    """A6 precision/recall/F1 with 1e-10 in the denominators; accuracy without."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    p = eps_div(tp, tp + fp, EPS)
    r = eps_div(tp, tp + fn, EPS)
    out = counts.withColumns({"precision": p, "recall": r})
    out = out.withColumn("f1", F.lit(2.0) * (F.col("precision") * F.col("recall"))
                         / (F.col("precision") + F.col("recall") + F.lit(EPS)))
    return out.withColumn("accuracy", F.try_divide((tp + tn).cast("double"), (tp + tn + fp + fn).cast("double")))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, F.lit(2.0) * (p * r) / (p + r)).otherwise(F.lit(0.0))


def report_columns(counts: DataFrame, total: Column | None = None) -> DataFrame:
    """A8/A14 the classification-report values as columns of the count row.

    Zero denominators give 0. ``total`` defaults to tn+fp+fn+tp.
    """
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    tot = total if total is not None else (tn + fp + fn + tp)
    out = counts.withColumns({
        "support0": (tn + fp).cast("double"),
        "support1": (fn + tp).cast("double"),
        "total": tot.cast("double"),
        "precision0": safe_div(tn, tn + fn),
        "recall0": safe_div(tn, tn + fp),
        "precision1": safe_div(tp, tp + fp),
        "recall1": safe_div(tp, tp + fn),
    })
    out = out.withColumns({
        "f1_0": _f1(F.col("precision0"), F.col("recall0")),
        "f1_1": _f1(F.col("precision1"), F.col("recall1")),
        "accuracy": F.try_divide((tp + tn).cast("double"), F.col("total")),
    })
    for m, a, b in (("precision", "precision0", "precision1"), ("recall", "recall0", "recall1"),
                    ("f1", "f1_0", "f1_1")):
        out = out.withColumn(f"macro_{m}", (F.col(a) + F.col(b)) / F.lit(2.0))
        out = out.withColumn(f"weighted_{m}", F.try_divide(
            F.col(a) * F.col("support0") + F.col(b) * F.col("support1"), F.col("total")))
    return out


def report_long(counts: DataFrame, by: Sequence[str] = (), total: Column | None = None) -> DataFrame:
    """A8 the report as rows ``(section, metric, value)``."""
    r = report_columns(counts, total)

    def item(section: str, metric: str, col: str) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(metric).alias("metric"),
                        F.col(col).cast("double").alias("value"))

    items = []
    for section, suffix in ((CLASS_NAMES[0], "0"), (CLASS_NAMES[1], "1")):
        items += [item(section, "precision", f"precision{suffix}"), item(section, "recall", f"recall{suffix}"),
                  item(section, "f1-score", f"f1_{suffix}"), item(section, "support", f"support{suffix}")]
    items.append(item("accuracy", "accuracy", "accuracy"))
    for section, prefix in ((MACRO, "macro"), (WEIGHTED, "weighted")):
        items += [item(section, "precision", f"{prefix}_precision"), item(section, "recall", f"{prefix}_recall"),
                  item(section, "f1-score", f"{prefix}_f1"), item(section, "support", "total")]
    return r.select(*by, F.inline(F.array(*items)))


def report_struct(counts: DataFrame) -> Column:
    """A8 the nested report struct of the reference's JSON documents."""

    def cls(p: str, r: str, f: str, s: str) -> Column:
        return F.struct(F.col(p).alias("precision"), F.col(r).alias("recall"),
                        F.col(f).alias("f1-score"), F.col(s).alias("support"))

    return F.struct(
        cls("precision0", "recall0", "f1_0", "support0").alias(CLASS_NAMES[0]),
        cls("precision1", "recall1", "f1_1", "support1").alias(CLASS_NAMES[1]),
        F.col("accuracy").alias("accuracy"),
        cls("macro_precision", "macro_recall", "macro_f1", "total").alias(MACRO),
        cls("weighted_precision", "weighted_recall", "weighted_f1", "total").alias(WEIGHTED),
    )


def balanced_accuracy(counts: DataFrame) -> DataFrame:
    """A9 specificity and (recall + specificity) / 2."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = counts.withColumns({"recall": safe_div(tp, tp + fn), "specificity": safe_div(tn, tn + fp)})
    return out.withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / F.lit(2.0))


def encoder_eval(df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """A10 the training-time metric row: accuracy, class-1 P/R/F1, A9, A5."""
    c = confusion(df, label, pred, by)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    c = balanced_accuracy(c)
    c = c.withColumns({
        "accuracy": F.try_divide((tp + tn).cast("double"), (tp + tn + fp + fn).cast("double")),
        "precision_class1": safe_div(tp, tp + fp),
        "recall_class1": F.col("recall"),
    })
    c = c.withColumn("f1_class1", _f1(F.col("precision_class1"), F.col("recall_class1")))
    return c.select(*by, "accuracy", "balanced_accuracy", "precision_class1", "recall_class1", "f1_class1",
                    "specificity", "tp", "fp", "tn", "fn")


def evaluate_with_invalid(df: DataFrame, label: str = "label", pred: str = "pred",
                          by: Sequence[str] = ()) -> DataFrame:
    """A11 counts, invalid count and rate, and the report over valid rows, in one aggregate."""
    lab, prd = F.col(label), F.col(pred)
    c = df.groupBy(*by).agg(
        _cnt((lab == 0) & (prd == 0)).alias("tn"),
        _cnt((lab == 0) & (prd == 1)).alias("fp"),
        _cnt((lab == 1) & (prd == 0)).alias("fn"),
        _cnt((lab == 1) & (prd == 1)).alias("tp"),
        _cnt(prd.isNull()).alias("invalid_count"),
        F.count(F.lit(1)).alias("total_samples"),
    )
    c = c.withColumn("invalid_rate", safe_div(F.col("invalid_count"), F.col("total_samples")))
    return report_columns(c)


def accuracy_invalid_as_wrong(df: DataFrame, label: str = "label", pred: str = "pred",
                              by: Sequence[str] = ()) -> DataFrame:
    """A12 accuracy with invalid counted wrong, and the invalid share."""
    n = F.count(F.lit(1)).cast("double")
    return df.groupBy(*by).agg(
        (_cnt(F.col(pred).isNotNull() & (F.col(label) == F.col(pred))).cast("double") / n).alias("accuracy"),
        (_cnt(F.col(pred).isNull()).cast("double") / n).alias("num_invalid"),
    )


def multiclass(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """A7/T9/U3 one-vs-rest counts and metrics for every class in labels or predictions.

    Each row is exploded to the distinct classes it touches plus one total
    marker, then one grouped aggregate gives every class at once (the
    reference rescans the data per class). Rows with a NULL label or
    prediction are left out.
    """
    lab, prd = F.col(label), F.col(pred)
    x = df.where(lab.isNotNull() & prd.isNotNull())
    per_class = F.transform(F.array_distinct(F.array(lab, prd)), lambda c: F.struct(
        c.alias("cls"), (lab == c).alias("is_true"), (prd == c).alias("is_pred"), F.lit(False).alias("is_all")))
    marker = F.array(F.struct(F.lit(None).cast(df.schema[label].dataType).alias("cls"), F.lit(False).alias("is_true"),
                              (lab == prd).alias("is_pred"), F.lit(True).alias("is_all")))
    e = x.select(F.inline(F.concat(per_class, marker)))
    g = e.groupBy("is_all", "cls").agg(
        _cnt(F.col("is_true") & F.col("is_pred")).alias("tp"),
        _cnt(~F.col("is_true") & F.col("is_pred")).alias("fp"),
        _cnt(F.col("is_true") & ~F.col("is_pred")).alias("fn"),
        F.count(F.lit(1)).alias("n"),
    )
    # The marker's row carries the totals to every class row as a scalar.
    totals = g.where("is_all").select(F.min(F.struct("n", "fp"))).scalar()
    g = g.where(~F.col("is_all")).withColumns({"n_total": totals["n"], "n_correct": totals["fp"]})
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    g = g.withColumn("tn", F.col("n_total") - tp - fp - fn)
    m = binary_eps(g)
    return m.select("cls", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "accuracy",
                    F.col("n_total").alias("total"), F.col("n_correct").alias("correct"))


def multiclass_macro(per_class: DataFrame) -> DataFrame:
    """A7 macro averages over classes and overall accuracy, unrounded."""
    return per_class.agg(
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        (F.max("correct").cast("double") / F.max("total").cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n_classes"),
    )


def dataset_stats(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A1/A2 distinct sentence1, sentence2 and both together.

    Each row is exploded once into its two sentences tagged by column, then
    one grouped aggregate (partial per task) dedups sentences: a single
    shuffle of 2N rows instead of three distinct aggregations. A sentence is
    told apart by its SHA-256, so that no text is shuffled.
    """
    e = df.select(*by, F.inline(F.array(
        F.struct(F.unhex(F.sha2("sentence1", 256)).alias("s"), F.lit(True).alias("in1"), F.lit(False).alias("in2")),
        F.struct(F.unhex(F.sha2("sentence2", 256)).alias("s"), F.lit(False).alias("in1"), F.lit(True).alias("in2")),
    )))
    per_sentence = e.where(F.col("s").isNotNull()).groupBy(*by, "s").agg(
        F.bool_or("in1").alias("in1"), F.bool_or("in2").alias("in2"))
    return per_sentence.groupBy(*by).agg(
        _cnt(F.col("in1")).alias("unique_sentence1"),
        _cnt(F.col("in2")).alias("unique_sentence2"),
        F.count(F.lit(1)).alias("unique_sentences"),
    )


def label_distribution(df: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """A3 ``value_counts`` of the label (display order: count descending)."""
    return df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("count"))


def custom(df: DataFrame, metrics: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """UD3 user metrics: a mapping of aggregate columns evaluated in one ``agg``."""
    return df.groupBy(*by).agg(*[c.alias(k) for k, c in metrics.items()])
