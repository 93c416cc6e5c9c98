"""Registered evaluation queries: parsing-to-metrics (A4-A14, J2, P7, UD3, E3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corefkit.functions.parse import yes_else_no
from corefkit.functions.vectors import argmax
from corefkit.operators import metrics as M
from corefkit.operators.joins import align
from corefkit.plans import fixtures as fx
from corefkit.plans.oracle_ctes import oracle
from corefkit.registry import register

COUNTS_SQL = """SELECT {by}count(*) FILTER (WHERE label = 0 AND pred = 0) tn,
       count(*) FILTER (WHERE label = 0 AND pred = 1) fp,
       count(*) FILTER (WHERE label = 1 AND pred = 0) fn,
       count(*) FILTER (WHERE label = 1 AND pred = 1) tp"""


def counts_sql(src: str, by: str = "", extra: str = "") -> str:
    b = f"{by}, " if by else ""
    g = f" GROUP BY {by}" if by else ""
    return COUNTS_SQL.format(by=b) + extra + f" FROM {src}{g}"


def safe(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"


def f1(p: str, r: str) -> str:
    return f"(CASE WHEN {p} + {r} > 0 THEN CAST(2 AS DOUBLE) * ({p} * {r}) / ({p} + {r}) ELSE CAST(0 AS DOUBLE) END)"


def report_ctes(counts: str, by: str = "", total: str | None = None) -> list[str]:
    """CTEs ``rc0``/``rc`` with the report columns of ``counts``."""
    tot = total or "tn + fp + fn + tp"
    rc0 = f"""rc0 AS (SELECT *, CAST(tn + fp AS DOUBLE) support0, CAST(fn + tp AS DOUBLE) support1,
        CAST({tot} AS DOUBLE) total,
        {safe('tn', 'tn + fn')} precision0, {safe('tn', 'tn + fp')} recall0,
        {safe('tp', 'tp + fp')} precision1, {safe('tp', 'tp + fn')} recall1 FROM {counts})"""
    rc = f"""rc AS (SELECT *, {f1('precision0', 'recall0')} f1_0, {f1('precision1', 'recall1')} f1_1,
        CASE WHEN total = 0 THEN NULL ELSE CAST(tp + tn AS DOUBLE) / total END accuracy FROM rc0)"""
    rc2 = """rc2 AS (SELECT *,
        (precision0 + precision1) / CAST(2 AS DOUBLE) macro_precision,
        (recall0 + recall1) / CAST(2 AS DOUBLE) macro_recall,
        (f1_0 + f1_1) / CAST(2 AS DOUBLE) macro_f1,
        CASE WHEN total = 0 THEN NULL ELSE (precision0 * support0 + precision1 * support1) / total END weighted_precision,
        CASE WHEN total = 0 THEN NULL ELSE (recall0 * support0 + recall1 * support1) / total END weighted_recall,
        CASE WHEN total = 0 THEN NULL ELSE (f1_0 * support0 + f1_1 * support1) / total END weighted_f1 FROM rc)"""
    return [rc0, rc, rc2]


def report_long_sql(by: str = "") -> str:
    b = f"{by}, " if by else ""
    rows = []
    for section, sfx in (("Not Coreferent", "0"), ("Coreferent", "1")):
        for metric, col in (("precision", f"precision{sfx}"), ("recall", f"recall{sfx}"),
                            ("f1-score", f"f1_{sfx}"), ("support", f"support{sfx}")):
            rows.append((section, metric, col))
    rows.append(("accuracy", "accuracy", "accuracy"))
    for section, pre in (("macro avg", "macro"), ("weighted avg", "weighted")):
        for metric, col in (("precision", f"{pre}_precision"), ("recall", f"{pre}_recall"),
                            ("f1-score", f"{pre}_f1"), ("support", "total")):
            rows.append((section, metric, col))
    return "\nUNION ALL ".join(
        f"SELECT {b}'{s}' AS section, '{m}' AS metric, CAST({c} AS DOUBLE) AS value FROM rc2" for s, m, c in rows)


# ---------------------------------------------------------------- A4 / A5

@register("confusion_matrix", oracle(
    "SELECT tn, fp, fn, tp, [[tn, fp], [fn, tp]] AS confusion_matrix FROM (" + counts_sql("preds") + ")"),
    "A4", "A5")
def q_confusion_matrix(spark, sf_dir):
    c = M.confusion(fx.preds(spark, sf_dir))
    return c.withColumn("confusion_matrix", M.matrix(c))


@register("confusion_by_group", oracle(counts_sql("preds", by="source")), "A4", "A5", "A4-A12 by=")
def q_confusion_by_group(spark, sf_dir):
    return M.confusion(fx.preds(spark, sf_dir), by=["source"])


# ---------------------------------------------------------------- A6

@register("binary_metrics_eps", oracle(
    """SELECT tn, fp, fn, tp, precision, recall,
        CAST(2 AS DOUBLE) * (precision * recall) / (precision + recall + 1e-10) AS f1,
        CASE WHEN tp + tn + fp + fn = 0 THEN NULL ELSE CAST(tp + tn AS DOUBLE) / CAST(tp + tn + fp + fn AS DOUBLE) END AS accuracy
    FROM (SELECT *, CAST(tp AS DOUBLE) / (CAST(tp + fp AS DOUBLE) + 1e-10) AS precision,
                 CAST(tp AS DOUBLE) / (CAST(tp + fn AS DOUBLE) + 1e-10) AS recall
          FROM (""" + counts_sql("preds") + "))"), "A6", "S20")
def q_binary_metrics_eps(spark, sf_dir):
    return M.binary_eps(M.confusion(fx.preds(spark, sf_dir)))


# ---------------------------------------------------------------- A7

_MC_CTES = [
    """mc_rows AS (SELECT label, pred FROM preds_multi WHERE label IS NOT NULL AND pred IS NOT NULL)""",
    """mc_cls AS (SELECT DISTINCT cls FROM (SELECT label cls FROM mc_rows UNION ALL SELECT pred FROM mc_rows))""",
    """mc_tot AS (SELECT count(*) n_total, count(*) FILTER (WHERE label = pred) n_correct FROM mc_rows)""",
    """mc_cnt AS (SELECT c.cls,
            count(*) FILTER (WHERE r.label = c.cls AND r.pred = c.cls) tp,
            count(*) FILTER (WHERE r.label <> c.cls AND r.pred = c.cls) fp,
            count(*) FILTER (WHERE r.label = c.cls AND r.pred <> c.cls) fn
        FROM mc_cls c JOIN mc_rows r ON r.label = c.cls OR r.pred = c.cls GROUP BY c.cls)""",
    """mc AS (SELECT cls, tp, fp, fn, n_total - tp - fp - fn tn, n_total total, n_correct correct,
            CAST(tp AS DOUBLE) / (CAST(tp + fp AS DOUBLE) + 1e-10) AS precision,
            CAST(tp AS DOUBLE) / (CAST(tp + fn AS DOUBLE) + 1e-10) recall
        FROM mc_cnt, mc_tot)""",
    """mc2 AS (SELECT cls, tp, fp, fn, tn, precision AS precision, recall AS recall,
            CAST(2 AS DOUBLE) * (precision * recall) / (precision + recall + 1e-10) f1,
            CAST(tp + tn AS DOUBLE) / CAST(tp + tn + fp + fn AS DOUBLE) accuracy, total, correct FROM mc)""",
]


@register("multiclass_metrics", oracle("SELECT * FROM mc2", *_MC_CTES), "A7", "T9", "U3")
def q_multiclass_metrics(spark, sf_dir):
    return M.multiclass(fx.preds_multi(spark, sf_dir))


@register("multiclass_macro", oracle(
    """SELECT round(avg(precision), 6) macro_precision, round(avg(recall), 6) macro_recall,
              round(avg(f1), 6) macro_f1, CAST(max(correct) AS DOUBLE) / CAST(max(total) AS DOUBLE) accuracy,
              count(*) n_classes FROM mc2""", *_MC_CTES), "A7")
def q_multiclass_macro(spark, sf_dir):
    macro = M.multiclass_macro(M.multiclass(fx.preds_multi(spark, sf_dir)))
    return macro.withColumns({c: F.round(c, 6) for c in ("macro_precision", "macro_recall", "macro_f1")})


# ---------------------------------------------------------------- A8 / A14

@register("classification_report", oracle(
    report_long_sql(), f"c AS ({counts_sql('preds')})", *report_ctes("c")), "A8", "A14", "S20")
def q_classification_report(spark, sf_dir):
    return M.report_long(M.confusion(fx.preds(spark, sf_dir)))


# ---------------------------------------------------------------- A9 / A10

@register("balanced_accuracy", oracle(
    f"""SELECT tn, fp, fn, tp, {safe('tp', 'tp + fn')} recall, {safe('tn', 'tn + fp')} specificity,
        ({safe('tp', 'tp + fn')} + {safe('tn', 'tn + fp')}) / CAST(2 AS DOUBLE) balanced_accuracy
        FROM ({counts_sql('preds')})"""), "A9")
def q_balanced_accuracy(spark, sf_dir):
    return M.balanced_accuracy(M.confusion(fx.preds(spark, sf_dir)))


_ARGMAX_SQL = "CAST(list_position(logits, list_max(logits)) - 1 AS INT)"


@register("encoder_eval_metrics", oracle(
    f"""SELECT CAST(tp + tn AS DOUBLE) / CAST(tp + tn + fp + fn AS DOUBLE) accuracy,
        ({safe('tp', 'tp + fn')} + {safe('tn', 'tn + fp')}) / CAST(2 AS DOUBLE) balanced_accuracy,
        {safe('tp', 'tp + fp')} precision_class1, {safe('tp', 'tp + fn')} recall_class1,
        {f1(safe('tp', 'tp + fp'), safe('tp', 'tp + fn'))} f1_class1,
        {safe('tn', 'tn + fp')} specificity, tp, fp, tn, fn
        FROM ({counts_sql(f"(SELECT label, {_ARGMAX_SQL} pred FROM logits)")})"""), "A10", "N8")
def q_encoder_eval_metrics(spark, sf_dir):
    lg = fx.logits(spark, sf_dir).withColumn("pred", argmax("logits"))
    return M.encoder_eval(lg)


# ---------------------------------------------------------------- A11 / A12

_A11_COUNTS = counts_sql("preds", extra=", count(*) FILTER (WHERE pred IS NULL) invalid_count, count(*) total_samples")


@register("evaluation_with_invalid", oracle(
    f"""SELECT tn, fp, fn, tp, invalid_count, total_samples,
        {safe('invalid_count', 'total_samples')} invalid_rate,
        precision1 AS precision, recall1 AS recall, f1_1 f1_score, accuracy, macro_f1, weighted_f1 FROM rc2""",
    f"c AS ({_A11_COUNTS})", *report_ctes("c")), "A11")
def q_evaluation_with_invalid(spark, sf_dir):
    r = M.evaluate_with_invalid(fx.preds(spark, sf_dir))
    return r.select("tn", "fp", "fn", "tp", "invalid_count", "total_samples", "invalid_rate",
                    F.col("precision1").alias("precision"), F.col("recall1").alias("recall"),
                    F.col("f1_1").alias("f1_score"), "accuracy", "macro_f1", "weighted_f1")


@register("accuracy_invalid_as_wrong", oracle(
    """SELECT CAST(count(*) FILTER (WHERE label IS NOT DISTINCT FROM pred) AS DOUBLE) / CAST(count(*) AS DOUBLE) accuracy,
              CAST(count(*) FILTER (WHERE pred IS NULL) AS DOUBLE) / CAST(count(*) AS DOUBLE) num_invalid
       FROM preds"""), "A12")
def q_accuracy_invalid_as_wrong(spark, sf_dir):
    return M.accuracy_invalid_as_wrong(fx.preds(spark, sf_dir))


# ---------------------------------------------------------------- J2, P7, UD3

@register("labels_with_predictions", oracle(
    """SELECT p.pair_id, p.label, q.pred, p.e1_trigger, p.e2_trigger
       FROM pairs p JOIN (SELECT pair_id, pred FROM preds) q USING (pair_id)"""), "J2")
def q_labels_with_predictions(spark, sf_dir):
    p = fx.pairs(spark, sf_dir).select("pair_id", "label", "e1_trigger", "e2_trigger")
    q = fx.preds(spark, sf_dir).select("pair_id", "pred")
    return align(p, q).select("pair_id", "label", "pred", "e1_trigger", "e2_trigger")


@register("valid_predictions", oracle("SELECT pair_id, label, pred FROM preds WHERE pred IS NOT NULL"), "P7")
def q_valid_predictions(spark, sf_dir):
    return fx.preds(spark, sf_dir).where(F.col("pred").isNotNull()).select("pair_id", "label", "pred")


@register("custom_metrics", oracle(
    """SELECT source, CAST(count(*) FILTER (WHERE pred = 1) AS DOUBLE) / CAST(count(*) AS DOUBLE) positive_rate,
              count(*) FILTER (WHERE pred IS NULL) n_invalid, max(label) max_label
       FROM preds GROUP BY source"""), "UD3")
def q_custom_metrics(spark, sf_dir):
    metrics = {
        "positive_rate": F.count_if(F.col("pred") == 1).cast("double") / F.count(F.lit(1)).cast("double"),
        "n_invalid": F.count_if(F.col("pred").isNull()),
        "max_label": F.max("label"),
    }
    return M.custom(fx.preds(spark, sf_dir), metrics, by=["source"])


# ---------------------------------------------------------------- E3

_E3_PREDS = """e3 AS (SELECT label, CAST(contains(lower(model_response), 'yes') AS INT) pred
               FROM answered WHERE model_response IS NOT NULL)"""


def evaluate_collected(spark, sf_dir):
    """E3 collected responses -> yes/else-no (N3) -> report."""
    a = fx.answered(spark, sf_dir).where(F.col("model_response").isNotNull())
    p = a.select("label", yes_else_no(F.col("model_response")).alias("pred"))
    return M.report_long(M.confusion(p))


@register("evaluate_collected_flow", oracle(
    report_long_sql(), _E3_PREDS, f"c AS ({counts_sql('e3')})", *report_ctes("c")), "E3", "N3", "P6")
def q_evaluate_collected_flow(spark, sf_dir):
    return evaluate_collected(spark, sf_dir)
