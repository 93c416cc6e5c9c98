"""Registered queries for ingest, sinks, dataset statistics and response collection tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corefkit.functions.text import timestamp_text
from corefkit.operators import metrics as M
from corefkit.operators.joins import merge_responses
from corefkit.plans import fixtures as fx
from corefkit.plans.oracle_ctes import oracle
from corefkit.plans.oracle_ctes import strip as d_strip
from corefkit.plans.oracle_ctes import words as d_words
from corefkit.operators import sampling as S
from corefkit.plans.q_evaluation import counts_sql, report_ctes
from corefkit.plans.q_sampling import N_NEGATIVE, N_UNIQUE, SEED, T5_RESULT, t5_ctes
from corefkit.registry import register
from corefkit.session import shared_dir
from corefkit.sources import documents as D
from corefkit.sources import raw_pairs as RP
from corefkit.sources import tables as T

# ---------------------------------------------------------------- IO1 - IO4

NEG = "'-1'"


def _raw_line_sql(broken: bool = False, with_ids: bool = False) -> str:
    label = "CAST(label AS VARCHAR)"
    e1_end = "CAST(e1_trigger_end AS VARCHAR)"
    last = label
    if broken:
        label = f"CASE WHEN pair_id % 50 = 0 THEN 'x' ELSE {label} END"
        e1_end = f"CASE WHEN pair_id % 50 = 2 THEN '999' ELSE {e1_end} END"
        last = f"CASE WHEN pair_id % 50 <> 1 THEN {label} END"
    fields = ["sentence1", "CAST(e1_trigger_start AS VARCHAR)", e1_end] + [NEG] * 8
    fields += ["sentence2", "CAST(e2_trigger_start AS VARCHAR)", "CAST(e2_trigger_end AS VARCHAR)"] + [NEG] * 8
    fields.append(last)
    if with_ids:
        fields = ["CAST(doc1 AS VARCHAR)", "CAST(doc2 AS VARCHAR)"] + fields
    return f"concat_ws(chr(9), {', '.join(fields)})"


def _raw_ctes(broken: bool = False, with_ids: bool = False) -> list[str]:
    names = RP.field_names(with_ids)
    cols = ", ".join(f"f[{i + 1}] AS {n}" for i, n in enumerate(names))
    return [
        f"rl AS (SELECT {_raw_line_sql(broken, with_ids)} line FROM pairs_wide)",
        """rid AS (SELECT md5(line) || ':' || CAST(row_number() OVER (PARTITION BY line ORDER BY line) - 1 AS VARCHAR)
                pair_id, line FROM rl)""",
        f"""raw AS (SELECT pair_id, CAST(len(f) AS INT) n_fields, {cols}
                FROM (SELECT pair_id, string_split({d_strip('line')}, chr(9)) f FROM rid))""",
    ]


def _write_raw(spark, sf_dir, broken=False, with_ids=False) -> str:
    path = shared_dir(spark, "raw_pairs", unique=True)
    fx.raw_lines(spark, sf_dir, with_ids=with_ids, broken=broken).write.mode("overwrite").text(path)
    return path


@register("read_raw_pairs", oracle("SELECT * FROM raw", *_raw_ctes()), "IO1", "IO4", "S02")
def q_read_raw_pairs(spark, sf_dir):
    return RP.read_raw_pairs(spark, _write_raw(spark, sf_dir))


@register("read_raw_pairs_with_ids", oracle("SELECT * FROM raw", *_raw_ctes(with_ids=True)), "IO2")
def q_read_raw_pairs_with_ids(spark, sf_dir):
    return RP.read_raw_pairs(spark, _write_raw(spark, sf_dir, with_ids=True), with_ids=True)


def _extract_sql(sentence: str, s: str, e: str) -> str:
    w = d_words(sentence)
    return (f"CASE WHEN {s} >= 0 AND {e} < len({w}) THEN array_to_string(list_filter({w}, lambda x, i: i > {s} "
            f"AND i <= (CASE WHEN {e} < -1 THEN greatest(0, len({w}) + {e} + 1) ELSE {e} + 1 END)), ' ') END")


_TYPED = f"""SELECT pair_id, sentence1, CAST(e1_trigger_start AS INT) e1_trigger_start,
        CAST(e1_trigger_end AS INT) e1_trigger_end, TRY_CAST(e1_time_start AS INT) e1_time_start,
        sentence2, CAST(e2_trigger_start AS INT) e2_trigger_start, CAST(e2_trigger_end AS INT) e2_trigger_end,
        CAST(label AS INT) label,
        {_extract_sql('sentence1', 'CAST(e1_trigger_start AS INT)', 'CAST(e1_trigger_end AS INT)')} e1_trigger,
        {_extract_sql('sentence2', 'CAST(e2_trigger_start AS INT)', 'CAST(e2_trigger_end AS INT)')} e2_trigger,
        CAST(len({d_words('sentence1')}) + len({d_words('sentence2')}) AS INT) length FROM raw"""
_TYPED_COLS = ["pair_id", "sentence1", "e1_trigger_start", "e1_trigger_end", "e1_time_start", "sentence2",
               "e2_trigger_start", "e2_trigger_end", "label", "e1_trigger", "e2_trigger", "length"]


@register("cast_pairs", oracle(_TYPED, *_raw_ctes()), "IO3", "IO4", "P1", "P2")
def q_cast_pairs(spark, sf_dir):
    raw = RP.read_raw_pairs(spark, _write_raw(spark, sf_dir))
    return RP.cast_pairs(raw, "strict").select(*_TYPED_COLS)


@register("quarantine_pairs", oracle(
    """SELECT pair_id, CASE WHEN n_fields <> 23 THEN 'field_count'
            WHEN TRY_CAST(e1_trigger_start AS INT) IS NULL THEN 'bad_int:e1_trigger_start'
            WHEN TRY_CAST(e1_trigger_end AS INT) IS NULL THEN 'bad_int:e1_trigger_end'
            WHEN TRY_CAST(e2_trigger_start AS INT) IS NULL THEN 'bad_int:e2_trigger_start'
            WHEN TRY_CAST(e2_trigger_end AS INT) IS NULL THEN 'bad_int:e2_trigger_end'
            WHEN TRY_CAST(label AS INT) IS NULL THEN 'bad_int:label' END reason FROM raw WHERE reason IS NOT NULL""",
    *_raw_ctes(broken=True)), "IO3")
def q_quarantine_pairs(spark, sf_dir):
    raw = RP.read_raw_pairs(spark, _write_raw(spark, sf_dir, broken=True))
    return RP.quarantine(raw)


@register("cast_pairs_quarantine_mode", oracle(
    _TYPED.replace("FROM raw", "FROM raw WHERE n_fields = 23 AND TRY_CAST(label AS INT) IS NOT NULL"),
    *_raw_ctes(broken=True)), "IO3")
def q_cast_pairs_quarantine_mode(spark, sf_dir):
    raw = RP.read_raw_pairs(spark, _write_raw(spark, sf_dir, broken=True))
    return RP.cast_pairs(raw, "quarantine").select(*_TYPED_COLS)


# ---------------------------------------------------------------- IO5 - IO8

_CSV_COLS = "pair_id bigint, label int, sentence1 string, e1_trigger string, model_response string, reasoning_content string"


@register("csv_round_trip", oracle(
    "SELECT pair_id, label, sentence1, e1_trigger, model_response, reasoning_content FROM answered"), "IO5", "IO6")
def q_csv_round_trip(spark, sf_dir):
    a = fx.answered(spark, sf_dir).select("pair_id", "label", "sentence1", "e1_trigger", "model_response",
                                          "reasoning_content")
    path = shared_dir(spark, "csv_round_trip", unique=True)
    T.write_pairs_csv(a, path)
    return T.read_pairs_csv(spark, path, _CSV_COLS)


@register("load_splits", oracle(
    "SELECT pair_id, split, label, event_id_1, event_id_2 FROM splits WHERE split IN ('train', 'dev', 'test')"), "IO7")
def q_load_splits(spark, sf_dir):
    path = shared_dir(spark, "splits", unique=True)
    T.write_splits(fx.splits(spark, sf_dir), path)
    return T.load_splits(spark, path).select("pair_id", "split", "label", "event_id_1", "event_id_2")


def metrics_documents(spark, sf_dir):
    """One metrics document per ``source`` (A11 + A8 as the nested reference layout)."""
    r = M.evaluate_with_invalid(fx.preds(spark, sf_dir), by=["source"])
    return D.metrics_document(r, F.col("source"))


_DOC_SQL = """SELECT source tag, precision1 AS precision, recall1 AS recall, f1_1 f1_score, accuracy, support0,
        macro_f1, weighted_f1, tn, fp, fn, tp, invalid_count, invalid_rate, total_samples,
        [[tn, fp], [fn, tp]] confusion_matrix FROM rc2"""
_DOC_CTES = [f"""c AS ({counts_sql('preds', by='source', extra=", count(*) FILTER (WHERE pred IS NULL) invalid_count, "
                                                                "count(*) total_samples")})""",
             """c2 AS (SELECT *, CASE WHEN total_samples > 0 THEN CAST(invalid_count AS DOUBLE) /
                       CAST(total_samples AS DOUBLE) ELSE CAST(0 AS DOUBLE) END invalid_rate FROM c)""",
             *report_ctes("c2")]


def _flatten_doc(d, more=()):
    cr, am = "classification_report", "additional_metrics"
    return d.select(
        "tag", *more,
        F.col(f"{cr}.Coreferent.precision").alias("precision"), F.col(f"{cr}.Coreferent.recall").alias("recall"),
        F.col(f"{cr}.Coreferent.`f1-score`").alias("f1_score"), F.col(f"{cr}.accuracy").alias("accuracy"),
        F.col(f"{cr}.`Not Coreferent`.support").alias("support0"),
        F.col(f"{cr}.`macro avg`.`f1-score`").alias("macro_f1"),
        F.col(f"{cr}.`weighted avg`.`f1-score`").alias("weighted_f1"),
        F.col(f"{am}.true_negatives").alias("tn"), F.col(f"{am}.false_positives").alias("fp"),
        F.col(f"{am}.false_negatives").alias("fn"), F.col(f"{am}.true_positives").alias("tp"),
        F.col(f"{am}.invalid_count").alias("invalid_count"), F.col(f"{am}.invalid_rate").alias("invalid_rate"),
        F.col(f"{am}.total_samples").alias("total_samples"), "confusion_matrix",
    )


@register("metrics_json_round_trip", oracle(_DOC_SQL, *_DOC_CTES), "IO8", "A8", "S18")
def q_metrics_json_round_trip(spark, sf_dir):
    path = shared_dir(spark, "metrics", unique=True)
    D.write_metrics(metrics_documents(spark, sf_dir), path)
    return _flatten_doc(D.read_metrics(spark, path))


@register("stamped_metrics_documents", oracle(
    _DOC_SQL.replace("source tag,", "source tag, strftime((SELECT max(ts) FROM events), '%Y-%m-%d %H:%M:%S') AS timestamp,"),
    *_DOC_CTES), "S18", "IO8", "IO10")
def q_stamped_metrics_documents(spark, sf_dir):
    """Documents stamped with a clock of their own, here the time of the last event, so that a rerun writes the same."""
    path = shared_dir(spark, "metrics", unique=True)
    clock = fx.table(spark, sf_dir, "events").select(F.max("ts")).scalar()
    r = M.evaluate_with_invalid(fx.preds(spark, sf_dir), by=["source"])
    D.write_metrics(D.metrics_document(r, F.col("source"), clock=clock), path)
    return _flatten_doc(D.read_metrics(spark, path), ["timestamp"])


@register("timestamp_text", oracle(
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') stamp, strftime(ts, '%Y%m%d') AS \"day\" FROM events"), "S18")
def q_timestamp_text(spark, sf_dir):
    """The text of every event's time, in the default and in another format."""
    ev = fx.table(spark, sf_dir, "events")
    return ev.select("event_id", timestamp_text(clock=F.col("ts")).alias("stamp"), timestamp_text("yyyyMMdd", F.col("ts")).alias("day"))


# ---------------------------------------------------------------- A1 - A3

@register("dataset_stats", oracle(
    """SELECT count(DISTINCT sentence1) unique_sentence1, count(DISTINCT sentence2) unique_sentence2,
        (SELECT count(DISTINCT s) FROM (SELECT sentence1 s FROM pairs UNION ALL SELECT sentence2 FROM pairs)) unique_sentences
       FROM pairs"""), "A1", "A2")
def q_dataset_stats(spark, sf_dir):
    return M.dataset_stats(fx.pairs(spark, sf_dir))


@register("label_distribution", oracle(
    "SELECT label, count(*) count FROM pairs WHERE label IS NOT NULL GROUP BY label"), "A3")
def q_label_distribution(spark, sf_dir):
    return M.label_distribution(fx.pairs(spark, sf_dir))


# ---------------------------------------------------------------- P5, P6, J3, A13

@register("pending_rows", oracle("SELECT pair_id FROM answered WHERE reasoning_content IS NULL"), "P5", "S19")
def q_pending_rows(spark, sf_dir):
    return fx.answered(spark, sf_dir).where(F.col("reasoning_content").isNull()).select("pair_id")


@register("answered_rows", oracle(
    "SELECT pair_id, model_response FROM answered WHERE model_response IS NOT NULL"), "P6", "S19")
def q_answered_rows(spark, sf_dir):
    a = fx.answered(spark, sf_dir)
    return a.where(F.col("model_response").isNotNull()).select("pair_id", "model_response")


@register("rows_with_reasoning", oracle(
    "SELECT pair_id, reasoning_content FROM answered WHERE reasoning_content IS NOT NULL"), "P6")
def q_rows_with_reasoning(spark, sf_dir):
    a = fx.answered(spark, sf_dir)
    return a.where(F.col("reasoning_content").isNotNull()).select("pair_id", "reasoning_content")


@register("merge_responses", oracle(
    """SELECT p.pair_id, p.label, l.model_response, l.reasoning_content FROM pairs p LEFT JOIN
        (SELECT pair_id, model_response, reasoning_content FROM (SELECT *, row_number() OVER
            (PARTITION BY pair_id ORDER BY attempt DESC) rn FROM response_log WHERE error IS NULL) WHERE rn = 1) l
        USING (pair_id)"""), "J3", "P9")
def q_merge_responses(spark, sf_dir):
    p = fx.pairs(spark, sf_dir).select("pair_id", "label")
    return merge_responses(p, fx.response_log(spark, sf_dir)).select(
        "pair_id", "label", "model_response", "reasoning_content")


@register("collection_summary", oracle(
    """SELECT (SELECT count(*) FROM answered) total_rows,
        (SELECT count(*) FROM answered WHERE model_response IS NOT NULL AND reasoning_content IS NOT NULL) successful,
        (SELECT count(*) FROM answered WHERE reasoning_content IS NULL) pending,
        (SELECT count(*) FROM response_log WHERE error IS NOT NULL) failed_attempts,
        (SELECT count(*) FROM response_log) attempts"""), "A13")
def q_collection_summary(spark, sf_dir):
    rows = fx.answered(spark, sf_dir).select(
        F.lit(True).alias("is_row"), "model_response", "reasoning_content", F.lit(None).cast("string").alias("error"))
    log = fx.response_log(spark, sf_dir).select(
        F.lit(False).alias("is_row"), "model_response", "reasoning_content", "error")
    u = rows.unionByName(log)
    is_row = F.col("is_row")
    # One scan of both tables, one aggregate: no join of the two summaries.
    return u.agg(
        F.count_if(is_row).alias("total_rows"),
        F.count_if(is_row & F.col("model_response").isNotNull() & F.col("reasoning_content").isNotNull())
        .alias("successful"),
        F.count_if(is_row & F.col("reasoning_content").isNull()).alias("pending"),
        F.count_if(~is_row & F.col("error").isNotNull()).alias("failed_attempts"),
        F.count_if(~is_row).alias("attempts"),
    )



# ---------------------------------------------------------------- E1

_TYPED_ALL_COLS = [c for c in RP.RAW_FIELDS] + ["e1_trigger", "e2_trigger", "length"]
_TYPED_ALL = (_TYPED.replace("TRY_CAST(e1_time_start AS INT) e1_time_start,",
                             ", ".join(f"TRY_CAST({c} AS INT) {c}" for c in RP.OPTIONAL_INT) + ","))


@register("preprocess_flow", oracle(T5_RESULT, *_raw_ctes(), f"typed AS ({_TYPED_ALL})",
                                    *t5_ctes(_TYPED_ALL_COLS, "typed")), "E1", "T4", "T5", "IO1", "IO3")
def q_preprocess_flow(spark, sf_dir):
    """E1 raw lines -> typed pairs with triggers -> balanced set -> diversity sample."""
    raw = RP.read_raw_pairs(spark, _write_raw(spark, sf_dir))
    typed = RP.cast_pairs(raw, "strict").select("pair_id", *_TYPED_ALL_COLS)
    # Each stage is written to the shared folder and read back (the
    # reference saves each stage too): the diversity sample reads its input
    # four times, and a Parquet scan is cheaper than re-parsing raw text.
    base = shared_dir(spark, "preprocess", unique=True)
    typed.write.mode("overwrite").parquet(f"{base}/pairs")
    bal = S.balanced(spark.read.parquet(f"{base}/pairs"), N_NEGATIVE, SEED).drop("shuffle_key")
    bal.write.mode("overwrite").parquet(f"{base}/balanced")
    return S.unique_sample(spark.read.parquet(f"{base}/balanced"), N_UNIQUE, SEED).select(
        "pair_id", "label", "shuffle_key")
