"""Registered queries for whole flows: preprocessing of all splits, evaluations that end in a metrics document."""

from __future__ import annotations

from pyspark.sql import functions as F

from corefkit.functions.parse import tagged_answer, yes_else_no
from corefkit.operators import curves as CV
from corefkit.operators import encode as E
from corefkit.operators import inference as INF
from corefkit.operators import metrics as M
from corefkit.operators import prompts as P
from corefkit.operators import sampling as S
from corefkit.plans import fixtures as fx
from corefkit.plans import stubs
from corefkit.plans.oracle_ctes import hash_int, oracle
from corefkit.plans.q_evaluation import _E3_PREDS, counts_sql, report_ctes
from corefkit.plans.q_ingest import _flatten_doc
from corefkit.plans.q_models import _GEN_CTE, _PRED, _STUB_LOGITS, _generated
from corefkit.plans.q_prompts import PM_CTE, _SPLIT_PM_CTE, _encode_sql
from corefkit.plans.q_reports import _RUN_COLS
from corefkit.plans.q_sampling import N_NEGATIVE, N_UNIQUE, SEED, rk
from corefkit.registry import register
from corefkit.session import COMPACT, delete, scratch, shared_dir, shuffles_dropped, staged
from corefkit.sources import documents as D
from corefkit.sources import raw_pairs as RP
from corefkit.sources import tables as T

# ---------------------------------------------------------------- E1, all splits


def _raw_splits(spark, sf_dir) -> str:
    """Raw lines of all splits, one folder each; test lines carry event ids."""
    wide = fx.pairs_wide(spark, sf_dir).withColumn("split", fx.split_of(F.col("pair_id")))
    ids = [F.when(F.col("split") == "test", F.col(c).cast("string")) for c in ("doc1", "doc2")]
    path = shared_dir(spark, "raw_splits", unique=True)
    wide.select(F.concat_ws("\t", *ids, *fx.raw_fields(wide)).alias("value"), "split").write.option(
        "compression", "lz4").partitionBy("split").text(path)
    return path


_STATS = """SELECT '{0}' stage, count(*) n, count(*) FILTER (WHERE label = 1) positives, count(DISTINCT sentence1) unique_sentence1,
        count(DISTINCT sentence2) unique_sentence2,
        (SELECT count(DISTINCT s) FROM (SELECT sentence1 s FROM {1} UNION ALL SELECT sentence2 FROM {1})) unique_sentences FROM {1}"""
_SPLIT_LINES = """w AS (SELECT *, CASE WHEN {h} % 10 < 8 THEN 'train' WHEN {h} % 10 = 8 THEN 'dev' ELSE 'test' END split FROM pairs_wide),
    lines AS (SELECT concat_ws(chr(9), sentence1, e1_trigger_start, e1_trigger_end, {neg}, sentence2, e2_trigger_start,
                     e2_trigger_end, {neg}, label) line, sentence1, sentence2, label, split FROM w)""".format(
    h=hash_int("'s:' || CAST(pair_id AS VARCHAR)"), neg=", ".join(["'-1'"] * 8))


@register("preprocess_splits_flow", oracle(
    " UNION ALL ".join(_STATS.format(s, f"st_{s}") for s in ("train", "dev", "test", "balanced")) + f"""
    UNION ALL SELECT 'sample', least({N_UNIQUE}, count(*)), NULL, NULL, NULL, NULL FROM pick""",
    _SPLIT_LINES, """st_train AS (SELECT md5(line) || ':' || CAST(row_number() OVER (PARTITION BY line) - 1 AS VARCHAR) pair_id,
        * FROM lines WHERE split = 'train')""", "st_dev AS (SELECT * FROM lines WHERE split = 'dev')",
    "st_test AS (SELECT * FROM lines WHERE split = 'test')",
    f"""st_balanced AS (SELECT * FROM st_train WHERE label = 1 UNION ALL
        (SELECT * FROM st_train WHERE label = 0 ORDER BY {rk()}, pair_id LIMIT {N_NEGATIVE}))""",
    f"""f1 AS (SELECT min_by(pair_id, row({rk('shuffle')}, pair_id)) pair_id FROM st_balanced GROUP BY sentence1)""",
    f"""f2 AS (SELECT min_by(pair_id, row({rk('shuffle')}, pair_id)) pair_id FROM st_balanced GROUP BY sentence2)""",
    f"""u1 AS (SELECT pair_id FROM f1 ORDER BY {rk('s1')}, pair_id LIMIT {N_UNIQUE})""",
    f"""u2 AS (SELECT pair_id FROM f2 ORDER BY {rk('s2')}, pair_id LIMIT {N_UNIQUE})""",
    """pick AS (SELECT pair_id FROM u1 UNION SELECT pair_id FROM u2
               UNION SELECT pair_id FROM st_balanced WHERE label = 1)"""), "E1", "A1", "A2", "T4", "T5", "IO2")
def q_preprocess_splits_flow(spark, sf_dir):
    """E1 whole: train, dev and test from raw lines in one pass, the balanced train set and its diversity sample, each
    saved, with the statistics of every saved stage from one aggregate over all of them."""
    base = shared_dir(spark, "preprocess_splits", unique=True)
    # what a step has staged or shuffled is deleted when its result is saved
    with shuffles_dropped(spark):
        with scratch(spark):
            raw = _raw_splits(spark, sf_dir)
            pairs = RP.read_raw_splits(spark, raw)
            delete(spark, raw)  # its lines are staged with their ids
            T.write_splits(pairs, f"{base}/splits")
        splits = T.load_splits(spark, f"{base}/splits")
        train = splits.where(F.col("split") == "train").drop("split")
        with scratch(spark):
            S.balanced(train, N_NEGATIVE, SEED).drop("shuffle_key").write.option("compression", COMPACT).parquet(f"{base}/balanced")
        balanced = spark.read.parquet(f"{base}/balanced")
        with scratch(spark):
            S.unique_sample(balanced, N_UNIQUE, SEED).write.parquet(f"{base}/sample")
    columns = ["stage", "sentence1", "sentence2", "label"]
    saved = splits.withColumnRenamed("split", "stage").select(columns).unionByName(
        balanced.withColumn("stage", F.lit("balanced")).select(columns))
    size = saved.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("positives"))
    stats = size.join(M.dataset_stats(saved, ["stage"]), "stage")
    return stats.unionByName(spark.read.parquet(f"{base}/sample").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "stage", F.lit("sample")), allowMissingColumns=True)


@register("load_split_paths", oracle("SELECT pair_id, split, label FROM splits"), "IO7")
def q_load_split_paths(spark, sf_dir):
    """One folder per split, read as one table."""
    base = shared_dir(spark, "split_paths", unique=True)
    s = staged(fx.splits(spark, sf_dir).select("pair_id", "label", "split"), "splits")
    for name in T.SPLITS:
        s.where(F.col("split") == name).drop("split").write.parquet(f"{base}/{name}")
    return T.load_split_paths(spark, {n: f"{base}/{n}" for n in T.SPLITS}).select("pair_id", "split", "label")


# ---------------------------------------------------------------- E2 - E4 to their documents

_MODEL = ("model_info.base_model", "model_info.adapter_path", "model_path")


def _document_sql(base_model: str | None, adapter: str | None, path: str | None) -> str:
    text = lambda x: "CAST(NULL AS VARCHAR)" if x is None else f"'{x}'"
    return f"""SELECT tn, fp, fn, tp, invalid_count, total_samples, invalid_rate, precision1 AS precision, recall1 AS recall,
        f1_1 f1_score, accuracy, support0, macro_f1, weighted_f1, [[tn, fp], [fn, tp]] confusion_matrix,
        {text(base_model)} base_model, {text(adapter)} adapter_path, {text(path)} model_path FROM rc2"""


def _counts_ctes(preds: str) -> list[str]:
    counts = counts_sql(preds, extra=", count(*) FILTER (WHERE pred IS NULL) invalid_count, count(*) total_samples")
    return [f"c AS ({counts})", """c2 AS (SELECT *, CASE WHEN total_samples > 0 THEN CAST(invalid_count AS DOUBLE) /
                 CAST(total_samples AS DOUBLE) ELSE CAST(0 AS DOUBLE) END invalid_rate FROM c)""", *report_ctes("c2")]


def _through_document(spark, predictions, **model):
    """Evaluate, write the metrics document, read it again."""
    path = shared_dir(spark, "metrics", unique=True)
    D.write_metrics(D.metrics_document(M.evaluate_with_invalid(predictions), **model), path)
    back = D.read_metrics(spark, path)
    names = {"model_info.base_model": "base_model", "model_info.adapter_path": "adapter_path", "model_path": "model_path"}
    return _flatten_doc(back.withColumns({v: F.col(k) for k, v in names.items()}), list(names.values())).drop("tag")


@register("evaluate_reasoning_document", oracle(
    _document_sql("stub-generator", "adapter-1", None), PM_CTE, _GEN_CTE, *_counts_ctes(
        "(SELECT label, CASE WHEN contains(completion, '<answer>') THEN (CASE WHEN contains(lower(split_part(completion, "
        "'<answer>', 2)), 'yes') THEN 1 WHEN contains(lower(split_part(completion, '<answer>', 2)), 'no') THEN 0 END) END "
        "pred FROM gen)")), "E2", "IO8", "IO10", "A11", "S18")
def q_evaluate_reasoning_document(spark, sf_dir):
    preds = _generated(spark, sf_dir).select("label", tagged_answer(F.col("completion")).alias("pred"))
    return _through_document(spark, preds, base_model="stub-generator", adapter_path="adapter-1")


@register("evaluate_collected_document", oracle(
    _document_sql(None, None, None), _E3_PREDS, *_counts_ctes("e3")), "E3", "IO8", "IO10")
def q_evaluate_collected_document(spark, sf_dir):
    a = fx.answered(spark, sf_dir).where(F.col("model_response").isNotNull())
    return _through_document(spark, a.select("label", yes_else_no(F.col("model_response")).alias("pred")))


@register("evaluate_encoder_document", oracle(
    _document_sql(None, None, "models/encoder"), _SPLIT_PM_CTE, f"enc AS ({_encode_sql(E.MAX_LEN)} WHERE split = 'test')",
    _STUB_LOGITS, *_counts_ctes(f"(SELECT label, {_PRED} pred FROM sl)")), "E4", "IO8", "IO10")
def q_evaluate_encoder_document(spark, sf_dir):
    s = fx.splits(spark, sf_dir).where(F.col("split") == "test")
    scored = INF.score_pairs(E.encode_pairs(P.encoder_text(s)), stubs.HashLogitModel, keep=("label",))
    return _through_document(spark, scored, model_path="models/encoder")


# ---------------------------------------------------------------- IO9, one pretty-printed file per run

_LOG_SCHEMA = """log_history array<struct<step:bigint,reward:double,reward_std:double,`rewards/click_reward_func`:double,
    `rewards/view_reward_func`:double,`rewards/int_reward_func`:double,completion_length:bigint>>"""


@register("training_logs_pretty", oracle(f"SELECT {_RUN_COLS.replace('run_id', 'CAST(run_id AS VARCHAR) run_id', 1)} FROM runs"), "IO9")
def q_training_logs_pretty(spark, sf_dir):
    """Many pretty-printed files, the run named by the folder of its files."""
    path = shared_dir(spark, "training_logs_pretty", unique=True)
    logs = CV.log_documents(fx.runs(spark, sf_dir)).select(
        "run_id", "chunk", F.to_json(F.struct("log_history"), {"pretty": "true"}).alias("value"))
    logs.select(F.concat(F.col("run_id").cast("string"), F.lit("_"), F.col("chunk").cast("string")).alias("run"), "value"
                ).write.partitionBy("run").text(path)
    rows = D.read_training_logs(spark, [f"{path}/*/*"], run_from_folder=True, schema=_LOG_SCHEMA)
    run = F.regexp_extract("run_id", "run=([^_]*)_", 1)
    return rows.select(run.alias("run_id"), "step", "reward", "reward_std", "completion_length",
                       "`rewards/click_reward_func`", "`rewards/view_reward_func`", "`rewards/int_reward_func`")
