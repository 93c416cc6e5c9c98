"""Registered queries for model calls and the end-to-end evaluation flows.

Models are deterministic stubs (pure functions of their input), so the
DuckDB oracles can restate them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corefkit.functions.parse import tagged_answer
from corefkit.operators import classifier as C
from corefkit.operators import encode as E
from corefkit.operators import inference as INF
from corefkit.operators import metrics as M
from corefkit.operators import prompts as P
from corefkit.plans import fixtures as fx
from corefkit.plans import stubs
from corefkit.plans.oracle_ctes import oracle
from corefkit.plans.q_evaluation import counts_sql, report_ctes, report_long_sql, safe
from corefkit.plans.q_prompts import (
    _SPLIT_PM_CTE, PM_CTE, SYSTEM_SQL, _encode_sql, cat, lit_sql, turn_sql, user_prompt_sql,
)
from corefkit.registry import register
from corefkit.session import COMPACT, shared_dir, shuffles_dropped, staged
from corefkit.sources import tables as T


def _h_sql(x: str) -> str:
    return f"CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT)"


# ---------------------------------------------------------------- INF1, E4

_STUB_LOGITS = """sl AS (SELECT pair_id, split, label, s,
        [CAST((s % 2001) - 1000 AS DOUBLE) / 1000.0, CAST((s * 7 % 2001) - 1000 AS DOUBLE) / 1000.0] logits
    FROM (SELECT pair_id, split, label, list_sum(list_transform(input_ids, lambda x, i: CAST(x AS BIGINT) * i)) s
          FROM enc))"""
_PRED = "CAST(list_position(logits, list_max(logits)) - 1 AS INT)"


def _scores(spark, sf_dir, test_only=False):
    s = fx.splits(spark, sf_dir)
    if test_only:
        s = s.where(F.col("split") == "test")
    enc = E.encode_pairs(P.encoder_text(s))
    return INF.score_pairs(enc, stubs.HashLogitModel, batch_size=512, keep=("label",))


@register("score_pairs", oracle(
    f"""SELECT pair_id, logits, {_PRED} pred,
        list_transform(logits, lambda t: round(exp(t - list_max(logits)) / list_sum(list_transform(logits,
            lambda u: exp(u - list_max(logits)))), 9)) probs FROM sl""",
    _SPLIT_PM_CTE, f"enc AS ({_encode_sql(E.MAX_LEN)})", _STUB_LOGITS), "INF1", "N8", "J4")
def q_score_pairs(spark, sf_dir):
    sc = _scores(spark, sf_dir)
    return sc.select("pair_id", "logits", "pred", F.transform("probs", lambda t: F.round(t, 9)).alias("probs"))


@register("evaluate_encoder_flow", oracle(
    report_long_sql(),
    _SPLIT_PM_CTE, f"enc AS ({_encode_sql(E.MAX_LEN)} WHERE split = 'test')", _STUB_LOGITS,
    f"c AS ({counts_sql(f'(SELECT label, {_PRED} pred FROM sl)')})", *report_ctes("c")), "E4", "A8", "M5", "M6")
def q_evaluate_encoder_flow(spark, sf_dir):
    sc = _scores(spark, sf_dir, test_only=True)
    return M.report_long(M.confusion(sc))


# ---------------------------------------------------------------- INF2, E2

_REASON_INFER_SQL = cat(turn_sql("system", SYSTEM_SQL), turn_sql("user", user_prompt_sql("reason")),
                        lit_sql(P.ASSISTANT_PROMPT))


def _gen_sql(prompt: str) -> str:
    h = _h_sql(prompt)
    yn = f"(CASE WHEN ({h} // 4) % 2 = 0 THEN 'Yes' ELSE 'No' END)"
    return f"""(CASE {h} % 4
        WHEN 0 THEN '<reasoning>' || chr(10) || CAST(length({prompt}) AS VARCHAR) || chr(10) || '</reasoning>' || chr(10)
                    || '<answer>' || chr(10) || {yn} || chr(10) || '</answer>' || chr(10)
        WHEN 1 THEN '<reasoning>short</reasoning> <answer>' || {yn} || '</answer>'
        WHEN 2 THEN 'Answer: ' || {yn} END)"""


_GEN_CTE = f"""gen AS (SELECT pair_id, label, {_gen_sql('prompt')} completion
    FROM (SELECT pair_id, label, {_REASON_INFER_SQL} prompt FROM pm))"""


def _generated(spark, sf_dir):
    prompts = P.reason_prompts(fx.pairs(spark, sf_dir)).select("pair_id", "label", "prompt")
    return INF.generate_responses(prompts, stubs.HashShapeGenerator, batch_size=128, keep=("label",))


@register("generate_responses", oracle("SELECT pair_id, completion FROM gen", PM_CTE, _GEN_CTE), "INF2", "M9", "P11")
def q_generate_responses(spark, sf_dir):
    return _generated(spark, sf_dir).select("pair_id", "completion")


@register("generate_two_models", oracle(
    f"""SELECT pair_id, 'a' model, {_gen_sql("('a' || prompt)").replace("length(('a' || prompt))", "length(prompt)")} completion FROM pr
        UNION ALL SELECT pair_id, 'b', {_gen_sql("('b' || prompt)").replace("length(('b' || prompt))", "length(prompt)")} FROM pr""",
    PM_CTE, f"pr AS (SELECT pair_id, {_REASON_INFER_SQL} prompt FROM pm)"), "INF2")
def q_generate_two_models(spark, sf_dir):
    """Two differently set generators in one session: each call meets its own model."""
    prompts = staged(P.reason_prompts(fx.pairs(spark, sf_dir)).select("pair_id", "prompt"), "prompts")
    a, b = (INF.generate_responses(prompts, lambda m=m: stubs.HashShapeGenerator(m)).withColumn("model", F.lit(m)) for m in "ab")
    return a.unionByName(b).select("pair_id", "model", "completion")


_E2_COUNTS = counts_sql(
    f"(SELECT label, CASE WHEN contains(completion, '<answer>') THEN (CASE WHEN contains(lower(split_part(completion, "
    f"'<answer>', 2)), 'yes') THEN 1 WHEN contains(lower(split_part(completion, '<answer>', 2)), 'no') THEN 0 END) END "
    f"pred FROM gen)",
    extra=", count(*) FILTER (WHERE pred IS NULL) invalid_count, count(*) total_samples")


@register("evaluate_reasoning_flow", oracle(
    f"""SELECT tn, fp, fn, tp, invalid_count, total_samples, {safe('invalid_count', 'total_samples')} invalid_rate,
        precision1 AS precision, recall1 AS recall, f1_1 f1_score, accuracy FROM rc2""",
    PM_CTE, _GEN_CTE, f"c AS ({_E2_COUNTS})", *report_ctes("c")), "E2", "A11", "N4", "M3")
def q_evaluate_reasoning_flow(spark, sf_dir):
    g = _generated(spark, sf_dir).withColumn("pred", tagged_answer(F.col("completion")))
    r = M.evaluate_with_invalid(g)
    return r.select("tn", "fp", "fn", "tp", "invalid_count", "total_samples", "invalid_rate",
                    F.col("precision1").alias("precision"), F.col("recall1").alias("recall"),
                    F.col("f1_1").alias("f1_score"), "accuracy")


# ---------------------------------------------------------------- INF3, IO13

_API_CONTENT = user_prompt_sql("api")


def _collect_sql(fail_once: bool = False) -> str:
    h = _h_sql("content")
    fails = f"{h} % 11 = 0" if not fail_once else "FALSE"
    return f"""SELECT CAST(pair_id AS VARCHAR) pair_id, label,
            CASE WHEN {fails} THEN NULL WHEN ({h} // 16) % 2 = 0 THEN 'Yes' ELSE 'No' END model_response,
            CASE WHEN {fails} THEN NULL ELSE 'thought ' || CAST({h} % 1000 AS VARCHAR) END reasoning_content
        FROM (SELECT pair_id, label, {_API_CONTENT} content FROM pm)"""


@register("collect_responses", oracle(_collect_sql(), PM_CTE), "INF3", "IO13", "P5", "J3", "M4")
def q_collect_responses(spark, sf_dir):
    store = shared_dir(spark, "responses", unique=True)
    p = staged(fx.pairs(spark, sf_dir), "pairs", compact=True)
    merged = INF.collect_responses(p, lambda: stubs.HashStubClient(fail_mod=11), store, concurrency=50)
    return merged.select("pair_id", "label", "model_response", "reasoning_content")


_RESUME_SQL = f"""SELECT count(*) total_rows, count(*) successful, count(*) FILTER (WHERE h % 11 = 0) failed_attempts,
        count(*) + count(*) FILTER (WHERE h % 11 = 0) attempts
    FROM (SELECT {_h_sql('content')} h FROM (SELECT {_API_CONTENT} content FROM pm))"""


@register("collect_resume", oracle(_RESUME_SQL, PM_CTE), "INF3", "IO13", "A13")
def q_collect_resume(spark, sf_dir):
    """Two runs with a client that fails some rows once: the second run calls only those rows.

    Returns the collection summary (A13): all rows succeed in the end, and
    the attempts are the rows plus exactly the rows that failed once.
    """
    from corefkit.sources.response_store import read_log

    store = shared_dir(spark, "responses_resume", unique=True)
    p = staged(fx.pairs(spark, sf_dir), "pairs", compact=True)

    def factory():
        return stubs.HashStubClient(fail_mod=11, fail_once=True)

    INF.collect_responses(p, factory, store, concurrency=50)
    merged = INF.collect_responses(p, factory, store, concurrency=50)
    return INF.summary(merged, read_log(spark, store))


# ---------------------------------------------------------------- INF4

@register("collect_range", oracle(
    _collect_sql() + " WHERE pair_id IN (SELECT pair_id FROM pairs ORDER BY pair_id LIMIT 200 OFFSET 100)", PM_CTE), "INF3", "P8")
def q_collect_range(spark, sf_dir):
    """Collection of a row range [100, 300), two waves."""
    store = shared_dir(spark, "responses_range", unique=True)
    merged = INF.collect_responses(fx.pairs(spark, sf_dir), lambda: stubs.HashStubClient(fail_mod=11), store,
                                   start=100, end=300, wave_rows=100)
    return merged.select("pair_id", "label", "model_response", "reasoning_content")


@register("fit_pair_classifier", oracle(
    "SELECT pair_id, label, TRUE valid, TRUE above_base FROM splits WHERE split = 'test'"), "INF4")
def q_fit_pair_classifier(spark, sf_dir):
    """Fitted on train, chosen on dev, applied to test; every test pair gets a class and a probability.

    ``above_base``: the class-1 F1 on test is above that of calling every pair positive.
    """
    T.write_splits(fx.splits(spark, sf_dir), path := shared_dir(spark, "classifier_splits", unique=True))
    train, dev, test = (T.load_splits(spark, path, (name,)) for name in T.SPLITS)
    pred = staged(C.predict(C.fit(train, dev), test), "predicted")
    hit = F.count_if((F.col("label") == 1) & (F.col("pred") == 1))
    n_label, n_pred, n = F.sum("label"), F.sum("pred"), F.count(F.lit(1))
    better = pred.select(2 * hit / (n_label + n_pred) > 2 * n_label / (n_label + n)).scalar()
    return pred.select("pair_id", "label", (F.col("pred").isin(0, 1) & F.col("prob1").between(0, 1)).alias("valid"),
                       better.alias("above_base"))


# ---------------------------------------------------------------- §2.14 streaming form

@register("collect_stream", oracle(_collect_sql(), PM_CTE), "INF3", "IO13", "§2.14")
def q_collect_stream(spark, sf_dir):
    """The collection as a stream over a pair directory (availableNow), then merged."""
    from corefkit.streaming.collect_stream import collect_stream, collected_table

    base = shared_dir(spark, "stream", unique=True)
    p = fx.pairs(spark, sf_dir)
    with shuffles_dropped(spark):
        p.write.mode("overwrite").option("compression", COMPACT).parquet(f"{base}/pairs")
    collect_stream(spark, f"{base}/pairs", p.schema, lambda: stubs.HashStubClient(fail_mod=11),
                   f"{base}/responses", f"{base}/checkpoint")
    pairs = spark.read.parquet(f"{base}/pairs").select(F.col("pair_id").cast("string").alias("pair_id"), "label")
    return collected_table(spark, pairs, f"{base}/responses").select(
        "pair_id", "label", "model_response", "reasoning_content")
