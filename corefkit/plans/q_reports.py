"""Registered queries for training curves, logs and the leaderboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from corefkit.operators import curves as CV
from corefkit.plans import fixtures as fx
from corefkit.plans.oracle_ctes import oracle
from corefkit.plans.q_ingest import _DOC_CTES, metrics_documents
from corefkit.registry import register
from corefkit.session import shared_dir
from corefkit.sources import documents as D

_RUN_COLS = ("run_id, step, reward, reward_std, completion_length, \"rewards/click_reward_func\", "
             "\"rewards/view_reward_func\", \"rewards/int_reward_func\"")


@register("training_log_rows", oracle(f"SELECT {_RUN_COLS} FROM runs"), "IO9")
def q_training_log_rows(spark, sf_dir):
    path = shared_dir(spark, "training_logs", unique=True)
    CV.log_documents(fx.runs(spark, sf_dir)).write.mode("overwrite").json(path)
    rows = D.read_training_logs(spark, path, multiline=False, run_col="run_id")
    return rows.select("run_id", "step", "reward", "reward_std", "completion_length",
                       "`rewards/click_reward_func`", "`rewards/view_reward_func`", "`rewards/int_reward_func`")


@register("rolling_reward", oracle(
    """SELECT run_id, step, reward, CASE WHEN count(reward) OVER w = 10 THEN round(avg(reward) OVER w, 9) END rolling_reward
       FROM runs WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""),
    "W1", "C5")
def q_rolling_reward(spark, sf_dir):
    r = CV.rolling_mean(fx.runs(spark, sf_dir), "reward", 10)
    return r.select("run_id", "step", "reward", F.round("rolling_reward", 9).alias("rolling_reward"))


@register("reward_band", oracle(
    "SELECT run_id, step, reward, reward - reward_std lower, reward + reward_std upper FROM runs"), "C1")
def q_reward_band(spark, sf_dir):
    return CV.reward_band(fx.runs(spark, sf_dir)).select("run_id", "step", "reward", "lower", "upper")


_LONG = """SELECT run_id, step, 'click' component, "rewards/click_reward_func" AS value FROM runs
    UNION ALL SELECT run_id, step, 'view' component, "rewards/view_reward_func" AS value FROM runs"""


@register("reward_components_long", oracle(_LONG), "C2", "P12", "P13")
def q_reward_components_long(spark, sf_dir):
    return CV.components_long(fx.runs(spark, sf_dir))


@register("training_curves", oracle(
    "SELECT run_id, step, completion_length, CAST(NULL AS DOUBLE) learning_rate FROM runs"), "C3")
def q_training_curves(spark, sf_dir):
    return CV.training_curves(fx.runs(spark, sf_dir))


@register("reward_stack", oracle(
    f"""SELECT l.run_id, l.step, component, value,
            round(sum(value) OVER (PARTITION BY l.run_id, l.step ORDER BY component
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) stack_top, r.reward
        FROM ({_LONG}) l JOIN runs r ON l.run_id = r.run_id AND l.step = r.step"""), "W3", "C4")
def q_reward_stack(spark, sf_dir):
    s = CV.reward_stack(fx.runs(spark, sf_dir))
    return s.select("run_id", "step", "component", "value", F.round("stack_top", 9).alias("stack_top"), "reward")


_BOARD = """SELECT source run, round(precision1, 4) AS precision, round(recall1, 4) AS recall, round(f1_1, 4) f1_score,
        round(accuracy, 4) accuracy, round(invalid_rate, 4) invalid_rate FROM rc2"""


def _board(spark, sf_dir):
    path = shared_dir(spark, "leaderboard", unique=True)
    D.write_metrics(metrics_documents(spark, sf_dir), path)
    return CV.leaderboard(D.read_metrics(spark, path))


@register("leaderboard", oracle(_BOARD, *_DOC_CTES), "C6", "IO10", "IO8")
def q_leaderboard(spark, sf_dir):
    return _board(spark, sf_dir)


@register("leaderboard_marks", oracle(
    """SELECT run, metric, value,
        coalesce(CASE WHEN metric = 'invalid_rate' THEN value = min(value) OVER w ELSE value = max(value) OVER w END, FALSE) is_best,
        coalesce(CASE WHEN metric = 'invalid_rate' THEN value = max(value) OVER w ELSE value = min(value) OVER w END, FALSE) is_worst
       FROM (UNPIVOT (""" + _BOARD + """) ON precision, recall, f1_score, accuracy, invalid_rate
             INTO NAME metric VALUE value)
       WINDOW w AS (PARTITION BY metric)""", *_DOC_CTES), "W4", "C6")
def q_leaderboard_marks(spark, sf_dir):
    return CV.leaderboard_marks(_board(spark, sf_dir))
