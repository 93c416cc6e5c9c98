"""Training-curve and leaderboard tables.

The reference draws these as figures; here they are tables a plotting
tool (or a dashboard) reads. Windows are always partitioned: by run for
curves, by (run, step) for stacks, by metric for leaderboard marks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REWARD_PREFIX = "rewards/"
REWARD_SUFFIX = "_reward_func"
DEFAULT_EXCLUDE = ("int_reward_func",)
LEADERBOARD_METRICS = ("precision", "recall", "f1_score", "accuracy", "invalid_rate")
LOWER_IS_BETTER = ("invalid_rate",)


def reward_band(df: DataFrame) -> DataFrame:
    """C1 reward with a +/- one standard deviation band."""
    return df.withColumns({"lower": F.col("reward") - F.col("reward_std"),
                           "upper": F.col("reward") + F.col("reward_std")})


def reward_components(columns: Sequence[str], exclude: Sequence[str] = DEFAULT_EXCLUDE) -> list[str]:
    """P12 columns starting with ``rewards/`` whose name contains no excluded part."""
    return [c for c in columns if c.startswith(REWARD_PREFIX) and not any(x in c for x in exclude)]


def display_name(c: Column) -> Column:
    """P13 ``rewards/click_reward_func`` -> ``click``."""
    return F.replace(F.replace(c, F.lit(REWARD_PREFIX), F.lit("")), F.lit(REWARD_SUFFIX), F.lit(""))


def components_long(df: DataFrame, ids: Sequence[str] = ("run_id", "step"),
                    exclude: Sequence[str] = DEFAULT_EXCLUDE) -> DataFrame:
    """C2 long form ``(ids..., component, value)``; NULL values are kept."""
    comps = reward_components(df.columns, exclude)
    long = df.select(*ids, *[F.col(f"`{c}`").alias(c) for c in comps]).unpivot(
        list(ids), comps, "component_column", "value")
    return long.select(*ids, display_name(F.col("component_column")).alias("component"), "value")


def training_curves(df: DataFrame, metrics: Sequence[str] = ("completion_length", "learning_rate"),
                    ids: Sequence[str] = ("run_id", "step")) -> DataFrame:
    """C3 single-metric curves; a metric the log never recorded is NULL."""
    cols = [F.col(m) if m in df.columns else F.lit(None).cast("double").alias(m) for m in metrics]
    return df.select(*ids, *cols)


def reward_stack(df: DataFrame, ids: Sequence[str] = ("run_id", "step"),
                 exclude: Sequence[str] = DEFAULT_EXCLUDE) -> DataFrame:
    """W3/C4 stacked-area bounds: running sum of components within a step, plus the total."""
    long = components_long(df, ids, exclude)
    w = Window.partitionBy(*ids).orderBy("component").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stacked = long.withColumn("stack_top", F.sum("value").over(w))
    return stacked.join(df.select(*ids, "reward"), list(ids))


def rolling_mean(df: DataFrame, col: str = "reward", n: int = 10, by: Sequence[str] = ("run_id",),
                 order: str = "step") -> DataFrame:
    """W1/C5 mean of the last ``n`` rows; NULL until ``n`` non-NULL values are in the window."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(n - 1), 0)
    return df.withColumn(f"rolling_{col}", F.when(F.count(col).over(w) == n, F.avg(col).over(w)))


def leaderboard(metrics_docs: DataFrame, run_col: str = "tag", digits: int = 4) -> DataFrame:
    """C6 one row per run: coreferent P/R/F1, accuracy, invalid rate, rounded."""
    cr, am = "classification_report", "additional_metrics"
    r = lambda c: F.round(c, digits)
    return metrics_docs.select(
        F.col(run_col).alias("run"),
        r(F.col(f"{cr}.Coreferent.precision")).alias("precision"),
        r(F.col(f"{cr}.Coreferent.recall")).alias("recall"),
        r(F.col(f"{cr}.Coreferent.`f1-score`")).alias("f1_score"),
        r(F.col(f"{cr}.accuracy")).alias("accuracy"),
        r(F.col(f"{am}.invalid_rate")).alias("invalid_rate"),
    )


def leaderboard_marks(board: DataFrame, metrics: Sequence[str] = LEADERBOARD_METRICS,
                      lower_is_better: Sequence[str] = LOWER_IS_BETTER) -> DataFrame:
    """W4 best and worst run per metric, computed (the hand-marked table has errors)."""
    long = board.unpivot(["run"], list(metrics), "metric", "value")
    # One row per metric, combined map-side; the rows never meet in a task per metric.
    ends = long.groupBy("metric").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    long = long.join(ends, "metric")
    lo, hi = F.col("_lo"), F.col("_hi")
    low_good = F.col("metric").isin(list(lower_is_better))
    best = F.when(low_good, F.col("value") == lo).otherwise(F.col("value") == hi)
    worst = F.when(low_good, F.col("value") == hi).otherwise(F.col("value") == lo)
    return long.withColumns({"is_best": F.coalesce(best, F.lit(False)), "is_worst": F.coalesce(worst, F.lit(False))}
                            ).select("run", "metric", "value", "is_best", "is_worst")


def log_documents(runs: DataFrame, chunk_steps: int = 1000, run_col: str = "run_id") -> DataFrame:
    """Training-log documents ``{run_id, chunk, log_history: [...]}``.

    Entries are grouped per (run, step chunk), so no document - and no
    aggregation group - holds more than ``chunk_steps`` entries however
    long a run is. NULL keys are dropped by the JSON writer, so the keys of
    an entry vary as in real trainer logs.
    """
    cols = [c for c in runs.columns if c != run_col]
    entry = F.struct(*[F.col(f"`{c}`").alias(c) for c in cols])
    return runs.groupBy(run_col, F.floor(F.col("step") / chunk_steps).alias("chunk")).agg(
        F.sort_array(F.collect_list(entry)).alias("log_history"))
