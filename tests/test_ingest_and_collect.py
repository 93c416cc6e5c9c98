"""Raw ingest semantics and resumable collection."""

import collections
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from corefkit.operators import inference as INF
from corefkit.plans import stubs
from corefkit.plans import fixtures as fx
from corefkit.registry import entries
from corefkit.session import shared_dir
from corefkit.sources import raw_pairs as RP
from corefkit.sources.response_store import read_log
from tests.conftest import SF_SMALL


def _write(spark, df):
    path = shared_dir(spark, "test_raw", unique=True)
    df.write.text(path)
    return path


def test_duplicate_lines_get_distinct_ids(spark):
    lines = spark.createDataFrame([("a\tb",)] * 5 + [("c",)], "value string").repartition(3)
    ids = RP.assign_pair_ids(lines)
    assert ids.count() == 6 and ids.select("pair_id").distinct().count() == 6


def test_strict_cast_fails_on_bad_rows(spark):
    path = _write(spark, fx.raw_lines(spark, SF_SMALL, broken=True))
    raw = RP.read_raw_pairs(spark, path)
    with pytest.raises(Exception):
        RP.cast_pairs(raw, "strict").count()
    reasons = {r.reason for r in RP.quarantine(raw).collect()}
    assert reasons <= {"field_count", "bad_int:label"} and reasons
    ok = RP.cast_pairs(raw, "quarantine")
    # trigger end 999 is a valid number: kept, trigger NULL (out of bounds)
    assert ok.where(F.col("e1_trigger_end") == 999).where(F.col("e1_trigger").isNotNull()).count() == 0


def test_resume_calls_only_failed_rows(spark):
    store = shared_dir(spark, "test_collect", unique=True)
    pairs = fx.pairs(spark, SF_SMALL)

    def factory():
        return stubs.HashStubClient(fail_mod=5, fail_once=True)

    first = INF.collect_responses(pairs, factory, store)
    n = pairs.count()
    log1 = read_log(spark, store)
    failed = log1.where("error IS NOT NULL").count()
    assert log1.count() == n and failed > 0
    assert first.where("reasoning_content IS NULL").count() == failed
    second = INF.collect_responses(pairs, factory, store)
    log2 = read_log(spark, store)
    assert log2.count() == n + failed  # only the failed rows were called again
    assert log2.where("attempt = 2").count() == failed
    assert second.where("reasoning_content IS NULL").count() == 0


class _DyingClient(stubs.HashStubClient):
    """Ends the job, not the call, for one row of a later wave."""

    async def complete(self, content, attempt):
        if stubs._h(content) % 97 == 3:
            raise SystemExit("worker lost")
        return await super().complete(content, attempt)


def test_a_broken_wave_loses_only_itself(spark):
    store = shared_dir(spark, "test_waves", unique=True)
    pairs = fx.pairs(spark, SF_SMALL).where("pair_id % 3 = 0")
    with pytest.raises(Exception):
        INF.collect_responses(pairs, lambda: _DyingClient(fail_mod=10**9), store, wave_rows=20)
    kept = read_log(spark, store).count()
    n = pairs.count()
    assert kept < n
    INF.collect_responses(pairs, lambda: stubs.HashStubClient(fail_mod=10**9), store, wave_rows=20)
    log = read_log(spark, store)
    assert log.count() == n and log.where("attempt > 1").count() == 0  # answered rows were not called again


def test_a_row_that_cannot_be_prompted_is_logged(spark):
    store = shared_dir(spark, "test_null", unique=True)
    pairs = fx.pairs(spark, SF_SMALL).limit(30).withColumn(
        "e1_trigger", F.when(F.col("pair_id") % 3 != 0, F.col("e1_trigger")))
    pairs = spark.createDataFrame(pairs.collect(), pairs.schema)
    nulls = pairs.where("e1_trigger is null").count()
    merged = INF.collect_responses(pairs, lambda: stubs.HashStubClient(fail_mod=10**9), store)
    log = read_log(spark, store)
    assert nulls > 0 and merged.count() == 30 == log.count()
    assert log.where(F.col("error") == INF.NO_PROMPT).count() == nulls


def test_unreadable_store_is_not_an_empty_one(spark, tmp_path):
    assert read_log(spark, str(tmp_path / "none")).count() == 0
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        read_log(spark, str(bad)).count()


def test_hot_raw_line_is_spread(spark):
    import glob

    out = shared_dir(spark, "test_hot_line", unique=True)
    lines = spark.range(0, 30_000, numPartitions=4).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("line "), F.col("id"))).alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ids = RP.assign_pair_ids(lines).withColumn("task", F.spark_partition_id())
        ids.write.parquet(out)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = spark.read.parquet(out)
    assert got.count() == 30_000 == got.select("pair_id").distinct().count()
    assert got.where("value = 'hot'").agg(F.max(F.split("pair_id", ":")[1].cast("int"))).first()[0] == 9_999
    sizes = [r["count"] for r in got.groupBy("task").count().collect()]
    assert max(sizes) <= 2.5 * 30_000 / 8
    assert glob.glob(f"{out}/*.parquet")


def test_offsets_sent_by_files_give_the_same_ids(spark, monkeypatch):
    rows = [("train" if k % 3 else "dev", f"line {k % 17}") for k in range(600)]
    lines = spark.createDataFrame(rows, "split string, value string").repartition(6).persist()
    want = {(f"{hashlib.md5(v.encode()).hexdigest()}:{n}", s, v) for (s, v), c in collections.Counter(rows).items() for n in range(c)}
    for most in (10**9, 20):  # all offsets at once, and those of one partition after another
        monkeypatch.setattr(RP, "OFFSETS_SENT", most)
        ids = RP.assign_pair_ids(lines, by=["split"])
        plan = ids._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan, plan  # no line is shuffled
        got = [tuple(r) for r in ids.select("pair_id", "split", "value").collect()]
        assert len(got) == len(rows) and set(got) == want


def test_preprocess_splits_flow_keeps_only_what_it_saves(spark):
    base = shared_dir(spark)
    before = {os.path.join(d, f) for d, _, names in os.walk(base) for f in names}
    made = entries()["preprocess_splits_flow"].fn(spark, SF_SMALL)
    left = {os.path.join(d, f) for d, _, names in os.walk(base) for f in names} - before
    assert left and all("/preprocess_splits/" in f for f in left)
    assert {r.stage for r in made.collect()} == {"train", "dev", "test", "balanced", "sample"}
