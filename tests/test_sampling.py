"""Sampling, batching and ranking invariants."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corefkit.operators import sampling as S


def _ids(df, col="pair_id"):
    return sorted(r[0] for r in df.select(col).collect())


def test_sample_is_partition_independent(spark):
    base = spark.range(0, 5000).withColumnRenamed("id", "pair_id")
    samples = [_ids(S.sample_n(base.repartition(p), 300, 42)) for p in (1, 4, 16)]
    assert samples[0] == samples[1] == samples[2]
    assert len(samples[0]) == 300


def test_sample_equals_ordered_limit(spark):
    base = spark.range(0, 20000).withColumnRenamed("id", "pair_id")
    for n in (0, 1, 777, 19999, 20000, 25000):
        want = _ids(base.orderBy(S.rank_key("pair_id", 7), "pair_id").limit(n))
        assert _ids(S.sample_n(base, n, 7)) == want
        assert len(want) == min(n, 20000)


def test_sample_with_repeated_ids_and_bad_bounds(spark, monkeypatch):
    # keys that are not spread over their range: the bounds are set wider until they hold the cut
    base = spark.range(0, 3000).withColumnRenamed("id", "pair_id")
    monkeypatch.setattr(S, "rank_key", lambda c, *a: F.format_string("00000000%024d", F.col(c) % 1000))
    got = _ids(S.sample_n(base, 1234, 7))
    want = [r[0] for r in base.orderBy(F.col("pair_id") % 1000, "pair_id").limit(1234).collect()]
    assert got == sorted(want)


def test_strict_sample_of_too_few_rows_fails(spark):
    base = spark.range(0, 10).withColumnRenamed("id", "pair_id")
    with pytest.raises(ValueError):
        S.sample_n(base, 11, strict=True)
    assert S.sample_n(base, 10, strict=True).count() == 10 and S.sample_n(base, 11).count() == 10


def test_first_per_key_is_a_hash_aggregate_of_least_keys(spark):
    rows = [(f"id{k}", f"s{k % 37}" if k % 10 else None, "x" * 30) for k in range(900)]
    df = spark.createDataFrame(rows, "pair_id string, sentence1 string, more string")
    got = S.first_per_key(df, "sentence1", 5)
    w = Window.partitionBy("sentence1").orderBy(S.rank_key("pair_id", 5, "shuffle"), "pair_id")
    want = df.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_sample_fraction_exact_size(spark):
    base = spark.range(0, 1000).withColumnRenamed("id", "pair_id")
    assert S.sample_fraction(base, 0.1, 42).count() == 100


def test_balanced_keeps_all_positives(spark):
    base = spark.range(0, 3000).select(F.col("id").alias("pair_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    bal = S.balanced(base, 500, 42)
    assert bal.where("label = 1").count() == 300
    assert bal.where("label = 0").count() == 500


def test_positions_equal_row_number_under_skew(spark):
    # one shard holds most rows, ids spread over many position buckets
    df = spark.range(0, 300000, 7).select(
        F.col("id").alias("pair_id"), F.when(F.col("id") % 3 == 0, "b").otherwise("hot").alias("shard"))
    got = S.positions(df, "pair_id", ["shard"]).select("pair_id", "position")
    w = Window.partitionBy("shard").orderBy("pair_id")
    exp = df.select("pair_id", (F.row_number().over(w) - 1).alias("position"))
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_unique_sample_rules(spark):
    rows = [(i, f"s{i % 40}", f"t{i % 55}", int(i % 6 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "pair_id long, sentence1 string, sentence2 string, label int")
    out = S.unique_sample(df, 60, 42)
    assert out.count() == 60
    assert out.select("pair_id").distinct().count() == 60
    # more than the unique sentences available: all uniques plus positive top-up
    big = S.unique_sample(df, 150, 42)
    assert big.count() <= 150
    firsts = S.first_per_key(df, "sentence1", 42)
    assert firsts.count() == 40


def test_positions_keep_null_shards_and_keys(spark):
    rows = [(None, "a"), (1, "a"), (None, None), (5, None), (3, None), (2, "a"), (9, "b")]
    df = spark.createDataFrame(rows, "pair_id long, shard string")
    got = sorted((r.shard or "", -1 if r.pair_id is None else r.pair_id, r.position)
                 for r in S.positions(df, "pair_id", ["shard"]).collect())
    assert got == [("", -1, 0), ("", 3, 1), ("", 5, 2), ("a", -1, 0), ("a", 1, 1), ("a", 2, 2), ("b", 9, 0)]
    assert S.assign_batches(df, 2, "pair_id", ["shard"]).count() == 7


def test_positions_of_string_keys_with_few_prefixes(spark):
    df = spark.range(0, 50_000).select(F.format_string("row-%08d", "id").alias("key"), (F.col("id") % 7).alias("shard"))
    got = S.positions(df, "key", ["shard"])
    w = Window.partitionBy("shard").orderBy("key")
    exp = df.withColumn("position", (F.row_number().over(w) - 1).cast("long"))
    assert got.exceptAll(exp.select(got.columns)).count() == 0 and got.count() == 50_000
