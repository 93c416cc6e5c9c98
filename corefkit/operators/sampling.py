"""Seeded, partition-independent sampling, shuffling and batching.

Randomness is a hash order: ``md5('<seed>:[<salt>:]<id>')`` with the id as
tie-break. A draw is therefore the same at any partitioning and on any
retry, and DuckDB can restate it. Ids are unique and not null. Every operator that
reads its input more than once writes it once with the keys it needs, so select the
columns you want before sampling. Nothing here ranks all rows in one partition
or collects rows to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from corefkit.session import staged

#: Bits of a key that :func:`_cut` reads as a number.
PLACE_BITS = 60


def rank_key(id_col: str | Column, seed: int = 42, salt: str | None = None) -> Column:
    """``md5('<seed>:[<salt>:]<id>')``: the random order of a row."""
    idc = F.col(id_col) if isinstance(id_col, str) else id_col
    prefix = f"{seed}:" if salt is None else f"{seed}:{salt}:"
    return F.md5(F.concat(F.lit(prefix), idc.cast("string")))


def sample_n(df: DataFrame, n: int, seed: int = 42, salt: str | None = None,
             id_col: str = "pair_id", strict: bool = False) -> DataFrame:
    """T1 exactly ``n`` rows without replacement (all rows when fewer).

    The rows are written once with their keys. The n-th smallest (key, id) is found by
    :func:`_cut`, and the sample is a filter on it, so no task ever holds n rows,
    whatever n is. ``strict`` fails when fewer than ``n`` rows exist, as the
    reference does.
    """
    rows = _ranked(df, seed, salt, id_col)
    return rows.where(_drawn(rows, n, id_col, strict)).drop("_rk")


def _ranked(df: DataFrame, seed: int, salt: str | None, id_col: str) -> DataFrame:
    """The rows with their keys ``_rk``, written once."""
    return staged(df.withColumn("_rk", rank_key(id_col, seed, salt)), "ranked_rows", compact=True)


def _drawn(rows: DataFrame, n: int, id_col: str, strict: bool = False) -> Column:
    """A condition on (_rk, id) that the ``n`` smallest of ``rows`` meet."""
    keys = rows.select("_rk", F.col(id_col).alias("_id"))
    total = keys.count()
    if strict and total < n:
        raise ValueError(f"sample of {n} larger than population of {total}")
    if n <= 0 or n >= total:
        return F.lit(n > 0)
    cut = _cut(keys, n, total)
    return (F.col("_rk") < cut["_rk"]) | ((F.col("_rk") == cut["_rk"]) & (F.col(id_col) <= F.lit(cut["_id"])))


def _cut(keys: DataFrame, n: int, total: int) -> Row:
    """The n-th smallest (_rk, _id) of ``total``, for 0 < n < total.

    Keys are md5 sums, so the n-th lies near n / total of their range. One pass counts
    the keys below and above two bounds six standard deviations away; they hold the n-th,
    or are set wider. Only the keys between them, about 12 sqrt(n) of all, are
    ranked, grouped so that equal ones are one row.
    """
    place = F.conv(F.substring("_rk", 1, PLACE_BITS // 4), 16, 10).cast("bigint")
    share = n / total
    slack = (6 * math.sqrt(n * (1 - share)) + 6) / total
    while True:
        low, high = (min(max(-1, int(x * 2**PLACE_BITS)), 2**PLACE_BITS) for x in (share - slack, share + slack))
        found = keys.agg(F.count_if(place <= low).alias("below"), F.count_if(place <= high).alias("upto")).first()
        if found["below"] < n <= found["upto"]:
            break
        slack *= 8
    between = keys.where((place > low) & (place <= high)).groupBy("_rk", "_id").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.orderBy("_rk", "_id")) + found["below"]
    return between.withColumn("_n", upto).where(F.col("_n") >= n).select(F.min(F.struct("_rk", "_id")).alias("cut")).first()["cut"]


def sample_fraction(df: DataFrame, frac: float, seed: int = 42, salt: str | None = None,
                    id_col: str = "pair_id") -> DataFrame:
    """T2 ``round_half_even(frac * count)`` rows exactly (not Bernoulli)."""
    rows = _ranked(df, seed, salt, id_col)
    n = rows.select(F.bround(F.lit(float(frac)) * F.count(F.lit(1))).cast("bigint")).first()[0]
    return rows.where(_drawn(rows, n, id_col)).drop("_rk")


def shuffle_keyed(df: DataFrame, seed: int = 42, id_col: str = "pair_id", salt: str = "shuffle") -> DataFrame:
    """T3 a seeded full shuffle as a sort key; order by it (range partitioning) only when writing."""
    return df.withColumn("shuffle_key", rank_key(id_col, seed, salt))


def first_per_key(df: DataFrame, key: str, seed: int = 42, salt: str = "shuffle",
                  id_col: str = "pair_id") -> DataFrame:
    """W2 the first row per ``key`` in the seeded shuffled order.

    The least rank per key is one fixed-width number, so it is a hash aggregate
    with partial sums per task, whatever the rows hold; a semi join on it brings the rows.
    """
    rows = staged(df.withColumn("_first", rank_number(id_col, seed, salt)), "first_rows")
    return _firsts(rows, key).drop("_first")


def rank_number(id_col: str | Column, seed: int = 42, salt: str | None = None) -> Column:
    """The first 120 bits of :func:`rank_key` as a decimal: the same order, in a fixed width."""
    hexes = rank_key(id_col, seed, salt)
    high, low = (F.conv(F.substring(hexes, k, 15), 16, 10).cast("decimal(19,0)") for k in (1, 16))
    return (high * F.lit(1 << 60).cast("decimal(19,0)") + low).cast("decimal(38,0)")


def _firsts(rows: DataFrame, key: str) -> DataFrame:
    least = rows.groupBy(key).agg(F.min("_first").alias("_first")).select("_first")
    return rows.join(least, "_first", "left_semi").select(*rows.columns)


def balanced(df: DataFrame, n_negative: int, seed: int = 42, label: str = "label",
             id_col: str = "pair_id", strict: bool = False) -> DataFrame:
    """T4 all positives plus ``n_negative`` sampled negatives, with a shuffle key."""
    rows = _ranked(df, seed, None, id_col)
    negative = F.col(label) == 0
    drawn = _drawn(rows.where(negative), n_negative, id_col, strict)
    return shuffle_keyed(rows.where((F.col(label) == 1) | (negative & drawn)).drop("_rk"), seed, id_col)


def unique_sample(df: DataFrame, n: int, seed: int = 42, label: str = "label",
                  id_col: str = "pair_id", data_cols: Sequence[str] | None = None) -> DataFrame:
    """T5 a diversity sample of ``n`` rows.

    First row per sentence1 and per sentence2 (shuffled order); ``min(n,
    size)`` of each; union without exact duplicates; then ``n`` of those, or
    all of them topped up with unsampled positives. Each draw has its own salt. The
    input is written once; the draws per sentence carry ids only.
    """
    data_cols = list(data_cols or [c for c in df.columns if c != id_col])
    rows = staged(df.withColumn("_first", rank_number(id_col, seed, "shuffle")), "diversity_input", compact=True)
    u1, u2 = (sample_n(_firsts(rows, key).select(id_col), n, seed, salt, id_col)
              for key, salt in (("sentence1", "s1"), ("sentence2", "s2")))
    rows = rows.drop("_first")
    drawn = rows.join(u1.unionByName(u2), id_col, "left_semi").select(*rows.columns)
    combined = staged(distinct_rows(drawn, data_cols, id_col), "diversity_union")
    out = sample_n(combined, n, seed, "final", id_col)
    short = n - combined.count()
    if short > 0:
        remaining = rows.where(F.col(label) == 1).join(combined.select(id_col), id_col, "left_anti").select(*rows.columns)
        out = out.unionByName(sample_n(remaining, short, seed, "topup", id_col))
    return shuffle_keyed(out, seed, id_col)


def distinct_rows(df: DataFrame, data_cols: Sequence[str], id_col: str | None = "pair_id") -> DataFrame:
    """U2 drop rows equal in ``data_cols``; the smallest id survives (deterministic)."""
    if id_col is None:
        return df.dropDuplicates(list(data_cols))
    return df.groupBy(*data_cols).agg(F.min(id_col).alias(id_col)).select(*df.columns)


def oversample_positives(df: DataFrame, k: int, label: str = "label") -> DataFrame:
    """T8 each positive ``k`` times (``copy_no`` 1..k), negatives once."""
    return df.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.when(F.col(label) == 1, k).otherwise(1))))


def positions(df: DataFrame, order_col: str, by: Sequence[str] = ()) -> DataFrame:
    """0-based ``position`` of each row in ``order_col`` order within ``by``.

    Rows are range-partitioned on (by, order_col), which splits a hot shard for any
    key type, and written with their partition number. Rows are numbered within
    (partition, by); offsets come from the table of counts per (partition, by). A
    NULL shard is a shard and a NULL key comes first; no row is lost.
    """
    parted = staged(df.repartitionByRange(*by, order_col).withColumn("_part", F.spark_partition_id()), "positions")
    counts = parted.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_pc"))
    before = F.sum("_pc").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_pc")
    offsets = counts.select(F.col("_part").alias("_opart"), *[F.col(c).alias(f"_o_{c}") for c in by], before.alias("_off"))
    ranked = parted.withColumn("_rn", F.row_number().over(Window.partitionBy("_part", *by).orderBy(order_col)))
    same = F.col("_part") == F.col("_opart")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    out = ranked.join(offsets, same)
    return out.withColumn("position", F.col("_off") + F.col("_rn") - 1).select(*df.columns, "position")


def assign_batches(df: DataFrame, batch_size: int, order_col: str = "pair_id",
                   by: Sequence[str] = ()) -> DataFrame:
    """T6 ``batch_id = position // batch_size`` within each shard, in order."""
    p = positions(df, order_col, by)
    return p.withColumn("batch_id", F.floor(F.col("position") / F.lit(batch_size)).cast("bigint"))


def row_range(df: DataFrame, start: int = 0, end: int = -1, order_col: str = "pair_id") -> DataFrame:
    """P8 rows ``[start, end)`` in ``order_col`` order; ``end=-1`` means to the end."""
    p = positions(df, order_col)
    cond = F.col("position") >= start
    if end != -1:
        cond = cond & (F.col("position") < end)
    return p.where(cond).drop("position")
