"""What several operators share: word and byte conventions, staging, labels."""

from __future__ import annotations

import functools
import sys
import types
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corefkit.session import staged  # noqa: F401  (for the operators)

#: The white space of every contract: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named columns of ``documents``; other columns are never read."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. A pure-ASCII text takes the fast ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def per_worker(kind: str, key: str, make: Callable[[], object]) -> object:
    """What ``make`` builds, built once per Python worker and kept there for later tasks with the same ``key``.

    Functions travel by value, so their globals end with a task; the worker process
    itself holds the value. Of each kind the last key stays.
    """
    held = sys.modules.setdefault("_corefkit_llm_worker", types.ModuleType("_corefkit_llm_worker")).__dict__
    if held.get(kind, (None,))[0] != key:
        held.pop(kind, None)  # frees the one before first
        held[kind] = (key, make())
    return held[kind][1]


def conjunction(conditions: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, conditions)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32(doc_id as text) mod 5 = 0 (null: held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str,
                    bounds: dict[int, int]) -> tuple[DataFrame, dict[int, float]]:
    """Learnable labelled rows (doc_id, text, label), about ``bounds[value]`` of each label value at most.

    Also returns the share of each value that was taken. Rows are taken by the md5
    of the id, so the sample does not depend on the partitioning. Null labels and
    ids are left out; an id labelled twice takes its larger label, and of an id's
    documents the smallest text, so the bounds hold for rows.
    """
    value = (F.col(label) > 0).cast("int")
    picked = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max(value).alias("label")))
    have = {int(r["label"]): r["count"] for r in picked.groupBy("label").count().collect()}
    shares = {k: min(1.0, bound / max(1, have.get(k, 0))) for k, bound in bounds.items()}
    place = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("double") / 2.0**32
    limit = F.when(F.col("label") == 1, shares[1]).otherwise(shares[0])
    # the bounds hold for this side whatever the input, so it may be broadcast
    picked = F.broadcast(picked.where(place < limit))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(picked, "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label"), shares


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with their place in the order of ``keys`` as ``name``: 0, 1, 2, ... however they were partitioned.

    Range-partitioned and sorted rows are written with their place in their partition; the
    partitions' offsets are one number each, so they may be broadcast.
    """
    place = F.monotonically_increasing_id()  # partition << 33 | place in it
    parted = staged(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", place), "sorted")
    part = F.shiftright("_at", 33).alias("_part")
    sizes = parted.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return parted.withColumn("_part", part).join(F.broadcast(before), "_part").select(*rows.columns, number.alias(name))
