"""Splittable reading of CSV whose quoted fields hold line breaks (IO5).

A reader that must find the quotes from the start of a file reads it in one task. Here
files are read as lines by their splits, and two small facts join them up:

1. One aggregate counts the quotes per split. Quotes come in pairs in a field (a quote inside
   is written twice), so a split starts inside a field exactly when the quotes before
   it in its file are odd. That is a number per split; those that start inside are sent to all
   tasks (at most one entry per ``spark.sql.files.maxPartitionBytes`` of input).
2. Each task joins lines to records where quotes are open. Lines of a record that began
   in an earlier split or goes on in the next are fragments, at most two per split;
   only these are shuffled, by file, and joined in order.

Quotes occur only in quoted fields, as CSV writers make them. Blank lines between records
are skipped, a line end may be LF or CRLF.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corefkit.functions.text import occurrences

RECORDS = "record string, file string, start long, header boolean"


def read_records(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """The records of CSV files as text, one per row (``record``), without the header of each file."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    quotes = lines.groupBy("file", "start").agg((F.sum(occurrences("value", '"')) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = quotes.withColumn("inside", F.sum("odd").over(before) % 2 == 1).where("inside").select("file", "start")
    shared = spark.sparkContext.broadcast({(r.file, r.start) for r in inside.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _join_lines(batches, shared.value, header)

    found = lines.withColumn("split", F.xxhash64("file", "start")).mapInArrow(run, RECORDS)
    if not shared.value:  # no record crosses a split; at most an unclosed one ends a file
        return found.where("record != '' and not coalesce(header, false)").select("record")
    whole = found.where("file is null").select("record")
    at = Window.partitionBy("file").orderBy("start", "order")
    parts = found.where("file is not null").withColumn("order", F.when(F.col("header").isNull(), 0).otherwise(1))
    number = F.sum("order").over(at.rowsBetween(Window.unboundedPreceding, 0))
    joined = (parts.withColumn("number", number).groupBy("file", "number")
              .agg(F.sort_array(F.collect_list(F.struct("start", "record"))).alias("parts"), F.bool_or("header").alias("header"))
              .where(~F.coalesce("header", F.lit(False))))
    record = F.regexp_replace(F.array_join(F.col("parts.record"), "\n"), "\r$", "")
    return whole.unionByName(joined.select(record.alias("record"))).where(F.col("record") != "")


def _join_lines(batches: Iterator[pa.RecordBatch], inside: set, header: bool) -> Iterator[pa.RecordBatch]:
    """Whole records (no file) and fragments (file, start; header null where an earlier split began the record)."""
    split, file, start, is_open, cut, skip, lines = None, None, None, False, False, False, []

    def rest() -> Iterator[pa.RecordBatch]:
        if lines:
            yield _fragment("\n".join(lines), file, start, None if cut else skip)

    for batch in batches:
        splits = batch.column("split").to_numpy()
        edges = [0, *(np.flatnonzero(splits[1:] != splits[:-1]) + 1).tolist(), len(splits)]
        for low, high in zip(edges, edges[1:]):
            if low == high:
                continue
            if splits[low] != split:
                yield from rest()
                split, file, start = splits[low], batch.column("file")[low].as_py(), batch.column("start")[low].as_py()
                is_open = cut = (file, start) in inside
                skip, lines = header and start == 0, []
            values = batch.column("value").slice(low, high - low)
            odd = pc.count_substring(values, '"').to_numpy(zero_copy_only=False) % 2
            if not odd.any() and not is_open and not skip:
                yield _records(values)
                continue
            whole = []
            for line, o in zip(values.to_pylist(), odd.tolist()):
                lines.append(line)
                is_open ^= bool(o)
                if is_open:
                    continue
                if cut:
                    yield _fragment("\n".join(lines), file, start, None)
                elif not skip:
                    whole.append("\n".join(lines))
                cut, skip, lines = False, False, []
            yield _records(pa.array(whole, pa.string()))
    yield from rest()


def _records(values: pa.Array) -> pa.RecordBatch:
    n = len(values)
    values = pc.replace_substring_regex(values, "\r$", "") if n and pc.any(pc.ends_with(values, "\r")).as_py() else values
    return pa.RecordBatch.from_arrays([values, pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())],
                                      ["record", "file", "start", "header"])


def _fragment(text: str, file: str, start: int, header: bool | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"record": pa.array([text], pa.string()), "file": pa.array([file], pa.string()),
                                       "start": pa.array([start], pa.int64()), "header": pa.array([header], pa.bool_())})
