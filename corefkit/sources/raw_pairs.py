"""Raw tab-separated pair files (IO1-IO4).

One record per line: strip the line, split on TAB, 23 positional fields
(25 with two leading event ids). The CSV reader is not used: quotes are
plain text here.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corefkit.functions.spans import with_triggers
from corefkit.functions.text import let, strip
from corefkit.session import groups_of, scratch, staged

# The positional field names of the raw pair format.
RAW_FIELDS = [
    "sentence1",
    "e1_trigger_start", "e1_trigger_end",
    "e1_participant1_start", "e1_participant1_end",
    "e1_participant2_start", "e1_participant2_end",
    "e1_time_start", "e1_time_end",
    "e1_loc_start", "e1_loc_end",
    "sentence2",
    "e2_trigger_start", "e2_trigger_end",
    "e2_participant1_start", "e2_participant1_end",
    "e2_participant2_start", "e2_participant2_end",
    "e2_time_start", "e2_time_end",
    "e2_loc_start", "e2_loc_end",
    "label",
]
ID_FIELDS = ["event_id_1", "event_id_2"]
REQUIRED_INT = ["e1_trigger_start", "e1_trigger_end", "e2_trigger_start", "e2_trigger_end", "label"]
OPTIONAL_INT = [f for f in RAW_FIELDS if f.endswith(("_start", "_end")) and f not in REQUIRED_INT]


#: Offsets that are sent to all tasks at once (about 10 MB).
OFFSETS_SENT = 1 << 18


def field_names(with_ids: bool) -> list[str]:
    return (ID_FIELDS if with_ids else []) + RAW_FIELDS


def assign_pair_ids(lines: DataFrame, col: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """``pair_id = md5(line) ':' ordinal`` among identical lines (of one ``by`` group).

    Identical lines are identical rows, so any numbering of them gives the
    same set of (id, line). Lines stay where they are read: a task numbers the copies of
    each line in its partition and writes them out with that number; ``lines`` is not read after that. Counts per (hash,
    partition) give each partition its offset; only hashes are shuffled for it. Offsets above
    0, of lines with copies in several partitions, then are sent to the lines: all at once if they are few, else
    to the files of some partitions after another (:func:`_offset_by_files`). The lines are never shuffled.
    """
    spark = lines.sparkSession
    key = F.md5(F.concat_ws("\x00", *[F.col(c) for c in by], F.md5(col))) if by else F.md5(col)
    keyed = lines.select(*by, F.spark_partition_id().alias("_part"), F.unhex(key).alias("_k"), F.col(col).alias("_line"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields)
    with scratch(spark) as kept:
        rows = staged(keyed.mapInArrow(_number_copies, f"{fields}, _ord long"), "raw_lines", compact=True)
        counts = rows.groupBy("_k", "_part").agg((F.max("_ord") + 1).alias("_n"))
        before = F.sum("_n").over(Window.partitionBy("_k").orderBy("_part")) - F.col("_n")
        offsets = staged(counts.select("_k", "_part", before.alias("_off")).where("_off > 0"), "raw_offsets", compact=True)
        if offsets.count() <= OFFSETS_SENT:
            numbered = rows.join(F.broadcast(offsets), ["_k", "_part"], "left").drop("_k", "_part")
            kept.update(("raw_lines", "raw_offsets"))
        else:
            numbered = staged(_offset_by_files(rows, offsets), "raw_numbered", compact=True)
            kept.add("raw_numbered")
    number = (F.coalesce("_off", F.lit(0)) + F.col("_ord")).cast("string")
    return numbered.select(F.concat(F.md5("_line"), F.lit(":"), number).alias("pair_id"), *by, F.col("_line").alias(col))


def _offset_by_files(rows: DataFrame, offsets: DataFrame) -> Iterator[DataFrame]:
    """``rows`` with their ``_off``, the files of some partitions at a time, with at most ``OFFSETS_SENT`` offsets.

    A file of ``rows`` holds rows of one partition. Only names and counts of files come to the driver.
    """
    name = F.col("_metadata.file_name")
    files = {r["_part"]: r["names"] for r in rows.select("_part", name.alias("name")).groupBy("_part").agg(
        F.collect_set("name").alias("names")).collect()}
    counts = {r["_part"]: r["n"] for r in offsets.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    # in order of partitions, so that each step reads the offsets of its own
    offsets = staged(offsets.repartitionByRange("_part").sortWithinPartitions("_part"), "raw_offsets", compact=True)
    for parts in groups_of({p: counts.get(p, 0) for p in files}, OFFSETS_SENT):
        own = offsets.where(F.col("_part").between(parts[0], parts[-1]))
        lines = rows.where(name.isin([f for p in parts for f in files[p]]))
        yield lines.join(F.broadcast(own), ["_k", "_part"], "left").drop("_k", "_part")


def _number_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many copies of each line the partition had before it, as ``_ord``."""
    seen: dict[str, int] = {}
    for batch in batches:
        order = []
        for k in batch.column("_k").to_pylist():
            n = seen.get(k, 0)
            seen[k] = n + 1
            order.append(n)
        yield batch.append_column("_ord", pa.array(order, pa.int64()))


def split_fields(lines: DataFrame, with_ids: bool | Column = False, col: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """IO1/IO2/IO4 ``line.strip().split('\\t')`` into named string fields.

    Short rows get NULLs on the right (as pandas pads); ``n_fields`` keeps
    the count so callers can reject rows of the wrong width. ``with_ids`` may be
    a condition per row: rows without event ids get NULL ids, which count as fields. A
    line is split once, whatever reads its fields.
    """
    mixed = isinstance(with_ids, Column)
    names = field_names(mixed or with_ids)
    skip = F.when(with_ids, 0).otherwise(len(ID_FIELDS)) if mixed else F.lit(0)
    parts = F.split(strip(F.col(col)), "\t", -1)
    row = let(F.struct(parts.alias("p"), skip.alias("skip")), lambda x: F.struct(
        (F.size(x["p"]) + x["skip"]).alias("n_fields"),
        *[F.get(x["p"], F.lit(i) - x["skip"]).alias(n) for i, n in enumerate(names)]))
    return lines.select("pair_id", *keep, F.inline(F.array(row)))


def read_raw_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw lines as the text source gives them (one row per line, lazily split by file blocks)."""
    return spark.read.text(path)


def read_raw_pairs(spark: SparkSession, path: str | list[str], with_ids: bool = False) -> DataFrame:
    """IO1/IO2 raw pair files -> ``pair_id`` + string fields."""
    return split_fields(assign_pair_ids(read_raw_lines(spark, path)), with_ids)


def read_raw_splits(spark: SparkSession, path: str, split_col: str = "split", ids_in: str = "test", mode: str = "strict") -> DataFrame:
    """IO1-IO3 for a folder per split (``split=train``, ...), all in one pass: typed pairs with their ``split``.

    Lines of the split ``ids_in`` carry event ids. Copies of a line are numbered within their split.
    """
    lines = assign_pair_ids(read_raw_lines(spark, path), by=[split_col])
    raw = split_fields(lines, F.col(split_col) == ids_in, keep=[split_col])
    return cast_pairs(raw, mode)


def _int(name: str, strict: bool) -> Column:
    c = F.col(name)
    return c.cast("int") if strict else F.expr(f"try_cast(`{name}` as int)")


def cast_pairs(raw: DataFrame, mode: str = "strict") -> DataFrame:
    """IO3 typed pair table plus ``e1_trigger``, ``e2_trigger``, ``length``.

    ``strict``: the 4 trigger offsets and the label are cast with ANSI
    ``cast`` and a bad value or a row of the wrong width fails the job, as
    the reference does. ``quarantine``: bad rows are left out (see
    :func:`quarantine`). The 16 optional offsets are ``try_cast`` (NULL when
    absent or not a number) in both modes.
    """
    n_expected = len([c for c in raw.columns if c in RAW_FIELDS or c in ID_FIELDS])
    if mode == "strict":
        checked = raw.where(F.when(F.col("n_fields") == n_expected, F.lit(True))
                            .otherwise(F.raise_error(F.concat(F.lit("wrong field count in row "),
                                                              F.col("pair_id")))))
        typed = checked.withColumns({c: _int(c, True) for c in REQUIRED_INT})
    elif mode == "quarantine":
        typed = raw.withColumns({c: _int(c, False) for c in REQUIRED_INT})
        ok = F.col("n_fields") == n_expected
        for c in REQUIRED_INT:
            ok = ok & F.col(c).isNotNull()
        typed = typed.where(ok)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    typed = typed.withColumns({c: _int(c, False) for c in OPTIONAL_INT}).drop("n_fields")
    return with_triggers(typed)


def quarantine(raw: DataFrame) -> DataFrame:
    """IO3 the rejected rows with a reason: ``field_count`` or ``bad_int:<field>``."""
    n_expected = len([c for c in raw.columns if c in RAW_FIELDS or c in ID_FIELDS])
    bad_int = F.lit(None).cast("string")
    for c in reversed(REQUIRED_INT):
        bad_int = F.when(F.expr(f"try_cast(`{c}` as int)").isNull(), F.lit(f"bad_int:{c}")).otherwise(bad_int)
    reason = F.when(F.col("n_fields") != n_expected, F.lit("field_count")).otherwise(bad_int)
    return raw.select("pair_id", reason.alias("reason")).where(F.col("reason").isNotNull())
