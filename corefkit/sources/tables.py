"""Pair tables on disk: CSV interchange, Parquet default, split layout (IO5-IO7, IO11, IO12)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corefkit.session import COMPACT
from corefkit.sources.csv_records import read_records

# Quote and escape are both '"' so quotes and newlines inside text survive;
# blanks at the ends of fields are kept.
CSV_WRITE = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
             "ignoreTrailingWhiteSpace": "false"}
CSV_READ = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "mode": "FAILFAST"}

SPLITS = ("train", "dev", "test")


def write_pairs_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """IO6 CSV with a header and no index column."""
    df.write.mode(mode).options(**CSV_WRITE).csv(path)


def read_pairs_csv(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """IO5 CSV with an explicit schema (no inference pass over the data).

    Quoted fields may hold line breaks, and yet a large file is read by as many tasks as
    it has splits (:func:`read_records`).
    """
    fields = spark.createDataFrame([], schema).schema.fields
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return read_records(spark, path).select(F.from_csv("record", ddl, CSV_READ).alias("row")).select("row.*")


def write_splits(df: DataFrame, path: str, split_col: str = "split", mode: str = "overwrite") -> None:
    """Write a pair table partitioned by split, so reading one split prunes the others."""
    df.write.mode(mode).option("compression", COMPACT).partitionBy(split_col).parquet(path)


def load_splits(spark: SparkSession, path: str, splits: tuple[str, ...] = SPLITS,
                split_col: str = "split") -> DataFrame:
    """IO7 balanced-train, dev and test as one table with a ``split`` column.

    The filter on the partition column is pruned at planning time: only
    the requested split folders are listed and read.
    """
    return spark.read.parquet(path).where(F.col(split_col).isin(list(splits)))


def load_split_paths(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet",
                     schema: StructType | str | None = None) -> DataFrame:
    """IO7 for one folder per split: union of reads with a literal ``split`` column."""
    out = None
    for name, p in paths.items():
        if fmt == "csv" and schema is not None:
            d = read_pairs_csv(spark, p, schema)
        else:
            r = spark.read.format(fmt)
            if schema is not None:
                r = r.schema(schema)
            if fmt == "csv":
                r = r.options(**CSV_READ)
            d = r.load(p)
        d = d.withColumn("split", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def export_jsonl(df: DataFrame, path: str, cols: tuple[str, ...], mode: str = "overwrite") -> None:
    """IO11/IO12 a training set as JSON lines (``text`` or ``prompt, answer``)."""
    df.select(*cols).write.mode(mode).json(path)
