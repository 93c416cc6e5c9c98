"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "corefkit") -> SparkSession:
    """A session with the settings this library assumes.

    ANSI mode stays on (Spark 4 default) so casts raise where the reference
    raises; AQE coalesces small shuffles and splits skewed join partitions.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": os.environ.get("COREFKIT_DRIVER_MEMORY", "8g"),
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, *parts: str, unique: bool = False) -> str:
    """A folder under the cluster's shared checkpoint directory.

    The directory comes from ``spark.checkpoint.dir``; only when that is
    unset on a local master (unit tests, a laptop) is a local temporary folder created and
    registered, so ``DataFrame.checkpoint()`` works the same way.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="corefkit-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    path = "/".join([base.rstrip("/"), "corefkit", *parts])
    if unique:
        path = f"{path}/{uuid.uuid4().hex}"
    return path


_STAGED: list[str] = []
#: Codec of large intermediate files: about two thirds of the bytes of Spark's default for text.
COMPACT = "zstd"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries run inside delete their shuffle files as they end, and not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def staged(df: DataFrame | Iterable[DataFrame], name: str, compact: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, whoever reads it, and safe from lost executors.

    Several frames of one schema are written one after another, to one table.

    The folder stays until :func:`clear_staged` or the end of a :func:`scratch`, since lazy results read it. ``compact``
    is for whole tables of text: written with :data:`COMPACT`, and the shuffles behind them do not stay beside them.
    """
    path = None
    for part in [df] if isinstance(df, DataFrame) else df:
        spark, schema = part.sparkSession, part.schema
        if path is None:
            path = shared_dir(spark, "staged", name, unique=True)
            _STAGED.append(path)
        if compact:
            with shuffles_dropped(spark):
                part.write.mode("append").option("compression", COMPACT).parquet(path)
        else:
            part.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[set[str]]:
    """Deletes the folders that :func:`staged` writes inside, but for those whose names are put into the set it gives."""
    before, kept = set(_STAGED), set()
    try:
        yield kept
    finally:
        for path in [p for p in _STAGED if p not in before and p.split("/")[-2] not in kept]:
            _STAGED.remove(path)
            delete(spark, path)


def groups_of(counts: Mapping, most: int) -> Iterator[list]:
    """The keys of ``counts`` in order, in groups whose counts add up to ``most`` at most; a larger one stands alone."""
    group, total = [], 0
    for key in sorted(counts):
        if group and total + counts[key] > most:
            yield group
            group, total = [], 0
        group.append(key)
        total += counts[key]
    if group:
        yield group


def clear_staged(spark: SparkSession) -> int:
    """Delete the folders that :func:`staged` wrote for this driver; results not yet written out that read them are lost.

    Returns how many folders there were.
    """
    n = len(_STAGED)
    while _STAGED:
        delete(spark, _STAGED.pop())
    return n
