"""Store of collected responses (IO13): an append-only log and a compact state bucketed by id.

``<path>/chunk-<number>/`` holds the attempts of one wave, one commit each (the state is written once for the waves of a call), keyed by
``(pair_id, attempt)``. A retried wave only delivers rows again, which the merge
(latest attempt per id) makes harmless.

``<path>/_state/`` says which ids were asked how often and which are done, without any
response text, in folders by the hash of the id. A lookup reads only the folders of its
ids. When the buckets hold more than twice ``BUCKET_ROWS`` rows on average, a new
generation is written with one row per id and as many buckets as that takes, so a lookup of m
ids reads at most about m * 2 * ``BUCKET_ROWS`` rows, however large the store is. A generation
is written when the state has doubled, so over all waves each row is copied about
twice.

Every recorded chunk leaves an empty marker in the generation. Chunks without one (the driver was
lost between the two commits) are recorded at the next lookup. One writer at a time.
"""

from __future__ import annotations

import re

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESPONSE_LOG_SCHEMA = ("pair_id string, attempt int, model_response string, reasoning_content string, "
                       "error string")
STATE_SCHEMA = "pair_id string, attempt int, done boolean"
BUCKET_ROWS = 4096
FIRST_BUCKETS = 16


def append_chunk(df: DataFrame, path: str) -> None:
    """Commit one chunk of responses and record its ids in the state."""
    append_chunks([df], path)


def append_chunks(chunks: Iterable[DataFrame], path: str) -> None:
    """Commit every chunk as it comes, and record the ids of all of them in the state after the last one.

    The state is only read by lookups, so it is written once for them all: written after each chunk, every
    chunk would add a file to every bucket. If a chunk fails, those before it are recorded at the next lookup.
    """
    spark, numbers = None, []
    for df in chunks:
        if spark is None:
            spark = df.sparkSession
            first = max(_chunks(spark, path), default=-1) + 1
        number = first + len(numbers)
        df.write.parquet(_chunk(path, number))
        numbers.append(number)
    if numbers:
        _record(spark, path, numbers)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All committed attempts (empty when nothing was collected yet)."""
    try:
        return spark.read.schema(RESPONSE_LOG_SCHEMA).option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise  # a store that can't be read must not look like one where nothing was collected
        return spark.createDataFrame([], RESPONSE_LOG_SCHEMA)


def is_started(spark: SparkSession, path: str) -> bool:
    """Whether anything was collected yet."""
    return bool(_chunks(spark, path))


def read_state(ids: DataFrame, path: str) -> DataFrame:
    """pair_id, last (attempt) and done of the ids' buckets: at least of every id that was asked.

    Only the numbers of the buckets that ``ids`` falls into come to the driver.
    """
    spark = ids.sparkSession
    lost = sorted(set(_chunks(spark, path)) - set(_recorded(spark, path)))
    if lost:
        _record(spark, path, lost)
    found = _state_files(ids, path)
    if not found:
        return spark.createDataFrame([], "pair_id string, last int, done boolean")
    rows = spark.read.schema(STATE_SCHEMA).option("basePath", found[0].rsplit("/", 1)[0]).parquet(*found)
    return rows.groupBy("pair_id").agg(F.max("attempt").alias("last"), F.bool_or("done").alias("done"))


def bucket_of(pair_id: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(pair_id) if isinstance(pair_id, str) else pair_id), F.lit(buckets)).cast("int")


# ---------------------------------------------------------------- layout


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    fs, where = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def _chunk(path: str, number: int) -> str:
    return f"{path}/chunk-{number:09d}"


def _chunks(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed chunks."""
    fs, _ = _files(spark, path)
    new = spark._jvm.org.apache.hadoop.fs.Path
    names = sorted(n for n in _names(spark, path) if n.startswith("chunk-"))
    # all but the last were followed by another, which only a committed one is
    if names and not fs.exists(new(f"{path}/{names[-1]}/_SUCCESS")):
        fs.delete(new(f"{path}/{names.pop()}"), True)
    return [int(n[len("chunk-"):]) for n in names]


def _generation(spark: SparkSession, path: str) -> tuple[str, int, int, int] | None:
    """Folder, buckets, first chunk that it does not cover and rows at its start, of the last whole generation."""
    fs, _ = _files(spark, path)
    for name in sorted((n for n in _names(spark, f"{path}/_state") if n.startswith("gen-")), reverse=True):
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_state/{name}/_SUCCESS")):
            _, _, buckets, chunk, rows = name.split("-")
            return f"{path}/_state/{name}", int(buckets), int(chunk), int(rows)
    return None


def _markers(spark: SparkSession, folder: str) -> dict[int, int]:
    """Rows by number of the chunks recorded in a generation."""
    found = (re.fullmatch(r"(\d+)-(\d+)", n) for n in _names(spark, f"{folder}/_recorded"))
    return {int(m[1]): int(m[2]) for m in found if m}


def _recorded(spark: SparkSession, path: str) -> list[int]:
    now = _generation(spark, path)
    return [] if now is None else [*range(now[2]), *_markers(spark, now[0])]


def _state_files(ids: DataFrame, path: str) -> list[str]:
    """The folders of the state that can hold ``ids``."""
    now = _generation(ids.sparkSession, path)
    if now is None:
        return []
    folder, buckets, _, _ = now
    wanted = {r[0] for r in ids.select(bucket_of("pair_id", buckets)).distinct().collect()}
    there = {n for n in _names(ids.sparkSession, folder) if n.startswith("bucket=")}
    return [f"{folder}/{n}" for n in sorted(there & {f"bucket={b}" for b in wanted})]


def _write_generation(rows: DataFrame, path: str, number: int, buckets: int, first: int, n: int) -> str:
    folder = f"{path}/_state/gen-{number:06d}-{buckets}-{first}-{n}"
    _write_state(rows, folder, buckets, "overwrite")
    return folder


def _write_state(rows: DataFrame, folder: str, buckets: int, mode: str) -> None:
    (rows.withColumn("bucket", bucket_of("pair_id", buckets)).repartition("bucket")
     .write.mode(mode).partitionBy("bucket").parquet(folder))


def _record(spark: SparkSession, path: str, numbers: list[int]) -> None:
    """Add the ids of chunks to the state; start a new generation when the buckets have grown too full."""
    rows = spark.read.schema(RESPONSE_LOG_SCHEMA).parquet(*[_chunk(path, k) for k in numbers]).select(
        "pair_id", "attempt", F.col("reasoning_content").isNotNull().alias("done"))
    n = rows.count()
    now = _generation(spark, path)
    if now is None:
        buckets = _buckets_for(n)
        folder, first, before = _write_generation(rows, path, 0, buckets, 0, 0), 0, 0
    else:
        folder, buckets, first, before = now
        _write_state(rows, folder, buckets, "append")
    for k in numbers:  # the first stands for the rows of all
        fs, marker = _files(spark, f"{folder}/_recorded/{k}-{n if k == numbers[0] else 0}")
        fs.create(marker, True).close()
    markers = _markers(spark, folder)
    total = before + sum(markers.values())
    whole = len(markers) + first == max(markers) + 1  # a new generation covers all chunks up to the last recorded
    if total > 2 * BUCKET_ROWS * buckets and whole:
        one = spark.read.schema(STATE_SCHEMA).parquet(folder).groupBy("pair_id").agg(
            F.max("attempt").alias("attempt"), F.bool_or("done").alias("done"))
        ids = one.count()
        generation = int(folder.rsplit("gen-", 1)[1].split("-")[0]) + 1
        _write_generation(one, path, generation, max(buckets, _buckets_for(ids)), max(markers) + 1, ids)


def _buckets_for(rows: int) -> int:
    buckets = FIRST_BUCKETS
    while buckets * BUCKET_ROWS < rows:
        buckets *= 2
    return buckets
