"""Model and API calls over Arrow batches (INF1-INF3).

The only Python in the hot path. Each function takes a *factory* that is
shipped to the workers and called once per Python worker and call (so a
second model never meets the first one's instance), then run on fixed-size
chunks of each Arrow batch. ``pair_id`` and any ``keep`` columns travel with
every row, so results never depend on position and need no join back (J4).

Calls are at-least-once: a lost executor re-runs its task. Collected
responses are therefore appended with an ``attempt`` number and merged by
latest successful attempt, which makes re-delivery harmless.
"""

from __future__ import annotations

import asyncio
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corefkit.functions.text import _c
from corefkit.functions.vectors import argmax, softmax
from corefkit.operators.joins import RESPONSE_COLUMNS, merge_responses
from corefkit.operators.prompts import PROMPT_INPUTS, api_prompts
from corefkit.operators.sampling import row_range
from corefkit.operators.workers import once_per_worker
from corefkit.session import COMPACT, delete, groups_of, shared_dir, shuffles_dropped, staged
from corefkit.sources.response_store import append_chunks, is_started, read_log, read_state


def _chunks(pdf: pd.DataFrame, size: int) -> Iterator[pd.DataFrame]:
    for i in range(0, len(pdf), size):
        yield pdf.iloc[i:i + size]


# ---------------------------------------------------------------- INF1


def _kept(df: DataFrame, columns: Sequence[str]) -> str:
    return "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def score_pairs(df: DataFrame, model_factory: Callable[[], Callable[[pd.DataFrame], np.ndarray]],
                batch_size: int = 512, id_col: str = "pair_id",
                inputs: tuple[str, ...] = ("input_ids", "attention_mask"), keep: Sequence[str] = ()) -> DataFrame:
    """INF1 logits per encoded pair; then class (S14) and probabilities (S15) as columns.

    ``model(batch) -> ndarray[n, k]`` sees a pandas frame with ``inputs``.
    Only ``id``, the ``keep`` columns and the logits come back, so wide inputs never shuffle.
    """
    model_of, carried = once_per_worker(model_factory), [id_col, *keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chunk in _chunks(pdf, batch_size):
                logits = np.asarray(model_of()(chunk[list(inputs)]), dtype="float64")
                yield chunk[carried].assign(logits=list(logits))

    id_type = df.schema[id_col].dataType.simpleString()
    out = df.select(*carried, *inputs).mapInPandas(run, f"{id_col} {id_type}{_kept(df, keep)}, logits array<double>")
    return out.withColumns({"pred": argmax("logits"), "probs": softmax("logits")})


# ---------------------------------------------------------------- INF2


def generate_responses(df: DataFrame, generator_factory: Callable[[], Callable[[list[str]], list[str | None]]],
                       prompt_col: str = "prompt", batch_size: int = 128, id_col: str = "pair_id",
                       keep: Sequence[str] = ()) -> DataFrame:
    """INF2 one completion per prompt, generated in batches of ``batch_size``; ``keep`` columns come along."""
    generator_of, carried = once_per_worker(generator_factory), [id_col, *keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chunk in _chunks(pdf, batch_size):
                yield chunk[carried].assign(completion=generator_of()(chunk[prompt_col].tolist()))

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(*carried, prompt_col).mapInPandas(run, f"{id_col} {id_type}{_kept(df, keep)}, completion string")


# ---------------------------------------------------------------- INF3

NO_PROMPT = "NoPrompt: a template input is NULL"


def _call_rows(pdf: pd.DataFrame, client, concurrency: int) -> pd.DataFrame:
    """One event loop per batch, ``concurrency`` calls in flight at any time; errors are kept per row."""

    async def gather() -> list:
        free = asyncio.Semaphore(concurrency)

        async def one(content, attempt):
            async with free:
                return await client.complete(content, int(attempt))

        calls = [one(c, a) for c, a in zip(pdf["content"], pdf["attempt"]) if c is not None]
        return await asyncio.gather(*calls, return_exceptions=True)

    results = iter(asyncio.run(gather()))
    rows = []
    for pid, att, content in zip(pdf["pair_id"], pdf["attempt"], pdf["content"]):
        res = next(results) if content is not None else None
        if content is None:
            rows.append((str(pid), int(att), None, None, NO_PROMPT))
        elif isinstance(res, BaseException):
            rows.append((str(pid), int(att), None, None, f"{type(res).__name__}: {res}"))
        else:
            rows.append((str(pid), int(att), res[0], res[1], None))
    return pd.DataFrame(rows, columns=["pair_id", "attempt", "model_response", "reasoning_content", "error"])


RESPONSE_SCHEMA = "pair_id string, attempt int, model_response string, reasoning_content string, error string"


def ask_pending(pairs: DataFrame, client_factory: Callable[[], object], store: str, concurrency: int = 50,
                tasks: int | None = None, wave_rows: int = 50_000) -> None:
    """INF3 ask for every row of ``pairs`` that has no successful reasoning in ``store`` yet, in waves.

    Pending = not done in the store's state, of which only the buckets of these ids
    are read (P5 as an anti join on one row per id). ``pairs`` is read once: what its prompts are made
    from is written where it is read, in files of at most ``wave_rows / tasks`` rows, and a wave is so many
    files that about ``wave_rows`` of their rows are pending. So no text is shuffled, each row is
    read once and only pending ones get a prompt, and nothing but ids is joined with the state. A wave is called and
    appended to ``store`` (IO13), so a failure loses the answers of one wave at
    most and calling again asks only for the rows still pending. The state is written
    after the last wave, and the files of the waves are deleted. At most
    ``tasks x concurrency`` calls are in flight (``tasks``: the session's default
    parallelism unless given). A row that cannot be prompted is logged as a
    failed attempt.
    """
    spark = pairs.sparkSession
    tasks = tasks or spark.sparkContext.defaultParallelism
    client_of = once_per_worker(client_factory)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield _call_rows(pdf.astype({"content": object}).where(pdf.notna(), None), client_of(), concurrency)

    path = shared_dir(spark, "prompt_waves", unique=True)
    try:
        # an explicit count: it bounds the calls in flight
        append_chunks((prompts.coalesce(tasks).mapInPandas(run, RESPONSE_SCHEMA)
                       for prompts in prompt_waves(pairs, store, wave_rows, tasks, path)), store)
    finally:
        delete(spark, path)


def prompt_waves(pairs: DataFrame, store: str, wave_rows: int, parts: int = 1, path: str | None = None) -> Iterator[DataFrame]:
    """The prompts (pair_id, attempt, content) of the pending rows, wave by wave, each from files of its own.

    The rows are written to ``path`` with at most ``wave_rows / parts`` in a file. Only the names of the files and their
    counts of pending rows come to the driver; the pending ids of a wave are sent to its rows.
    """
    spark = pairs.sparkSession
    path = path or shared_dir(spark, "prompt_waves", unique=True)
    inputs, folder = pairs.select(F.col("pair_id").cast("string").alias("pair_id"), *PROMPT_INPUTS), f"{path}/rows"
    with shuffles_dropped(spark):
        inputs.write.option("compression", COMPACT).option("maxRecordsPerFile", max(1, wave_rows // parts)).parquet(folder)
    ids = spark.read.schema(inputs.schema).parquet(folder).select("pair_id", F.col("_metadata.file_name").alias("file"))
    pending = _pending(ids, store, f"{path}/pending") if is_started(spark, store) else None
    counts = (ids if pending is None else pending).groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()
    for files in groups_of({r["file"]: r["n"] for r in counts}, wave_rows):
        rows = spark.read.schema(inputs.schema).parquet(*[f"{folder}/{f}" for f in files])
        if pending is None:
            rows = rows.withColumn("attempt", F.lit(1))
        else:
            asked = spark.read.schema("pair_id string, attempt int").parquet(*[f"{path}/pending/file={f}" for f in files])
            asked = asked.select(F.col("pair_id").alias("_id"), "attempt").distinct()
            # about wave_rows ids at most, so that they can be sent whatever the size of the table; an id may be NULL
            rows = rows.join(F.broadcast(asked), F.col("pair_id").eqNullSafe(F.col("_id")))
        yield api_prompts(rows).select("pair_id", "attempt", "content")


def _pending(ids: DataFrame, store: str, path: str) -> DataFrame:
    """The ids (pair_id, file) that are not done, with their next attempt, written by file to ``path``."""
    spark = ids.sparkSession
    state = read_state(ids.select("pair_id"), store)
    pending = ids.join(state, "pair_id", "left").where(~F.coalesce("done", F.lit(False))).select(
        "file", "pair_id", (F.coalesce("last", F.lit(0)) + 1).cast("int").alias("attempt"))
    with shuffles_dropped(spark):
        pending.repartition("file").write.partitionBy("file").parquet(path)
    return spark.read.schema("pair_id string, attempt int, file string").parquet(path)


def collect_responses(pairs: DataFrame, client_factory: Callable[[], object], store: str,
                      start: int = 0, end: int = -1, concurrency: int = 50,
                      tasks: int | None = None, wave_rows: int = 50_000) -> DataFrame:
    """INF3 resumable collection of the rows from ``start`` to ``end``: :func:`ask_pending`, then the merged table.

    ``pairs`` is read for its prompts and again by the merged table, which is lazy and no copy of it: a table that is
    costly to derive, or not the same each time, is best written first (:func:`corefkit.session.staged`).
    """
    rows = pairs if (start, end) == (0, -1) else staged(row_range(pairs, start, end), "collect_rows", compact=True)
    ask_pending(rows, client_factory, store, concurrency, tasks, wave_rows)
    key = rows.withColumn("pair_id", F.col("pair_id").cast("string"))
    return merge_responses(key, read_log(pairs.sparkSession, store))


def summary(merged: DataFrame, log: DataFrame) -> DataFrame:
    """A13 successful rows of all rows, and failed attempts of all attempts (one aggregate)."""
    rows = merged.select(F.lit(True).alias("is_row"), *[_c(c) for c in RESPONSE_COLUMNS],
                         F.lit(None).cast("string").alias("error"))
    att = log.select(F.lit(False).alias("is_row"), *[_c(c) for c in RESPONSE_COLUMNS], "error")
    u = rows.unionByName(att)
    r = F.col("is_row")
    return u.agg(
        F.count_if(r).alias("total_rows"),
        F.count_if(r & F.col("model_response").isNotNull() & F.col("reasoning_content").isNotNull())
        .alias("successful"),
        F.count_if(~r & F.col("error").isNotNull()).alias("failed_attempts"),
        F.count_if(~r).alias("attempts"),
    )
