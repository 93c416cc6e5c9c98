"""Response collection as a Structured Streaming job (§2.14).

New pair files landing in a directory are picked up by ``readStream``;
each micro-batch runs the resumable collection (pending rows only). It looks its
ids up in the store's bucketed state, so what a batch reads depends on the batch
and not on what was collected before. The stream checkpoint records which files were
processed, so a restarted job neither skips nor re-reads input, and the
response merge (latest successful attempt) keeps re-delivered batches
idempotent. ``availableNow`` processes everything present and stops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corefkit.operators.inference import ask_pending
from corefkit.operators.joins import merge_responses
from corefkit.sources.response_store import read_log


def collect_stream(spark: SparkSession, pairs_dir: str, schema, client_factory: Callable[[], object],
                   store: str, checkpoint: str, concurrency: int = 50,
                   max_files_per_trigger: int | None = None) -> None:
    """Run the collection over every pair file in ``pairs_dir`` not yet processed."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(pairs_dir)

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        # read once, for its prompts, so it needs no copy
        ask_pending(batch, client_factory, store, concurrency)

    q = (stream.writeStream.foreachBatch(per_batch)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()


def collected_table(spark: SparkSession, pairs: DataFrame, store: str) -> DataFrame:
    """The pair table with the collected responses merged in."""
    return merge_responses(pairs, read_log(spark, store))
