"""Substring dedup: Rabin-Karp hashes of every window of ``WINDOW`` words, counted in Spark.

A word goes if it lies in a window whose word sequence also starts somewhere
else, in another document or the same one. Repeated windows merge into maximal
intervals; windows are judged on the input, not on what is left.

1. Documents are dealt into batches by a hash of the row (not of the source or
   the text alone, so a large group of copies spreads over all batches).
2. Each batch computes the rolling hash of all its windows and sends every
   distinct one, twice if it occurs twice there, to the bucket that a second,
   independent rolling hash names. A window that a third of all documents share
   is two entries per batch.
3. Each bucket finds the hashes that came more than once and answers the batches
   that sent them.
4. Each batch meets its answers and cuts its texts.

Only the 8-byte hashes of step 2 travel besides the batches themselves, whose
exchange steps 2 and 4 share. Hashes are equal with certainty only if windows
are; two different windows meet by chance with probability 2^-64 per pair of one
bucket, and the number of buckets grows with the input, so at any size fewer
than one false window is expected. Batches and buckets are sized by ``plan_size``
so that the pieces between them stay packed.

Null and empty texts have no words. Repeated rows are documents of their own.
Texts shorter than a window lose nothing.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corefkit.llm.common import documents

WINDOW = 35
#: Text bytes of a batch and of the windows of a bucket: at least this, growing with the root of the input.
MIN_BYTES = 2 << 20
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so they have inverses modulo 2^64


def plan_size(total_bytes: int) -> int:
    """Bytes per batch: a batch and a bucket then share 64 windows on average, 200 MB at 100 TB."""
    return max(MIN_BYTES, math.isqrt(400 * total_bytes))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def rolling(words: np.ndarray, window: int, base: int) -> np.ndarray:
    """Rabin-Karp modulo 2^64 of every window: sum of words[i + j] * base^-j."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    inverse = pow(base, -1, 1 << 64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(inverse, len(words)), dtype=np.uint64)])
    return (sums[window:] - sums[:-window]) * _powers(base, n)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _bucket_of(second: np.ndarray, buckets: int) -> np.ndarray:
    mixed = second ^ (second >> np.uint64(29))
    mixed = (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
    return (mixed % np.uint64(buckets)).astype(np.int64)


def _ask(window: int, buckets: int):
    """A batch's distinct window hashes by bucket."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = [], []
        for raw in pdf.raw:
            words = word_hashes((raw or b"").split())
            first.append(rolling(words, window, BASES[0]))
            second.append(rolling(words, window, BASES[1]))
        first, second = np.concatenate(first), np.concatenate(second)
        hashes, at, times = np.unique(first, return_index=True, return_counts=True)
        bucket = _bucket_of(second[at], buckets)
        order = np.argsort(bucket, kind="stable")
        hashes, bucket, times = hashes[order], bucket[order], np.minimum(times[order], 2)
        names, starts = np.unique(bucket, return_index=True)
        parts = [np.repeat(h, t).tobytes() for h, t in zip(np.split(hashes, starts[1:]), np.split(times, starts[1:]))]
        return pd.DataFrame({"bucket": names, "batch": int(pdf.batch.iloc[0]), "hashes": parts[:len(names)]})

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each batch that sent to this bucket: its hashes that came more than once."""
    asked = [np.frombuffer(x, np.uint64) for x in pdf.hashes]
    together = np.concatenate(asked)
    seen = np.sort(together)
    twice = np.unique(seen[1:][seen[1:] == seen[:-1]])
    hit = twice[np.minimum(np.searchsorted(twice, together), len(twice) - 1)] == together if len(twice) else np.zeros(
        len(together), dtype=bool)
    ends = np.cumsum([len(x) for x in asked])[:-1]
    found = [np.unique(x[h]).tobytes() for x, h in zip(asked, np.split(hit, ends))]
    out = pd.DataFrame({"batch": pdf.batch, "hashes": found})
    return out[out.hashes.map(len) > 0]


def _cut(window: int, with_text: bool):
    """Cut a batch's texts at the windows that its answers name."""

    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        repeated = np.sort(np.frombuffer(b"".join(answers.hashes), np.uint64))
        rows = []
        for doc_id, raw in zip(docs.doc_id, docs.raw):
            words = (raw or b"").split()
            hashes = rolling(word_hashes(words), window, BASES[0]) if len(repeated) else ()
            spans, kept = [], words
            if len(hashes):
                at = np.searchsorted(repeated, hashes)
                starts = np.flatnonzero(repeated[np.minimum(at, len(repeated) - 1)] == hashes)
                spans = merged(starts, window)
                if spans:
                    ends = [0, *(e for _, e in spans)]
                    kept = [w for a, b in zip(ends, [*(s for s, _ in spans), len(words)]) for w in words[a:b]]
            text = b" ".join(kept)
            row = (doc_id, len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest())
            rows.append(row + (text.decode(), [list(map(int, s)) for s in spans]) if with_text else row)
        return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256"]
                            + ["kept_text", "spans"] * with_text)

    return run


def merged(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal word intervals that the windows at ``starts`` (ascending) cover."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > window)
    first = starts[np.concatenate([[0], breaks + 1])]
    last = starts[np.concatenate([breaks, [len(starts) - 1]])] + window
    return list(zip(first.tolist(), last.tolist()))


def cut_repeats(docs: DataFrame, window: int = WINDOW, batch_bytes: int | None = None, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, if asked, kept_text and spans (in words)."""
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    size = batch_bytes or plan_size(total)
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    batches, buckets = max(1, parallel, math.ceil(total / size)), max(1, parallel, math.ceil(total / size))
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("raw"),
                       F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).alias("batch"))
    asked = rows.groupBy("batch").applyInPandas(_ask(window, buckets), "bucket long, batch long, hashes binary")
    answers = asked.groupBy("bucket").applyInPandas(_answer, "batch long, hashes binary")
    schema = "doc_id string, n_words long, n_removed long, kept_sha256 string"
    schema += ", kept_text string, spans array<array<long>>" * with_text
    out = rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(_cut(window, with_text), schema)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(documents(spark, sf_dir, "doc_id", "text"), with_text=False)
