"""Exact dedup by deterministic block naming.

Every normalised text is cut into blocks of ``BLOCK_BYTES`` bytes. The distinct
blocks are sorted and numbered, so equal blocks get one integer and different
blocks never share one. Adjacent integers are then paired, the distinct pairs
numbered in the same way, and so on until one integer is left per document: its
(round, integer) is equal for two documents exactly when their texts are equal.

* Texts cross the network once, as distinct blocks (map-side deduplicated, so a
  block that a third of all documents share is one row per task). Everything
  else moves rows of a few integers, grouped by (doc_id, text_sha256).
* The shuffle key of a block is a 64-bit hash, but the name belongs to the block
  itself: blocks that share a hash are told apart by their bytes.
* Blocks are sorted by (hash, bytes), pairs by their integers, over all partitions,
  and numbered 0, 1, 2, ... in that order, so the names depend on the texts alone. They are
  staged in the shared folder before use.

Null texts count as empty; an empty text is one empty block. Of equal texts the
largest doc_id stays (a null id is the smallest); of repeated rows with this id
exactly one. Other columns are not read and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corefkit.llm.common import ascii_lower, documents, numbered, staged

BLOCK_BYTES = 4096
#: Rows of one repeated (doc_id, text) that one array may hold while they are written out again.
COPIES = 10_000
#: Rows per Arrow batch handed back, so a batch stays at a few MB.
OUT_ROWS = 1024


def block_hash(block: bytes) -> int:
    """A signed 64-bit shuffle key; equal blocks need not differ from others in it."""
    return xxhash.xxh64_intdigest(block) - (1 << 63)


def _cutter(size: int, hash_of: Callable[[bytes], int], with_blocks: bool):
    """mapInArrow function: (doc_id, bytes) -> blocks, or their hashes and places."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = (raw.as_py() or b"").lower()
                starts = range(0, len(text), size) if text else (0,)
                if with_blocks:
                    seen = {}
                    for at in starts:
                        seen[text[at:at + size]] = None
                    rows += [(hash_of(b), b) for b in seen]
                else:
                    digest = hashlib.sha256(text).hexdigest()
                    rows += [(doc_id, digest, len(starts), k, hash_of(text[at:at + size]))
                             for k, at in enumerate(starts)]
                if len(rows) >= OUT_ROWS:
                    yield _batch(rows, with_blocks)
                    rows = []
            if rows:
                yield _batch(rows, with_blocks)

    return cut


def _batch(rows: list[tuple], with_blocks: bool) -> pa.RecordBatch:
    if with_blocks:
        kinds = {"h": pa.int64(), "block": pa.binary()}
    else:
        kinds = {"doc_id": pa.int64(), "text_sha256": pa.string(), "n": pa.int32(), "pos": pa.int32(), "h": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], list(kinds))


def _named_pairs(pairs: DataFrame) -> DataFrame:
    """(l, r) -> integer, one per distinct pair, in their order."""
    return staged(numbered(pairs.select("l", "r").distinct(), ["l", "r"], "name"), "names")


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES,
               hash_of: Callable[[bytes], int] = block_hash) -> DataFrame:
    """One row per distinct (doc_id, text_sha256): how often it occurs, and its identity (level, name)."""
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))

    blocks = raw.mapInArrow(_cutter(block_bytes, hash_of, True), "h long, block binary")
    # of a hash with one block only the hash is sorted and named
    distinct = (blocks.groupBy("h").agg(F.collect_set("block").alias("blocks"))
                .select("h", F.size("blocks").alias("alike"), F.explode("blocks").alias("block"))
                .select("h", F.when(F.col("alike") > 1, F.col("block")).alias("block")))
    names = staged(numbered(distinct, ["h", "block"], "name"), "blocks")

    places = (raw.mapInArrow(_cutter(block_bytes, hash_of, False),
                             "doc_id long, text_sha256 string, n int, pos int, h long")
              .groupBy("doc_id", "text_sha256", "n", "pos", "h").agg(F.count(F.lit(1)).alias("copies")))
    current = places.join(names.where(F.col("block").isNull()).select("h", "name"), "h").drop("h")
    alike = names.where(F.col("block").isNotNull())
    if not alike.isEmpty():  # hashes shared by different blocks: these few go by their bytes
        current = current.unionByName(_places_by_bytes(raw, alike, block_bytes, hash_of))
    current = staged(current, "level0")

    level, done = 0, []
    while True:
        done.append(current.where("n = 1").select("doc_id", "text_sha256", "copies", F.lit(level).alias("level"), "name"))
        rest = current.where("n > 1")
        if rest.isEmpty():
            break
        half = F.col("pos") % 2
        pairs = staged(
            rest.groupBy("doc_id", "text_sha256", F.expr("int((n + 1) div 2)").alias("n"),
                         F.expr("int(pos div 2)").alias("pos"))
            .agg(F.max("copies").alias("copies"),
                 F.max(F.when(half == 0, F.col("name"))).alias("l"),
                 F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(-1)).alias("r")),
            "pairs")
        level += 1
        current = pairs.join(_named_pairs(pairs), ["l", "r"]).select("doc_id", "text_sha256", "n", "pos", "copies", "name")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _places_by_bytes(raw: DataFrame, alike: DataFrame, size: int, hash_of) -> DataFrame:
    """Places of blocks whose hash several different blocks share, named by hash and bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = (value.as_py() or b"").lower()
                starts, digest = range(0, len(text), size) if text else (0,), hashlib.sha256(text).hexdigest()
                rows += [(doc_id, digest, len(starts), k, hash_of(text[at:at + size]), text[at:at + size])
                         for k, at in enumerate(starts)]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            for k in range(0, len(rows), OUT_ROWS):
                columns = [pa.array(c, t) for c, t in zip(zip(*rows[k:k + OUT_ROWS]), kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_sha256", "n", "pos", "h", "block"])

    places = raw.mapInArrow(cut, "doc_id long, text_sha256 string, n int, pos int, h long, block binary")
    return (places.join(alike, ["h", "block"])
            .groupBy("doc_id", "text_sha256", "n", "pos", "name").agg(F.count(F.lit(1)).alias("copies"))
            .select("doc_id", "text_sha256", "n", "pos", "copies", "name"))


def exact_groups(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    named = staged(identities(docs, **options), "identities")
    # staged, so that the join below shuffles both sides anew and a large group's rows can be split over tasks
    groups = staged(named.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")),
                    "groups")
    rows = (named.join(groups, ["level", "name"])
            .withColumn("first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"), F.lit(COPIES).cast("long"))))
            .withColumn("copy", F.explode(F.sequence("first", F.least("copies", F.col("first") + (COPIES - 1))))))
    return rows.select("doc_id", "keep_id", "group_size",
                       (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; of repeated rows the one with the smallest JSON."""
    verdict = exact_groups(docs)
    kept = verdict.where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    # the row in one struct, so that its columns may have any name
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(whole, F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256).alias("key"))
    match = F.col("row.doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__sha"))
    rows = keyed.join(kept, match, "left_semi")
    repeated = (verdict.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
                .select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")))
    if repeated.isEmpty():
        return rows.select("row.*")
    once = (rows.join(repeated, match, "left_semi").groupBy(F.col("row.doc_id").alias("__id"), "key")
            .agg(F.min_by("row", F.to_json("row")).alias("row")).select("row"))
    return rows.join(repeated, match, "left_anti").select("row").unionByName(once).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir, "doc_id", "text"))


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm),
r AS (SELECT d.*, row_number() OVER (PARTITION BY d.norm, d.doc_id) AS copy FROM d)
SELECT r.doc_id, g.keep_id, g.group_size,
       (r.doc_id IS NOT DISTINCT FROM g.keep_id AND r.copy = 1) AS kept, r.text_sha256
FROM r JOIN g USING (norm)
"""
