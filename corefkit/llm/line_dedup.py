"""Line dedup with sharded cuckoo filters backed by exact reference counts.

A line's key is the line with blanks stripped at both ends and A-Z lower-cased;
keys of at least ``MIN_CHARS`` code points count. ``LineIndex`` keeps, all in the
shared folder and all of new versions written beside the old,

* references: which document holds which key (a 128-bit digest of it),
* counts: the exact number of documents per key and the largest of their ids,
* filters: one cuckoo filter per shard of keys, holding the *listed* keys, those
  that at least ``min_docs`` documents hold.

``insert`` and ``delete`` change the counts by what the given documents hold and
move only the keys that cross ``min_docs`` into or out of the filters (a cuckoo
filter, unlike a Bloom filter, can give a key back), so deleting what was
inserted restores every earlier answer. A full filter is rebuilt at twice the
size from the counts. The largest id of a key is looked up again only for keys
that lost a document.

``dedup`` probes the filters, and only what passes goes to the exact counts, which
decide; false positives of a filter cost a lookup, never a line. Filters of
``MAX_FILTER_BYTES`` together at most are broadcast and probed where the lines are.
Larger ones stay where they are: the distinct keys of the lines go to the filter of
their shard, in parts of about ``PROBE_KEYS`` keys, so a task holds one filter and one part.

Counting is a partial aggregation, so a line that a third of all documents hold
is one row per task. Null and empty texts are one empty line. A key counts once
per row of the table: repeated rows are documents of their own that share an id.
Null ids are smaller than any other.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corefkit.functions.text import let
from corefkit.llm.common import BLANKS, ascii_lower, documents, staged

MIN_DOCS, MIN_CHARS = 3, 20
#: Listed keys per shard that a new index is laid out for.
SHARD_KEYS = 1 << 14
MAX_FILTER_BYTES = 64 << 20
#: Distinct keys that one task probes against the filter of a shard.
PROBE_KEYS = 1 << 20
SLOTS, LOAD, KICKS = 4, 0.84, 500
KEY = ["k1", "k2"]


class CuckooFilter:
    """Sixteen-bit fingerprints in buckets of four; a key lives in one of two buckets. 0 marks a free slot."""

    def __init__(self, table: np.ndarray):
        self.table = table  # buckets x SLOTS, the number of buckets a power of two

    @classmethod
    def sized_for(cls, n: int) -> CuckooFilter:
        return cls(np.zeros((1 << max(1, int(np.ceil(np.log2(max(1, n) / (SLOTS * LOAD))))), SLOTS), dtype=np.uint16))

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, dtype=np.uint16).reshape(-1, SLOTS).copy())

    def insert(self, k1: int, k2: int, rng: random.Random) -> bool:
        """False if no place was found; the filter must then be rebuilt."""
        table, mask = self.table, len(self.table) - 1
        mark, here, there = (int(x[0]) for x in places(np.array([k1]), np.array([k2]), np.array([mask])))
        for bucket in (here, there):
            free = np.flatnonzero(table[bucket] == 0)
            if len(free):
                table[bucket, free[0]] = mark
                return True
        bucket = rng.choice((here, there))
        for _ in range(KICKS):
            slot = rng.randrange(SLOTS)
            mark, table[bucket, slot] = int(table[bucket, slot]), mark
            bucket ^= other(mark) & mask
            free = np.flatnonzero(table[bucket] == 0)
            if len(free):
                table[bucket, free[0]] = mark
                return True
        return False

    def delete(self, k1: int, k2: int) -> None:
        """Only for keys that were inserted."""
        mark, here, there = (int(x[0]) for x in places(np.array([k1]), np.array([k2]), np.array([len(self.table) - 1])))
        for bucket in (here, there):
            at = np.flatnonzero(self.table[bucket] == mark)
            if len(at):
                self.table[bucket, at[0]] = 0
                return

    def insert_all(self, k1: np.ndarray, k2: np.ndarray, rng: random.Random) -> bool:
        return all(self.insert(a, b, rng) for a, b in zip(k1.tolist(), k2.tolist()))


def other(mark):
    """What a fingerprint adds (xor) to one of its buckets to give the other."""
    return mark * 0x5BD1E995 >> 8


def places(k1: np.ndarray, k2: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint and both buckets of keys, for filters of mask + 1 buckets."""
    mark = ((k2.astype(np.int64) >> 40) & 0xFFFF)
    mark = np.where(mark == 0, 1, mark)
    here = (k2.astype(np.int64) & 0x7FFFFFFF) & mask
    return mark, here, here ^ (other(mark) & mask)


class Filters:
    """The filters of all shards as one array, for probing many keys at once."""

    def __init__(self, shards: int, tables: dict[int, bytes]):
        sizes = np.array([len(tables.get(s, b"")) // (2 * SLOTS) for s in range(shards)], dtype=np.int64)
        self.shards, self.mask, self.first = shards, np.maximum(sizes, 1) - 1, np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.empty = sizes == 0
        self.table = np.frombuffer(b"".join(tables.get(s, b"") for s in range(shards)) or bytes(2 * SLOTS),
                                   dtype=np.uint16).reshape(-1, SLOTS)

    def probe(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        shard = np.mod(k1, self.shards)
        mark, here, there = places(k1, k2, self.mask[shard])
        first, mark = np.where(self.empty[shard], 0, self.first[shard]), mark[:, None]
        found = (self.table[first + here] == mark).any(axis=1) | (self.table[first + there] == mark).any(axis=1)
        return found & ~self.empty[shard]


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter from its listed keys, at the smallest size that takes them all."""
    pdf, n = pdf.sort_values(KEY), len(pdf)
    while True:
        made = CuckooFilter.sized_for(n)
        if made.insert_all(pdf.k1.to_numpy(), pdf.k2.to_numpy(), random.Random(len(pdf))):
            return pd.DataFrame({"shard": [int(pdf.shard.iloc[0])], "data": [made.table.tobytes()]})
        n *= 2


def _change(old: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after taking out and putting in keys; null data if it is full."""
    shard = int(old.shard.iloc[0] if len(old) else moves.shard.iloc[0])
    held = CuckooFilter.from_bytes(old.data.iloc[0]) if len(old) else CuckooFilter.sized_for(len(moves))
    moves = moves.sort_values(KEY)
    for a, b in moves.loc[~moves.listed, KEY].itertuples(index=False):
        held.delete(a, b)
    new = moves[moves.listed]
    fits = held.insert_all(new.k1.to_numpy(), new.k2.to_numpy(), random.Random(len(new)))
    return pd.DataFrame({"shard": [shard], "data": [held.table.tobytes() if fits else None]})


def line_keys(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """array of (pos, k1, k2): the lines with a key long enough."""
    lines = F.transform(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)))
    marked = F.transform(lines, lambda x, k: F.struct(
        k.alias("pos"), F.xxhash64(x).alias("k1"), F.xxhash64(F.lit("second"), x).alias("k2"),
        (F.char_length(x) >= min_chars).alias("long")))
    return F.transform(F.filter(marked, lambda m: m["long"]), lambda m: F.struct(m["pos"].alias("pos"), m["k1"].alias("k1"),
                                                                                m["k2"].alias("k2")))


def _keyed(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row, keys): row tells texts of one id apart."""
    return staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"),
                              line_keys(F.col("text"), min_chars).alias("keys")), "line_keys")


def _references(keyed: DataFrame) -> DataFrame:
    held = F.array_distinct(F.transform("keys", lambda m: F.struct(m["k1"].alias("k1"), m["k2"].alias("k2"))))
    return keyed.select("doc_id", F.inline(held))


@dataclass
class LineIndex:
    """One version of the index; ``insert`` and ``delete`` give the next."""

    references: DataFrame  # doc_id, k1, k2
    counts: DataFrame  # k1, k2, refs, last
    filters: DataFrame  # shard, data
    shards: int
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
              shard_keys: int = SHARD_KEYS) -> LineIndex:
        """The index of a first set of documents."""
        return cls._of(_keyed(docs, min_chars), min_docs, min_chars, shard_keys)

    @classmethod
    def _of(cls, keyed: DataFrame, min_docs: int, min_chars: int, shard_keys: int) -> LineIndex:
        references = staged(_references(keyed), "references")
        counts = staged(references.groupBy(*KEY).agg(F.count(F.lit(1)).alias("refs"), F.max("doc_id").alias("last")), "counts")
        listed = counts.where(F.col("refs") >= min_docs)
        shards = max(1, -(-listed.count() // shard_keys))
        filters = staged(listed.select(F.pmod("k1", F.lit(shards)).alias("shard"), *KEY)
                         .groupBy("shard").applyInPandas(_build, "shard long, data binary"), "filters")
        return cls(references, counts, filters, shards, min_docs, min_chars)

    def insert(self, docs: DataFrame) -> LineIndex:
        new = staged(_references(_keyed(docs, self.min_chars)), "references")
        gain = new.groupBy(*KEY).agg(F.count(F.lit(1)).alias("refs"), F.max("doc_id").alias("last"))
        counts = staged(self.counts.unionByName(gain).groupBy(*KEY).agg(
            F.sum("refs").alias("refs"), F.max("last").alias("last")), "counts")
        return self._next(staged(self.references.unionByName(new), "references"), counts, new.select(*KEY).distinct())

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without all rows of the given ``doc_id`` values."""
        gone_ids = doc_ids.select(F.col("doc_id").cast("long").alias("__id")).distinct()
        match = F.col("doc_id").eqNullSafe(F.col("__id"))
        touched = staged(self.references.join(gone_ids, match, "left_semi").groupBy(*KEY).agg(
            F.count(F.lit(1)).alias("gone")), "touched")
        left = staged(self.references.join(gone_ids, match, "left_anti"), "references")
        largest = left.join(touched.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.max("doc_id").alias("largest"))
        changed = (self.counts.join(touched, KEY).join(largest, KEY, "left")
                   .select(*KEY, (F.col("refs") - F.col("gone")).alias("refs"), F.col("largest").alias("last"))
                   .where("refs > 0"))
        counts = staged(self.counts.join(touched, KEY, "left_anti").unionByName(changed), "counts")
        return self._next(left, counts, touched.select(*KEY))

    def _next(self, references: DataFrame, counts: DataFrame, touched: DataFrame) -> LineIndex:
        """Move the keys that cross ``min_docs``."""
        was = self.counts.where(F.col("refs") >= self.min_docs).select(*KEY, F.lit(True).alias("was"))
        now = counts.where(F.col("refs") >= self.min_docs).select(*KEY, F.lit(True).alias("now"))
        shard = F.pmod("k1", F.lit(self.shards)).alias("shard")
        moves = (touched.join(was, KEY, "left").join(now, KEY, "left").where(F.col("was").isNotNull() != F.col("now").isNotNull())
                 .select(shard, *KEY, F.col("now").isNotNull().alias("listed")))
        filters = staged(self.filters.groupBy("shard").cogroup(moves.groupBy("shard"))
                         .applyInPandas(_change, "shard long, data binary"), "filters")
        full = filters.where(F.col("data").isNull()).select("shard")
        if not full.isEmpty():
            again = (now.select(shard, *KEY).join(full, "shard", "left_semi").groupBy("shard")
                     .applyInPandas(_build, "shard long, data binary"))
            filters = staged(filters.where(F.col("data").isNotNull()).unionByName(again), "filters")
        return LineIndex(references, counts, filters, self.shards, self.min_docs, self.min_chars)

    def probe(self, keyed: DataFrame, max_bytes: int = MAX_FILTER_BYTES, probe_keys: int = PROBE_KEYS) -> DataFrame:
        """(doc_id, row, pos, k1, k2) of the lines that may be listed."""
        size = self.filters.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
        return self._probe_here(keyed) if size <= max_bytes else self._probe_shards(keyed, probe_keys)

    def _probe_here(self, keyed: DataFrame) -> DataFrame:
        """With all filters, where the lines are."""
        lines = keyed.select("doc_id", "row", F.col("keys.k1").alias("a"), F.col("keys.k2").alias("b"), "keys")
        tables = {r["shard"]: bytes(r["data"]) for r in self.filters.collect()}  # max_bytes at most
        shared = keyed.sparkSession.sparkContext.broadcast((self.shards, tables))

        @F.pandas_udf("array<boolean>")
        def passes(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            filters = Filters(*shared.value)
            for a, b in parts:
                sizes = a.map(len).to_numpy()
                if not sizes.sum():
                    yield pd.Series([[]] * len(a))
                    continue
                found = filters.probe(np.concatenate(a.to_list()).astype(np.int64),
                                      np.concatenate(b.to_list()).astype(np.int64))
                yield pd.Series(np.split(found, np.cumsum(sizes)[:-1]))

        maybe = lines.select("doc_id", "row", F.explode(F.arrays_zip("keys", passes("a", "b").alias("maybe"))).alias("z"))
        return maybe.where("z.maybe").select("doc_id", "row", "z.keys.*")

    def _probe_shards(self, keyed: DataFrame, probe_keys: int) -> DataFrame:
        """With the filter of each key's shard: distinct keys go there, the lines meet those that pass."""
        keys = staged(keyed.select(F.inline("keys")).select(*KEY).distinct(), "probe_keys")
        parts = max(1, -(-keys.count() // (self.shards * probe_keys)))
        keys = keys.select(F.pmod("k1", F.lit(self.shards)).alias("shard"), F.pmod("k2", F.lit(parts)).alias("part"), *KEY)
        filters = self.filters.select("shard", F.explode(F.expr(f"sequence(0L, {parts - 1}L)")).alias("part"), "data")

        def passing(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(held):  # a shard without a listed key has no filter
                return pd.DataFrame({"k1": pd.Series(dtype="int64"), "k2": pd.Series(dtype="int64")})
            found = Filters(1, {0: bytes(held.data.iloc[0])}).probe(asked.k1.to_numpy(), asked.k2.to_numpy())
            return asked.loc[found, KEY]

        both = ["shard", "part"]
        maybe = keys.groupBy(*both).cogroup(filters.groupBy(*both)).applyInPandas(passing, "k1 long, k2 long")
        return keyed.select("doc_id", "row", F.inline("keys")).join(staged(maybe, "passing"), KEY, "left_semi").select(
            "doc_id", "row", "pos", *KEY)

    def dedup(self, docs: DataFrame, max_bytes: int = MAX_FILTER_BYTES, keyed: DataFrame | None = None,
              probe_keys: int = PROBE_KEYS) -> DataFrame:
        """One row per document: doc_id, n_lines, n_dropped, kept_text. Of a listed key only the largest id keeps lines."""
        keyed = _keyed(docs, self.min_chars) if keyed is None else keyed
        listed = self.counts.where(F.col("refs") >= self.min_docs).select(*KEY, "last")
        drops = (self.probe(keyed, max_bytes, probe_keys).join(listed, KEY).where(~F.col("doc_id").eqNullSafe(F.col("last")))
                 .groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row"))
                 .agg(F.collect_set("pos").alias("drops")))  # at most the lines of one document
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                           F.xxhash64("text").alias("row"))
        joined = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row") == F.col("__row")), "left")
        n_lines = F.char_length("text") - F.char_length(F.translate("text", "\n", "")) + 1
        kept = let(F.split("text", "\n", -1), lambda lines: F.array_join(F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drops")), lambda k: F.get(lines, k)), "\n"))
        return joined.select("doc_id", n_lines.cast("long").alias("n_lines"),
                             F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
                             F.when(F.col("drops").isNull(), F.col("text")).otherwise(kept).alias("kept_text"))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Index ``docs`` and dedup them: doc_id, n_lines, n_dropped, kept_text."""
    keyed = _keyed(docs, min_chars)
    return LineIndex._of(keyed, min_docs, min_chars, SHARD_KEYS).dedup(docs, keyed=keyed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir, "doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (
  SELECT rid, doc_id, pos, line, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
        FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
c AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT rid) >= 3),
k AS (SELECT l.*, c.key IS NOT NULL AND l.doc_id IS DISTINCT FROM c.last AS dropped FROM l LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM k GROUP BY rid, doc_id
"""
