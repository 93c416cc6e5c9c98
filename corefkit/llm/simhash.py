"""SimHash near-dedup with pivot distance tables.

Fingerprint: for each of 64 bits, whether it is set in over half of the XXH64
hashes of the text's word shingles. Two fingerprints link at ``MAX_BITS`` or
fewer differing bits; a document's group is all it reaches over links.

Candidates come from a table of Hamming distances to reference fingerprints
(pivots), one row per distinct fingerprint:

* *Block pivots*: zero and the 32 masks of two neighbouring bits. The distance to
  a mask against the distance to zero gives the bits set under the mask, so these
  pivots place a fingerprint in 32 small coordinates, dealt to a number of parts. Two
  differing bits touch at most two parts, so linked fingerprints agree in all parts
  but some two: no link is lost when the coordinates of every choice of all parts but two
  are a join key. More parts make keys longer and more: four parts give 6 keys of 16
  coordinates, eleven give 55 keys of 26. ``parts_for`` takes the least number that
  leaves few unlike fingerprints to a key, so the pivots decide at any size.
* *Far pivots*: eight seeded random fingerprints. By the triangle inequality the
  distances of linked fingerprints to any pivot differ by at most ``MAX_BITS``, so
  pairs whose largest coordinate difference is more are discarded.
* Survivors are verified by their exact Hamming distance.

A key with more than ``MAX_BUCKET`` fingerprints, as a crowd of like ones has, is not
compared in pairs. Its fingerprints are sent to all 65 values within one bit of them: two fingerprints
are within two bits exactly when they share such a value, which at most 65
fingerprints can. Each value links its fingerprints to the smallest, so a dense
group costs 65 rows per fingerprint and never a pair of all with all.

Groups come from alternating large-star and small-star rounds over distinct
links, each staged in the shared folder. Exact copies share a fingerprint and
are one node throughout. Null and empty texts have fingerprint zero and link like
any other; null ids are ignored as smallest id unless a group has no other.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corefkit.llm.common import conjunction, documents, staged

SHINGLE, SEED = 3, 42
MAX_BITS = 2
MAX_BUCKET = 64
#: Unlike fingerprints that may share a key on average; crowds come on top.
KEY_ROWS = 4
#: Each makes keys of two coordinates more than the one before, 16 to 26; the last is good for 4 * 10**11 fingerprints.
PARTS = (4, 5, 6, 7, 8, 11)
#: Shingles hashed at once, so that memory is bounded for any length of text.
CHUNK = 100_000

BLOCKS = [3 << k for k in range(0, 64, 2)]
FAR_PIVOTS = [xxhash.xxh64_intdigest(f"pivot {k}") for k in range(8)]


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text's bytes."""
    words = (raw or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(itertools.islice(words, k, None) for k in range(shingle))))
        n = len(words) - shingle + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        part = itertools.islice(shingles, min(CHUNK, n - at))
        h = np.fromiter((digest(s, SEED) for s in part), dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def run(raws: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, shingle) for x in raws], dtype=np.uint64).view(np.int64))

    return run(text.cast("binary"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distance(a: Column, b: Column | int) -> Column:
    return F.bit_count(a.bitwiseXOR(F.lit(_signed(b)) if isinstance(b, int) else b))


def dealt(parts: int) -> list[int]:
    """The part of each block coordinate: neighbours together, sizes as even as they can be."""
    return [k * parts // len(BLOCKS) for k in range(len(BLOCKS))]


def key_masks(parts: int) -> list[int]:
    """For each choice of two parts to leave out, the bits of the packed coordinates (two a coordinate) that stay."""
    part = dealt(parts)
    return [sum(3 << 2 * k for k in range(len(BLOCKS)) if part[k] not in out) for out in itertools.combinations(range(parts), 2)]


def parts_for(n: int) -> int:
    """The least number of parts whose keys hold ``KEY_ROWS`` of ``n`` unlike fingerprints on average at most.

    Beyond that it is the largest of ``PARTS``, and keys hold more.
    A coordinate takes its three values with chances 1/4, 1/2, 1/4, so unlike ones agree in it 3 times in 8.
    """
    for parts in PARTS:
        least = min(mask.bit_count() // 2 for mask in key_masks(parts))
        if n * 0.375 ** least <= KEY_ROWS:
            return parts
    return PARTS[-1]


def pivot_table(nodes: DataFrame) -> DataFrame:
    """fp -> its distances to the far pivots, and its block coordinates, packed."""
    fp = F.col("fp")
    zero = _distance(fp, 0)
    packed = F.lit(0).cast("long")
    for k, mask in enumerate(BLOCKS):
        packed = packed.bitwiseOR(F.shiftleft(((zero - _distance(fp, mask) + 2) / 2).cast("long"), 2 * k))
    return nodes.select("fp", *[_distance(fp, p).cast("byte").alias(f"p{k}") for k, p in enumerate(FAR_PIVOTS)],
                        packed.alias("blocks"))


def links(nodes: DataFrame, max_bits: int = MAX_BITS, max_bucket: int = MAX_BUCKET, parts: int | None = None) -> DataFrame:
    """Distinct links (u, v), u < v, whose closure is that of all pairs within ``max_bits`` (at most 2).

    ``parts``: into how many the coordinates are dealt; by the number of fingerprints if not given.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("the block pivots and the one-bit neighbours are complete up to two bits")
    far = [f"p{k}" for k in range(len(FAR_PIVOTS))]
    table = staged(pivot_table(nodes), "pivots")
    keys = [F.struct(F.lit(k).alias("pair"), F.col("blocks").bitwiseAND(F.lit(_signed(mask))).alias("at"))
            for k, mask in enumerate(key_masks(parts or parts_for(table.count())))]
    keyed = table.select("fp", *far, F.explode(F.array(*keys)).alias("key")).select(
        "fp", *far, "key.pair", "key.at")
    sizes = staged(keyed.groupBy("pair", "at").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket_sizes")

    small = staged(keyed.join(sizes.where(F.col("n") <= max_bucket).select("pair", "at"), ["pair", "at"]), "buckets")
    a, b = small.alias("a"), small.alias("b")
    near = conjunction([F.abs(F.col(f"a.{p}") - F.col(f"b.{p}")) <= max_bits for p in far])
    found = a.join(b, (F.col("a.pair") == F.col("b.pair")) & (F.col("a.at") == F.col("b.at"))
                   & (F.col("a.fp") < F.col("b.fp")) & near & (_distance(F.col("a.fp"), F.col("b.fp")) <= max_bits)
                   ).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))

    large = keyed.join(sizes.where(F.col("n") > max_bucket).select("pair", "at"), ["pair", "at"], "left_semi")
    return staged(found.unionByName(dense_links(large.select("fp").distinct(), max_bits)).distinct(), "links")


def dense_links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links by shared values within one bit (for two bits; fewer bits share less), each to the smallest that shares it."""
    fp = F.col("fp")
    flips = [fp, *[fp.bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)]] if max_bits else [fp]
    shared = (nodes.select("fp", F.explode(F.array(*flips)).alias("value"))
              .groupBy("value").agg(F.sort_array(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1))
    star = shared.select(F.col("fps")[0].alias("u"), F.explode("fps").alias("v")).where("u < v")
    if max_bits == 1:  # values one bit away on both sides make two bits: those go
        pairs = shared.select(F.explode("fps").alias("u"), "fps").select("u", F.explode("fps").alias("v"))
        star = pairs.where((F.col("u") < F.col("v")) & (_distance(F.col("u"), F.col("v")) <= 1))
    return star.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; root is the smallest node of its component."""
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where("v > u and v <> m")
                 .select(F.col("m").alias("u"), "v").distinct())
        large = staged(large, "large_star")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        edges = staged(small.where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
                       .unionByName(small.select(F.col("m").alias("u"), "v")).distinct(), "small_star")
        now = edges.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first()
        if now == mark:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        mark = now


def group_fingerprints(prints: DataFrame, max_bits: int = MAX_BITS, max_bucket: int = MAX_BUCKET,
                       parts: int | None = None) -> DataFrame:
    """(fp, component_id, keep_fp) per distinct fingerprint of ``prints`` (doc_id, fp).

    component_id is the smallest doc_id that fp reaches, keep_fp the smallest fingerprint among its rows.
    """
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    roots = components(links(nodes, max_bits, max_bucket, parts))
    rooted = staged(nodes.join(roots, nodes.fp == roots.node, "left")
                    .select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")
    first = F.struct(F.col("low").isNull().alias("none"), "low", "fp")  # null ids come last
    least = rooted.groupBy("root").agg(F.min(first).alias("first"))
    return rooted.join(least, "root").select("fp", F.col("first.low").alias("component_id"), F.col("first.fp").alias("keep_fp"))


def near_groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                fingerprint_column(F.col("text"), shingle).alias("fp")), "prints")
    groups = group_fingerprints(prints, max_bits, max_bucket)
    return prints.join(groups, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each group one with the smallest doc_id."""
    # a text's hash finds the rows that stay again, so that fingerprints are made once
    key = F.xxhash64("text").alias("key")
    prints = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), key,
                                fingerprint_column(F.col("text"), options.pop("shingle", SHINGLE)).alias("fp")), "prints")
    groups = group_fingerprints(prints, **options)
    stay = groups.where("fp = keep_fp").select(F.col("component_id").alias("low"), F.col("fp").alias("keep"))
    chosen = (prints.join(stay, F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("fp") == F.col("keep")))
              .groupBy("low", "fp").agg(F.min("key").alias("one")).select("low", "one"))
    # the row in one struct, so that its columns may have any name
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key)
    rows = rows.join(chosen, F.col("row.doc_id").cast("long").eqNullSafe(F.col("low")) & (F.col("key") == F.col("one")), "left_semi")
    if prints.groupBy("doc_id", "key").count().where("count > 1").isEmpty():
        return rows.select("row.*")
    return (rows.groupBy(F.col("row.doc_id").alias("low"), "key").agg(F.min_by("row", F.to_json("row")).alias("row"))
            .select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir, "doc_id", "text"))
