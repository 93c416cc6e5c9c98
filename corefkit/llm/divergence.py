"""Source divergence audit: how far the word use of every source of a language is from the others'.

Single-pass in-memory indexing gives the frequencies:

1. Each task reads its documents once and counts their terms into a block of
   postings: the sources with their occurrences, and the documents, of each (lang, term). When the
   block holds ``BLOCK_POSTINGS`` postings or has read ``BLOCK_BYTES`` of text, it is spilled as
   runs sorted by term, one per (lang, shard of terms), and memory is free again.
2. The runs of a (lang, shard of terms) meet in one group, where a heap merges them term
   by term. A term in ``min_docs`` or more documents of its language is kept,
   with its count in every source that has it. Shards grow in number with the input.

Then the distances. p(count) = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)) with V
kept terms in the language and N occurrences of them in the group; ``base`` is p(0).
The sum of |p - q| over all V terms is V * |base - base'|, what every source would give
without any term, and corrections:

* each term of a source moves its side from base to p: sums of |p - base'| over one source's
  terms, for all other sources at once from running sums over the distinct p;
* terms that both sources have move both sides. These pair corrections are streamed from the
  kept terms' postings into sums per pair of sources, in blocks of ``PAIR_BLOCK`` by as many
  sources, before they are shuffled.

All of it is integer arithmetic (decimals where a product passes 64 bits).

The one square is the result's own: a row per two sources of a language. No group
holds a source's documents: blocks combine them before the shuffle, so a source with a third
of all rows sends its terms once per block.

Null text, lang and source count as empty; the empty string is a language and a
source like any other. Repeated rows and ids count each time. A group without kept terms
has N = 0. A language without kept terms gives pairs of value 0. Extra columns are not read,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corefkit.llm.common import documents, staged

MIN_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
#: A block is spilled at so many postings, or so many bytes of text.
BLOCK_POSTINGS = 400_000
BLOCK_BYTES = 128 << 20
#: Text bytes per shard of terms: at least this, growing with the root of the input (1 GB at 100 TB).
SHARD_BYTES = 32 << 20
#: A task holds sums for so many pairs of blocks of so many sources, then hands them on.
PAIR_BLOCK = 256
BLOCKS_HELD = 64
#: ASCII letters in lower case and all bytes of other characters stay; the rest parts terms.
LETTERS = bytes(c | 0x20 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Matches of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` in UTF-8, only A-Z lower-cased."""
    return text.translate(LETTERS).split()


def plan_shards(total_bytes: int) -> int:
    """Shards of terms per language."""
    return max(1, math.ceil(total_bytes / max(SHARD_BYTES, math.isqrt(10_000 * total_bytes))))


# ---------------------------------------------------------------- blocks of postings, spilled as sorted runs

RUN = ("lang string, shard int, sources array<string>, n_docs binary, terms binary, sizes binary, posts binary, "
       "ids binary, counts binary")
RUN_KINDS = [("lang", pa.string()), ("shard", pa.int32()), ("sources", pa.list_(pa.string())),
             *[(c, pa.binary()) for c in ("n_docs", "terms", "sizes", "posts", "ids", "counts")]]


class Block:
    """Postings in memory: documents per (lang, term), occurrences per (lang, source, term)."""

    def __init__(self) -> None:
        self.n_docs: dict[str, Counter] = {}
        self.counts: dict[str, dict[str, Counter]] = {}
        self.postings = self.bytes_read = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        sources = self.counts.setdefault(lang, {})
        counts = sources.setdefault(source, Counter())
        terms = terms_of(text)
        before = len(counts)
        counts.update(terms)
        self.n_docs.setdefault(lang, Counter()).update(set(terms))
        self.postings += len(counts) - before
        self.bytes_read += len(text)

    def runs(self, shards: int) -> Iterator[tuple]:
        """One row per language and shard with terms, sorted by term; each source of a language is in its row of shard -1."""
        for lang, by_source in self.counts.items():
            sources = sorted(by_source)
            yield lang, -1, sources, *[b""] * 6
            n_docs = self.n_docs[lang]
            terms = sorted(n_docs)
            if not terms:
                continue
            shard = np.fromiter((shard_of(t, shards) for t in terms), np.int64, len(terms))
            order = np.argsort(shard, kind="stable")  # by shard, then term
            place = np.empty(len(terms), np.int64)
            place[order] = np.arange(len(terms))
            at = {t: k for t, k in zip(terms, place.tolist())}
            parts = [by_source[s] for s in sources]
            where = np.concatenate([np.fromiter(map(at.__getitem__, c), np.int64, len(c)) for c in parts])
            counts = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in parts])
            ids = np.repeat(np.arange(len(parts), dtype=np.uint32), [len(c) for c in parts])
            by_term = np.argsort(where, kind="stable")
            counts, ids = counts[by_term], ids[by_term]
            posts = np.bincount(where, minlength=len(terms)).astype(np.uint32)
            ends = np.concatenate([[0], np.cumsum(posts, dtype=np.int64)])
            names, starts = np.unique(shard[order], return_index=True)
            for name, low, high in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(terms)]):
                own = [terms[k] for k in order[low:high].tolist()]
                held = slice(ends[low], ends[high])
                yield (lang, name, sources, np.fromiter(map(n_docs.__getitem__, own), np.int64, len(own)).tobytes(),
                       b"".join(own), np.fromiter(map(len, own), np.uint32, len(own)).tobytes(), posts[low:high].tobytes(),
                       ids[held].tobytes(), counts[held].tobytes())


def _index(shards: int, block_postings: int, block_bytes: int):
    """Blocks of postings in memory; each is spilled as term-sorted runs."""

    def spill(block: Block) -> Iterator[pa.RecordBatch]:
        for row in block.runs(shards):
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, (_, k) in zip(row, RUN_KINDS)], [n for n, _ in RUN_KINDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in batches:
            for lang, source, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                block.add(lang, source, value.as_py())
                if block.postings >= block_postings or block.bytes_read >= block_bytes:
                    yield from spill(block)
                    block = Block()
        yield from spill(block)

    return run


def shard_of(term: bytes, shards: int) -> int:
    return xxhash.xxh32_intdigest(term) % shards


def read_run(number: int, terms: bytes, sizes: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(term, number of the run, place in it) of a run, one at a time."""
    at = 0
    for place, size in enumerate(np.frombuffer(sizes, np.uint32).tolist()):
        yield terms[at:at + size], number, place
        at += size


def _merge(min_docs: int):
    """Heap merge of the runs of one (lang, shard): the kept terms with their counts by source."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sources = [list(x) for x in pdf.sources]
        n_docs = [np.frombuffer(x, np.int64).tolist() for x in pdf.n_docs]
        ids, counts = ([np.frombuffer(x, k) for x in c] for c, k in ((pdf.ids, np.uint32), (pdf.counts, np.int64)))
        ends = [np.concatenate([[0], np.cumsum(np.frombuffer(x, np.uint32), dtype=np.int64)]) for x in pdf.posts]
        rows, now, met, total = [], None, [], 0

        def close() -> None:
            if total < min_docs or now is None:
                return
            found: dict[str, int] = {}
            for r, place in met:
                held = slice(ends[r][place], ends[r][place + 1])
                for k, n in zip(ids[r][held].tolist(), counts[r][held].tolist()):
                    name = sources[r][k]
                    found[name] = found.get(name, 0) + n
            names = sorted(found)
            rows.append((key[0], now.decode(), names, [found[s] for s in names]))

        for term, r, place in heapq.merge(*[read_run(k, t, z) for k, (t, z) in enumerate(zip(pdf.terms, pdf.sizes))]):
            if term != now:
                close()
                now, met, total = term, [], 0
            met.append((r, place))
            total += n_docs[r][place]
        close()
        return pd.DataFrame(rows, columns=["lang", "term", "sources", "counts"])

    return run


def frequencies(docs: DataFrame, min_docs: int = MIN_DOCS, shards: int | None = None,
                block_postings: int = BLOCK_POSTINGS, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Kept terms (lang, term, sources, counts) and groups (lang, source) of ``docs`` (lang, source, text)."""
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    rows = rows.withColumn("text", F.col("text").cast("binary"))
    if shards is None:
        total = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
        shards = plan_shards(total)
    runs = staged(rows.mapInArrow(_index(shards, block_postings, block_bytes), RUN), "postings_runs")
    groups = runs.where("shard = -1").select("lang", F.explode("sources").alias("source")).distinct()
    kept = (runs.where("shard >= 0").groupBy("lang", "shard")
            .applyInPandas(_merge(min_docs), "lang string, term string, sources array<string>, counts array<long>"))
    return staged(kept, "kept_terms"), groups


# ---------------------------------------------------------------- distances


def probability(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (n + SMOOTH * v)), exact; null without kept terms."""
    whole = lambda c: c.cast("decimal(20,0)")
    over = whole(count + F.lit(SMOOTH)) * F.lit(SCALE).cast("decimal(10,0)")
    under = whole(n + F.lit(SMOOTH) * v)
    return F.when(v > 0, (over - over % under) / under + 1).cast("long")


def _pair_corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the terms that two sources share of |p - p'| - |p - base'| - |p' - base| + |base - base'|."""
    names: dict[str, dict[str, int]] = {}
    sums: dict[tuple[str, int, int], np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, a, b), held in sums.items():
            known = list(names[lang])
            i, j = np.nonzero(held)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(i), pa.string()),
                "source": pa.array([known[a * PAIR_BLOCK + k] for k in i.tolist()], pa.string()),
                "other": pa.array([known[b * PAIR_BLOCK + k] for k in j.tolist()], pa.string()),
                "value": pa.array(held[i, j], pa.int64())})
        sums.clear()

    for batch in batches:
        for lang, sources, ps, bases in zip(*(c.to_pylist() for c in batch.columns)):
            numbers = names.setdefault(lang, {})
            at = np.array([numbers.setdefault(s, len(numbers)) for s in sources])
            order = np.argsort(at)
            at, p, base = at[order], np.array(ps, np.int64)[order], np.array(bases, np.int64)[order]
            cuts = np.flatnonzero(np.diff(at // PAIR_BLOCK)) + 1
            parts = list(zip(*(np.split(x, cuts) for x in (at, p, base))))
            for at1, p1, base1 in parts:
                rows, p1, base1 = (at1 % PAIR_BLOCK)[:, None], p1[:, None], base1[:, None]
                for at2, p2, base2 in parts:
                    blocks = lang, int(at1[0]) // PAIR_BLOCK, int(at2[0]) // PAIR_BLOCK
                    if (held := sums.get(blocks)) is None:
                        held = sums[blocks] = np.zeros((PAIR_BLOCK, PAIR_BLOCK), np.int64)
                    held[rows, at2 % PAIR_BLOCK] += (np.abs(p1 - p2) - np.abs(p1 - base2) - np.abs(p2 - base1)
                                                     + np.abs(base1 - base2))
            if len(sums) >= BLOCKS_HELD:
                yield from flush()
    yield from flush()


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, **index) -> DataFrame:
    """lang, source, part, item, value, rank: the other sources by distance, and the terms a source overuses."""
    kept, seen = frequencies(docs, min_docs, **index)
    postings = kept.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select(
        "lang", "term", F.col("x.sources").alias("source"), F.col("x.counts").alias("count"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    totals = postings.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("present"))
    zero = F.lit(0).cast("long")
    groups = (seen.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
              .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("n", "present", "v")])
              .withColumn("base", F.coalesce(probability(zero, F.col("n"), F.col("v")), zero)))
    groups = staged(groups, "audit_groups")
    known = staged(postings.join(groups, ["lang", "source"]).select(
        "lang", "term", "source", "count", "base", probability(F.col("count"), F.col("n"), F.col("v")).alias("p")), "audit_postings")
    return _pairs(groups, known).unionByName(_terms(groups, known, top_terms))


def _pairs(groups: DataFrame, known: DataFrame) -> DataFrame:
    """Part ``pair``: all other sources of the language by the sum of |p - q|."""
    other = groups.select("lang", F.col("source").alias("other"), F.col("base").alias("base2"))
    two = groups.join(other, "lang").where("source != other")
    gap = F.abs(F.col("base") - F.col("base2"))
    start = two.select("lang", "source", "other", (F.col("v") * gap).alias("value"))

    # sum of |p - base2| over one source's terms, for every base2: running sums over its distinct p
    distinct = known.groupBy("lang", "source", F.col("p").alias("at")).agg(F.count(F.lit(1)).alias("times"))
    none = F.lit(None).cast("string")
    asked = (distinct.select("lang", "source", "at", "times", none.alias("other"), F.lit(0).cast("long").alias("less"))
             .unionByName(two.select("lang", "source", F.col("base2").alias("at"), F.lit(0).cast("long").alias("times"), "other",
                                     (F.col("present") * gap).alias("less"))))
    group = Window.partitionBy("lang", "source")
    below = group.orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    mass = F.col("at") * F.col("times")
    sums = asked.select("lang", "source", "other", "at", "less",
                        F.sum("times").over(below).alias("c"), F.sum(mass).over(below).alias("m"),
                        F.sum("times").over(group).alias("all_c"), F.sum(mass).over(group).alias("all_m"))
    own = sums.where("other is not null").select(
        "lang", "source", "other",
        (F.expr("at * c - m + (all_m - m) - at * (all_c - c)") - F.col("less")).alias("value"))

    shared = known.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "base"))).alias("x"))
    both = (shared.where(F.size("x") > 1).select("lang", "x.source", "x.p", "x.base")
            .mapInArrow(_pair_corrections, "lang string, source string, other string, value long"))
    # a source's own terms count for both directions
    turn = F.inline(F.array(F.struct("source", "other"), F.struct(F.col("other").alias("source"), F.col("source").alias("other"))))
    value = (start.unionByName(own.select("lang", turn, "value")).unionByName(both.where("source != other"))
             .groupBy("lang", "source", "other").agg(F.sum("value").alias("value")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other")
    return value.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value",
                        F.row_number().over(order).alias("rank"))


def _terms(groups: DataFrame, known: DataFrame, top: int) -> DataFrame:
    """Part ``term``: the terms of a source that it uses more than its language, the first ``top``."""
    whole = groups.groupBy("lang").agg(F.sum("n").alias("n"), F.max("v").alias("v"))
    of_lang = known.groupBy("lang", "term").agg(F.sum("count").alias("count")).join(whole, "lang").select(
        "lang", "term", probability(F.col("count"), F.col("n"), F.col("v")).alias("q"))
    over = known.join(of_lang, ["lang", "term"]).where("p > q").select(
        "lang", "source", "term", (F.col("p") - F.col("q")).alias("value"))
    # a row-number filter, of which Spark keeps ``top`` rows per group before the shuffle
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    return over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir, "lang", "source", "text"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce("text", '') AS body
  FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
                                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
vs AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
f AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (
  SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n,
         sum(coalesce(f.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, v
  FROM g JOIN k USING (lang) JOIN vs USING (lang)
  LEFT JOIN f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (total + 5 * v) AS p FROM s),
l AS (
  SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
  FROM (SELECT lang, term, sum(n) AS n, max(v) AS v FROM s GROUP BY lang, term)),
two AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y USING (lang, term)
                   WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
one AS (
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value
  FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
         CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
  FROM (SELECT * FROM two UNION ALL SELECT * FROM one))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""
