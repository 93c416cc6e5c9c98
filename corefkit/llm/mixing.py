"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sources in code point order (null last) weigh 3, 1, 2, repeating, and share 150 %
of all words; a target stops at twice its source's words and the excess goes to
the others by weight (water filling, solved in closed form over one row per
source).

The mix is ``words / BLOCK_WORDS`` blocks. They are allocated by highest quotients
target / (2j - 1): first to sources, then to groups of a source's shards, then to
the shards of a group. Only quotients near the cut are ever listed: every party
surely gets ``floor(w / high + 1/2)`` seats and never more than
``floor(w / low + 1/2)``, for divisors high and low that bracket the true one, so
at most a few rows per party are ranked.

A shard is a seeded hash share of a source's documents, read as one stream of
words and cut into blocks. Its quota takes every block equally often and the rest
by a seeded hash order, the incomplete last block last. The order is drawn for
runs of ``run_blocks`` adjacent blocks: one block (the query), or with
``RUN_BLOCKS`` several documents, so that a mix of texts cuts few of them and its
targets stay exact to a block. A document gets the words it has in taken blocks,
each at most twice. Shards hold about ``SHARD_WORDS``
words however large a source is, and every window is over one shard, one group
of shards or the sources, so a source with a third of all rows is no hot key.

All columns are DataFrame expressions. Null and empty texts have size 0 and take
nothing; a null source is a source of its own; repeated rows are documents of
their own; the same rows give the same mix in any order and partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corefkit.functions.text import let
from corefkit.llm.common import WORD_PATTERN, documents, staged

WEIGHTS = (3, 1, 2)
SHARE = 1.5
BLOCK_WORDS = 32
#: Adjacent blocks that a mix of texts takes one after the other: 4,096 words.
RUN_BLOCKS = 128
SHARD_WORDS = 1 << 16
#: Each lists 2,048 block keys.
SHARDS_PER_TASK = 128
SEED = 11
#: A word with the white space before it; the last one also with what follows.
TOKEN_PATTERN = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++(?:[\x20\x09-\x0D]++\z)?"
#: What goes where a text is cut before a word: white space, but not the indentation of its line.
CUT_PATTERN = r"\A(?:[\x20\x09-\x0D]*[\x0A-\x0D]|[\x20\x09-\x0D]+)"


def number(*parts: Column) -> Column:
    """A seeded 60-bit number of some values."""
    text = F.concat_ws("|", F.lit(str(SEED)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row per source: source, source_size, target."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy()  # one row per source
    placed = totals.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    caps = placed.withColumn("weight", weight).withColumn("cap", 2 * F.col("source_size")).withColumn(
        "full_at", F.col("cap") / F.col("weight"))
    by_full = Window.orderBy("full_at", "place")
    level = ((share * F.sum("source_size").over(every) - F.sum("cap").over(by_full.rowsBetween(Window.unboundedPreceding, 0))
              + F.col("cap")) / F.sum("weight").over(by_full.rowsBetween(0, Window.unboundedFollowing)))
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "place", "level"))).over(every)
    return caps.withColumn("level", level).withColumn("first", first).select(
        "source", "place", "source_size",
        F.least(F.col("cap").cast("double"), F.coalesce(F.col("first.level"), F.lit(0.0)) * F.col("weight")).alias("target"))


def apportion(parties: DataFrame, within: list[str], order: str, weight: str, seats: str) -> DataFrame:
    """``parties`` plus ``quota``: the seats of each group shared by highest quotients weight / (2j - 1)."""
    group = Window.partitionBy(*within)
    n, total = F.count(F.lit(1)).over(group), F.sum(weight).over(group)
    rows = parties.withColumn("__n", n).withColumn("__total", total)
    even = F.col("__total") / F.col(seats)  # weight per seat
    room = 2 * F.col(seats) - F.col("__n")
    high = F.when(room > 0, even * (1 + F.col("__n") / room))
    low = even * (1 - F.col("__n") / (2 * F.col(seats) + F.col("__n")))
    usable = (F.col(seats) > 0) & (F.col("__total") > 0)
    base = F.when(usable & high.isNotNull(), F.greatest(F.lit(0), F.floor(F.col(weight) / high + 0.5) - 1)).otherwise(0)
    top = F.when(usable & (F.col(weight) > 0), F.floor(F.col(weight) / low + 0.5) + 1).otherwise(0)
    rows = rows.withColumn("__base", base.cast("long")).withColumn("__top", top.cast("long"))
    rows = rows.withColumn("__left", F.col(seats) - F.sum("__base").over(group))
    open_seats = (rows.where("__top > __base and __left > 0")
                  .withColumn("__j", F.explode(F.sequence(F.col("__base") + 1, "__top")))
                  .withColumn("__rank", F.row_number().over(group.orderBy(
                      (F.col(weight) / (2 * F.col("__j") - 1)).desc(), F.col(order), F.col("__j"))))
                  .where("__rank <= __left").groupBy(*within, order).agg(F.count(F.lit(1)).alias("__more")))
    joined = rows.join(open_seats, [*within, order], "left")
    return joined.select(*parties.columns, (F.col("__base") + F.coalesce("__more", F.lit(0))).alias("quota"))


def block_key(place: Column, shard: Column, blocks: Column, block: Column, run_blocks: int) -> Column:
    """The order in which a shard's blocks are taken: the last one last, the others by a seeded number of their run."""
    first = block - F.pmod(block, F.lit(run_blocks).cast("long"))
    return F.struct((block == blocks - 1).alias("last"), number(place, shard, first).alias("number"), block.alias("block"))


def shard_plan(sized: DataFrame, sources: DataFrame, block_words: int, run_blocks: int) -> DataFrame:
    """One row per (place, shard): blocks, rounds (how often all are taken) and until (the last block taken once more)."""
    all_blocks = F.floor(F.sum("target").over(Window.partitionBy()) / block_words + 0.5).cast("long")
    quotas = apportion(sources.withColumn("all", F.lit(0)).withColumn("seats", all_blocks), ["all"], "place", "target",
                       "seats").select("place", F.col("quota").alias("source_quota"))
    shards = staged(sized.groupBy("place", "shard", "shards").agg(F.sum("size").alias("words")).join(quotas, "place"), "shards")
    # few bytes but thousands of block keys a row: dealt out by their number, which Spark's sizes don't show
    tasks = max(1, math.ceil(shards.count() / SHARDS_PER_TASK))
    # groups of shards keep every ranking to about the root of the number of shards
    shards = shards.withColumn("group", F.pmod("shard", F.ceil(F.sqrt("shards")).cast("long")))
    groups = shards.groupBy("place", "group").agg(F.sum("words").alias("words"), F.max("source_quota").alias("source_quota"))
    groups = apportion(groups, ["place"], "group", "words", "source_quota").select(
        "place", "group", F.col("quota").alias("group_quota"))
    shards = apportion(shards.join(staged(groups, "groups"), ["place", "group"]), ["place", "group"], "shard", "words", "group_quota")
    blocks = F.ceil(F.col("words") / block_words).cast("long")
    return (shards.where("words > 0").repartition(tasks, "place", "shard").withColumn("blocks", blocks)
            .withColumn("rounds", F.least(F.lit(2), F.expr("quota div blocks")))
            .withColumn("extra", F.when(F.col("rounds") < 2, F.expr("quota % blocks")).otherwise(0).cast("int"))
            .withColumn("keys", F.sort_array(F.transform(
                F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
                lambda b: block_key(F.col("place"), F.col("shard"), F.col("blocks"), b, run_blocks))))
            .select("place", "shard", "blocks", "rounds",
                    F.when(F.col("extra") > 0, F.element_at("keys", F.greatest("extra", F.lit(1)))).alias("until")))


def mix(docs: DataFrame, payload: list[str], weights=WEIGHTS, share: float = SHARE, block_words: int = BLOCK_WORDS,
        shard_words: int = SHARD_WORDS, run_blocks: int = RUN_BLOCKS) -> DataFrame:
    """Per document: the ``payload`` columns of ``docs`` in a struct ``row``, size, source_size, target, taken, and
    cover: for each block that it touches, where in the document, how many words, and how often they are taken."""
    row = F.struct(*[F.col(f"`{c}`") for c in payload]).alias("row")
    sized = staged(docs.select(row, F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
                               number(F.col("doc_id"), F.col("text")).alias("number"),
                               F.col("doc_id").cast("string").alias("doc")), "sizes")
    sources = staged(source_targets(sized, weights, share), "sources")
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")
    known = sources.select(F.col("source").alias("__source"), "place", "source_size", "target", shards.alias("shards"))
    sized = (sized.join(known, F.col("source").eqNullSafe(F.col("__source")))
             .withColumn("shard", F.pmod("number", "shards")))
    plan = staged(shard_plan(sized, sources, block_words, run_blocks), "plan")
    some = sized.where("size > 0")  # rows without words take nothing and stay out of the shards' windows
    stream = Window.partitionBy("place", "shard").orderBy("number", "doc", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = some.withColumn("start", F.sum("size").over(stream) - F.col("size"))
    joined = placed.join(plan, ["place", "shard"], "left")

    def covered(b: Column) -> Column:
        start = F.greatest(F.col("start"), b * block_words)
        end = F.least(F.col("start") + F.col("size"), (b + 1) * block_words)
        again = F.coalesce(block_key(F.col("place"), F.col("shard"), F.col("blocks"), b, run_blocks) <= F.col("until"), F.lit(False))
        return F.struct((start - F.col("start")).alias("at"), (end - start).alias("words"),
                        (F.col("rounds") + again.cast("int")).cast("long").alias("times"))

    touched = F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))
    out = joined.select("row", "size", "source_size", "target", F.transform(touched, covered).alias("cover"))
    none = F.array().cast(out.schema["cover"].dataType)
    out = out.unionByName(sized.where("size = 0").select("row", "size", "source_size", "target", none.alias("cover")))
    taken = F.aggregate("cover", F.lit(0).cast("long"), lambda sum_, c: sum_ + c["words"] * c["times"])
    return out.withColumn("taken", taken)


def cut_out(text: Column, part: Column) -> Column:
    """The words of ``part`` (at, words; ascending) with the white space between them; a line break where words are left out."""
    end = lambda c: c["at"] + c["words"]
    starts = lambda p: F.filter(p, lambda c, i: F.coalesce(end(F.get(p, i - 1)) != c["at"], F.lit(True)))
    ends = lambda p: F.filter(p, lambda c, i: F.coalesce(F.get(p, i + 1)["at"] != end(c), F.lit(True)))
    pieces = let(part, lambda p: F.zip_with(starts(p), ends(p), lambda a, z: F.struct(
        a["at"].cast("int").alias("at"), (end(z) - a["at"]).cast("int").alias("words"))))

    def piece(tokens: Column, c: Column) -> Column:
        own = F.array_join(F.slice(tokens, c["at"] + 1, c["words"]), "")
        return F.when(c["at"] > 0, F.regexp_replace(own, CUT_PATTERN, "")).otherwise(own)

    return let(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), 0), lambda tokens: F.array_join(
        F.transform(pieces, lambda c: piece(tokens, c)), "\n"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: a row for each time that words of a document are taken.

    A document taken whole keeps its text; of one taken in part the taken words remain as they stand there.
    """
    copies = mix(docs, docs.columns, **options).where("taken > 0").withColumn("time", F.explode(F.array(F.lit(1), F.lit(2))))
    part = F.filter("cover", lambda c: c["times"] >= F.col("time"))
    n_words = F.aggregate(part, F.lit(0).cast("long"), lambda sum_, c: sum_ + c["words"])
    some = cut_out(F.col("row.text"), part)
    text = F.when(n_words == F.col("size"), F.col("row.text")).otherwise(some)
    rows = copies.where(n_words > 0).select("row", text.alias("__text"))
    kinds = dict(docs.dtypes)
    return rows.select(*[
        F.col("__text").alias(c) if c == "text" else F.char_length("__text").cast(kinds[c]).alias(c) if c == "n_chars"
        else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "source")
    return mix(docs, ["doc_id"], run_blocks=1).select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


def _apportioned(name: str, parties: str, within: str, order: str, weight: str, seats: str) -> str:
    """SQL that lists every quotient, for the checks."""
    return f"""{name} AS (
  SELECT {within}, {order}, count(*) AS quota FROM (
    SELECT {within}, {order}, {seats} AS seats, row_number() OVER (
      PARTITION BY {within} ORDER BY {weight}::DOUBLE / (2 * j - 1) DESC, {order}, j) AS r
    FROM {parties}, range(1, {seats}::BIGINT + 1) AS q(j) WHERE {weight} > 0)
  WHERE r <= seats GROUP BY {within}, {order})"""


def _number_sql(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{SEED}', {', '.join(parts)})), 1, 15))::BIGINT"


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD_PATTERN}')), 0)::BIGINT AS size,
         {_number_sql("doc_id", "text")} AS number
  FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
c AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][(place - 1) % {len(WEIGHTS)} + 1] AS weight, 2 * source_size AS cap FROM t),
f AS (SELECT *, cap / weight AS full_at FROM c),
l AS (SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - sum(cap) OVER (ORDER BY full_at, place) + cap)
              / sum(weight) OVER (ORDER BY full_at, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
s AS (SELECT source, place, source_size, greatest(1, ceil(source_size / {SHARD_WORDS}))::BIGINT AS shards,
             least(cap::DOUBLE, coalesce((SELECT arg_min(level, (full_at, place)) FROM l WHERE level <= full_at), 0) * weight) AS target
      FROM l),
p AS (SELECT d.*, s.place, s.source_size, s.target, s.shards, number % s.shards AS shard
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
seats AS (SELECT 0 AS everything, *, floor(sum(target) OVER () / {BLOCK_WORDS} + 0.5)::BIGINT AS n FROM s),
{_apportioned("q1", "seats", "everything", "place", "target", "n")},
sh AS (SELECT place, shard, shard % ceil(sqrt(shards))::BIGINT AS grp, sum(size)::BIGINT AS words FROM p GROUP BY place, shard, shards),
g AS (SELECT place, grp, sum(words)::BIGINT AS words, max(q1.quota) AS n FROM sh JOIN q1 USING (place) GROUP BY place, grp),
{_apportioned("q2", "g", "place", "grp", "words", "n")},
h AS (SELECT sh.*, q2.quota AS n FROM sh JOIN q2 USING (place, grp)),
{_apportioned("q3", "h", "place, grp", "shard", "words", "n")},
w AS (SELECT place, shard, words, ceil(words / {BLOCK_WORDS})::BIGINT AS blocks, coalesce(quota, 0) AS quota
      FROM sh LEFT JOIN q3 USING (place, grp, shard) WHERE words > 0),
b AS (SELECT place, shard, block, least(2, quota // blocks) AS rounds, CASE WHEN quota // blocks < 2 THEN quota % blocks ELSE 0 END AS extra,
             row_number() OVER (PARTITION BY place, shard ORDER BY block = blocks - 1, {_number_sql("place", "shard", "block")}, block) AS r
      FROM w, range(0, blocks) AS x(block)),
a AS (SELECT *, row_number() OVER () AS rid, sum(size) OVER (PARTITION BY place, shard ORDER BY number, doc_id::VARCHAR, size
                                     ROWS UNBOUNDED PRECEDING) - size AS start FROM p),
k AS (SELECT rid, sum((least(start + size, (block + 1) * {BLOCK_WORDS}) - greatest(start, block * {BLOCK_WORDS}))
                      * (rounds + (r <= extra)::INT))::BIGINT AS taken
      FROM a JOIN b ON a.place = b.place AND a.shard = b.shard AND size > 0
       AND block BETWEEN start // {BLOCK_WORDS} AND (start + size - 1) // {BLOCK_WORDS} GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM a LEFT JOIN k USING (rid)
"""
