"""URL filter: rules by host and path, and for the rest an exact Bloom filter cascade.

The key universe is every distinct host of the corpus; the listed keys come as a table
of hosts. Level 1 is a Bloom filter of the listed hosts. The other hosts that pass it by
mistake go into level 2, the listed hosts that pass level 2 into level 3, and so on until
no mistake is left. A host is listed exactly if the first level that rejects it
has an even number, or no level rejects it and the last has an odd number. For
every host of the universe the answer is exact, and judging urls takes no join.

Keys are dealt into shards by hash, about ``SHARD_KEYS`` listed ones each, and every shard has a
cascade of its own, so no filter outgrows a few MB and all shards are built by the same
jobs. A filter is filled by position: the set bits of a level meet zeros for all its words,
words are put in order within chunks and chunks within the shard. Each filter is staged and
enters the next plan as a scalar; together they are about 12 bits per listed host.

The block list of the query is a stated rule: hosts with a label, or a part of one, that names
a category which public block lists cover (``BLOCK_TERMS``).

Null urls, urls without ``://`` and empty hosts have host and path empty: no rule
fits, and they are not listed. Rows are judged one by one, so repeated rows,
null ids and extra columns have no effect; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corefkit.llm.common import LOWER, UPPER, conjunction, staged

#: (verdict, host and path): the contract's rules.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))
#: Fixed words of the usual categories of block lists: adult, gambling, pharmacy, advertising and tracking, spam and fraud.
BLOCK_TERMS = ("adult", "escort", "escorts", "nude", "porn", "porno", "sex", "xxx",
               "bet", "bets", "betting", "bingo", "casino", "casinos", "gambling", "jackpot", "lottery", "poker", "slots",
               "cialis", "pharma", "pill", "pills", "viagra",
               "adserver", "ads", "adtech", "banner", "banners", "popup", "popups", "track", "tracker", "tracking",
               "hack", "malware", "phish", "phishing", "scam", "spam", "spyware", "warez")

BITS_PER_KEY = 10
HASHES = 4
#: Listed keys of a shard: 2.6 MB of words for its first level.
SHARD_KEYS = 1 << 21
#: Words of a filter that are put in order together.
CHUNK_WORDS = 1 << 10


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: up to ``/?#`` (A-Z lower-cased), and from there up to ``?#``."""
    after = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(after, r"^[^/?#]*(/[^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, text in sorted(rules, key=lambda r: len(r[1])):  # later ones win
        domain, _, prefix = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + prefix)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(name)).otherwise(verdict)
    return rule, verdict


def named_by(host: Column, terms: Sequence[str] = BLOCK_TERMS) -> Column:
    """Whether a label of the host, or a part of one between hyphens, is one of the terms."""
    return F.arrays_overlap(F.split(host, r"[.-]"), F.array(*[F.lit(t) for t in terms]))


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(shards))


def _places(key: Column, level: int, bits: int) -> list[Column]:
    """The bits of a key: double hashing of two 64-bit hashes that differ by level."""
    a, b = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1))
    return [F.pmod(a.bitwiseXOR(F.shiftright(b, 7 * k)) if k else a, F.lit(bits)) for k in range(HASHES)]


def _level(keys: DataFrame, level: int, bits: int, shards: int) -> DataFrame:
    """One row per shard: the words of its filter in order."""
    n_words = bits >> 6
    at = keys.select(_shard(F.col("key"), shards).alias("shard"), F.explode(F.array(*_places(F.col("key"), level, bits))).alias("place"))
    held = at.select("shard", F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, int(place & 63))").alias("bits"))
    zeros = keys.sparkSession.range(shards * n_words).select(
        F.expr(f"id div {n_words}").alias("shard"), F.expr(f"id % {n_words}").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = held.unionByName(zeros).groupBy("shard", "word").agg(F.bit_or("bits").alias("bits"))
    chunks = words.groupBy("shard", F.expr(f"word div {CHUNK_WORDS}").alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("part"))
    return chunks.groupBy("shard").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("chunk", F.col("part.bits").alias("bits")))), lambda c: c["bits"])).alias("words"))


@dataclass
class Cascade:
    """The levels of all shards: bits of a filter, and a table of one filter per shard."""

    shards: int
    levels: list[tuple[int, DataFrame]] = field(default_factory=list)

    def passes(self, key: Column, level: int) -> Column:
        """Whether the level's filter of the key's shard lets the key through."""
        bits, filters = self.levels[level]
        places = _places(key, level, bits)

        def of(shard: int) -> Column:
            words = filters.where(F.col("shard") == shard).select("words").scalar()
            return conjunction([F.getbit(F.element_at(words, (F.shiftright(p, 6) + 1).cast("int")),
                                         p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in places])

        answer = of(self.shards - 1)
        for shard in reversed(range(self.shards - 1)):
            answer = F.when(_shard(key, self.shards) == shard, of(shard)).otherwise(answer)
        return answer

    def is_listed(self, key: Column) -> Column:
        """Membership for any key of the universe."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for k in reversed(range(len(self.levels))):
            answer = F.when(~self.passes(key, k), F.lit(k % 2 == 1)).otherwise(answer)
        return answer


def build_cascade(hosts: DataFrame, shard_keys: int = SHARD_KEYS) -> Cascade:
    """The cascade for ``hosts`` (key, listed): the universe, each key once."""
    keys, of_listed = hosts, True
    cascade = Cascade(max(1, -(-hosts.where("listed").count() // shard_keys)))
    while True:
        encoded = keys.where(F.col("listed") == of_listed)
        largest = encoded.groupBy(_shard(F.col("key"), cascade.shards)).count().agg(F.max("count")).first()[0]
        if not largest:
            return cascade
        k, bits = len(cascade.levels), max(64, -(-largest * BITS_PER_KEY // 64) * 64)
        cascade.levels.append((bits, staged(_level(encoded, k, bits, cascade.shards), "level")))
        # the next level is about the keys of the other kind that pass this one; the encoded ones stay in play
        keys = staged(keys.where((F.col("listed") == of_listed) | cascade.passes(F.col("key"), k)), "in_play")
        of_listed = not of_listed


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, listed: DataFrame | None = None,
               shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. ``listed``: a table of hosts (host); by default those that
    :func:`named_by` names."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    hosts = staged(urls.select(F.col("host").alias("key")).where("host != ''").distinct(), "hosts")
    names = hosts.where(named_by(F.col("key"))) if listed is None else listed.select(F.col("host").alias("key")).distinct()
    universe = staged(hosts.join(names.withColumn("listed", F.lit(True)), "key", "left")
                      .select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "universe")
    is_listed = (F.col("host") != "") & build_cascade(universe, shard_keys).is_listed(F.col("host"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return urls.select("page_id", "host", "path", rule.alias("rule"),
                       F.coalesce(verdict, F.when(is_listed, "block").otherwise("allow")).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def _oracle() -> str:
    cases = sorted(RULES, key=lambda r: -len(r[1]))
    fits = {t: "((host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}'))".format(*t.split("/", 1))
            for _, t in cases}
    rule = " ".join(f"WHEN {fits[t]} THEN '{t}'" for _, t in cases)
    verdict = " ".join(f"WHEN {fits[t]} THEN '{v}'" for v, t in cases)
    terms = ", ".join(f"'{t}'" for t in BLOCK_TERMS)
    return f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
                                THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM a)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN list_has_any(regexp_split_to_array(host, '[.-]'), [{terms}]) THEN 'block' ELSE 'allow' END AS verdict
FROM u
"""


ORACLE = _oracle()
