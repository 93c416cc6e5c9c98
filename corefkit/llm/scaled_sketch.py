"""Document fingerprints: threshold-scaled sketches.

The sketch of a text is the set of its word-shingle hashes below a fixed
fraction of the hash range. Which hashes stay depends on no other hash of the
text, so sketches merge by union and documents of very different lengths can be
compared: the share of the smaller sketch that lies in the larger one estimates
containment. A text with words but no hash below the fraction keeps its smallest
hash, so that only texts without words have an empty sketch.

A fraction says little about a text of few shingles. A text of at most ``whole``
distinct ones therefore keeps them all. ``likeness`` needs two sketches and nothing
else: a sketch with hashes above the fraction holds all of its text's, so two such
sketches are compared on everything and what they share is counted, not estimated.
Any other two are compared on what both retain, the hashes below the fraction.

``fingerprint_edits`` also fingerprints an edited text, whose last quarter is
replaced by the beginning of the next document. Documents are shuffled once, by bucket: a
stretch of the id axis that holds about ``BUCKET_ROWS`` ids. Within a bucket the next document is the
next row, so it is not sent anywhere; only the last id of each bucket asks another one, the
first of a later bucket, which the table of following ids names (made of ids alone, by
windows within range partitions and one boundary row per partition). Hashes are made behind
that exchange, which carries texts alone, once for a text and once for its edit.

All columns are DataFrame expressions. Ids ascend with null first; rows that
share an id have the same next document, and where several rows have the next id
the smallest text of them is used. Null texts count as empty. A single document is its own
next one. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corefkit.functions.text import let
from corefkit.llm.common import WORD_PATTERN, documents, staged

SHINGLE = 5
#: One hash in so many is kept.
SCALE = 2
#: Texts of at most so many distinct shingles keep all hashes.
WHOLE = 64
#: Ids of a bucket, if they are spread evenly; a crowded stretch has more, which only makes its tasks longer.
BUCKET_ROWS = 1 << 10


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """Hash of every word shingle (fewer words: of them all; none: no hash)."""
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD_PATTERN), 0), lambda w: F.xxhash64(w))
    return let(words, lambda w: F.when(F.size(w) >= shingle, F.transform(
        F.sequence(F.lit(1), F.size(w) - (shingle - 1)), lambda i: F.xxhash64(F.slice(w, i, shingle))))
        .when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<long>")))


def distinct_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    return F.array_distinct(shingle_hashes(text, shingle))


def _limit(scale: int) -> int:
    """The largest hash that lies in the retained fraction."""
    return -(1 << 63) + (1 << 64) // scale - 1


def thin(hashes: Column, scale: int = SCALE) -> Column:
    """Those of some distinct hashes that a sketch retains; if none, the smallest."""
    return let(F.filter(hashes, lambda x: x <= F.lit(_limit(scale))), lambda kept: F.when(F.size(kept) > 0, kept).when(
        F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(hashes))


def sketch_of(hashes: Column, scale: int = SCALE, whole: int = 0) -> Column:
    """The sketch, ascending, of a text with these distinct hashes."""
    return F.sort_array(F.when(F.size(hashes) <= whole, hashes).otherwise(thin(hashes, scale)))


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE, whole: int = 0) -> Column:
    """The retained hashes, ascending; all of them if there are at most ``whole``."""
    return let(distinct_hashes(text, shingle), lambda h: sketch_of(h, scale, whole))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that the larger one holds; 1 for two empty ones, 0 for one."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(
        (F.size(a) == F.size(b)).cast("double"))


def likeness(a: Column, b: Column, scale: int = SCALE) -> Column:
    """``containment`` from two sketches alone: on all hashes if both hold all, else on those below the fraction."""
    limit = F.lit(_limit(scale))
    complete = (F.array_max(a) > limit) & (F.array_max(b) > limit)
    none = (F.size(a) == 0) | (F.size(b) == 0)
    below = lambda hashes: F.filter(hashes, lambda x: x <= limit)
    return F.when(none | complete, containment(a, b)).otherwise(
        let(below(a), lambda x: let(below(b), lambda y: containment(x, y))))


def merge(sketches: Column, scale: int = SCALE) -> Column:
    """The sketch of several texts together, from an array of their sketches (of whole ones, what the scale retains)."""
    return F.sort_array(let(F.array_distinct(F.flatten(sketches)), lambda all_: thin(all_, scale)))


def as_text(hashes: Column) -> Column:
    """16 lowercase hex digits a hash."""
    return F.lower(F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def next_ids(ids: DataFrame) -> DataFrame:
    """(known, id, ...) distinct -> the same with next_known, next_id: the following id, after the last the first."""
    parts = staged(ids.repartitionByRange("known", "id").withColumn("part", F.spark_partition_id()), "ids")
    place = F.struct("known", "id")
    # one row per partition of the id table
    firsts = parts.groupBy("part").agg(F.min(place).alias("first"))
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(Window.orderBy("part")),
                                              F.first("first").over(Window.orderBy("part"))).alias("after"))
    following = F.lead(place).over(Window.partitionBy("part").orderBy("known", "id"))
    rows = parts.withColumn("following", following).join(firsts, "part")
    after = F.coalesce("following", "after")
    return rows.select(*ids.columns, after["known"].alias("next_known"), after["id"].alias("next_id"))


def fingerprint_edits(docs: DataFrame, shingle: int = SHINGLE, scale: int = SCALE, whole: int = 0,
                      bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts of at most ``whole`` distinct shingles keep all their hashes. ``near_edited`` and ``near_next`` are the
    ``likeness`` of the fingerprints of the text and of the edited text, or of the next document.
    """
    text = F.coalesce("text", F.lit(""))
    known, id_ = F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id")
    nexts = staged(next_ids(docs.select(known, id_).distinct()), "next_ids")
    n, low, high = nexts.where("known").agg(F.count(F.lit(1)), F.min("id"), F.max("id")).first()
    width = max(1, (high - low) // max(1, n // bucket_rows)) if n else 1
    bucket = F.when(F.col("known"), F.expr(f"id div {width}L"))  # ids ascend with it; null ids have one of their own
    # the one exchange of the texts
    rows = docs.select(known, id_, text.alias("text")).withColumn("bucket", bucket).repartition("bucket")
    own = Window.partitionBy("bucket")
    placed = rows.withColumn("place", F.dense_rank().over(own.orderBy("known", "id")))
    placed = placed.withColumn("last", F.max("place").over(own))
    sketched = placed.withColumn("own", sketch(F.col("text"), shingle, scale, whole))
    document = F.struct("text", "own")
    inside = sketched.withColumn("given", F.min(document).over(own.orderBy("place").rangeBetween(1, 1))).where("place < last")
    # the last ids of the buckets meet the first ones
    first = (sketched.where("place = 1").groupBy(F.col("known").alias("next_known"), F.col("id").alias("next_id"))
             .agg(F.min(document).alias("given")))
    across = (sketched.where("place = last").join(nexts, ["known", "id"]).join(first, ["next_known", "next_id"]))
    columns = ["known", "id", "text", "own", "given"]
    both = inside.select(columns).unionByName(across.select(columns))
    chars = F.char_length("text")
    change = F.floor(chars / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), chars - change),
                      F.substring(F.col("given.text"), F.lit(1), change))
    made = both.select("known", "id", chars.cast("long").alias("n_chars"), "own", F.col("given.own").alias("following"),
                       edited.alias("edited"))
    made = made.withColumn("changed", sketch(F.col("edited"), shingle, scale, whole))
    return made.select(F.when(F.col("known"), F.col("id")).alias("doc_id"), "n_chars",
                       F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"),
                       as_text(F.col("changed")).alias("edited_fingerprint"),
                       likeness(F.col("own"), F.col("changed"), scale).alias("near_edited"),
                       likeness(F.col("own"), F.col("following"), scale).alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir, "doc_id", "text"), whole=WHOLE)
