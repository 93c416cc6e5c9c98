"""Synthetic pair tables derived from the driver's Parquet tables.

The reference ships no rows (its data files are LFS pointers), so the
pair, response and training-log tables are built here from ``documents``,
``events`` and ``embeddings``. Every builder is lazy: the work grows with
the input tables and Catalyst prunes what a query does not use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corefkit.functions.parse import tagged_answer
from corefkit.functions.text import WS_CHARS, hash_int, let, words

# Fixed values of the fixture definition.
PAIR_ID_BASE = 1_000_003  # pair_id = document id * base + line number; unique up to so many lines in a document
RUN_EPOCH = "2024-01-01 00:00:00"

PAIR_COLUMNS = [
    "pair_id", "source",
    "sentence1", "e1_trigger_start", "e1_trigger_end", "e1_trigger",
    "sentence2", "e2_trigger_start", "e2_trigger_end", "e2_trigger",
    "label",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _mention(w: Column, doc_id: Column, line: Column) -> Column:
    n = F.size(w)
    t_start = ((doc_id * 7 + line * 3) % n).cast("int")
    t_end = F.least(t_start + (doc_id + line) % 2, n - 1).cast("int")
    return F.struct(
        line.cast("long").alias("line"), F.array_join(w, " ").alias("sentence"),
        t_start.alias("t_start"), t_end.alias("t_end"),
        F.array_join(F.slice(w, t_start + 1, t_end - t_start + 1), " ").alias("trig"),
    )


def _mentions(doc_id: Column) -> Column:
    """An array of one mention per line of ``text`` that has words; no word is left out."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x: words(x)), lambda w: F.size(w) > 0)
    return F.transform(lines, lambda w, k: _mention(w, doc_id, k))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mention per line of every document: all its words, a 1-2 word trigger."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return docs.select("doc_id", "source", "lang", F.inline(_mentions(F.col("doc_id"))))


def _pair(a: Column, b: Column) -> list[Column]:
    out = []
    for k, m in (("1", a), ("2", b)):
        out += [m["sentence"].alias(f"sentence{k}"), m["t_start"].alias(f"e{k}_trigger_start"),
                m["t_end"].alias(f"e{k}_trigger_end"), m["trig"].alias(f"e{k}_trigger")]
    return out


def pairs_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the next line of the corpus, so the pairs grow with the lines.

    Within a document that is the next element of its array. The last line of a
    document meets the first line of the document with the next id, which an
    equality join on a unique key brings along, so no key is hot. A pair has the
    source of its first line.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    # The first line with words, as the partner of the document before: it begins at the first character that is no blank.
    # Only the start of a text is looked at, as this runs where the table is read, in one task if it is one row group.
    start = words(F.substring_index(F.ltrim("text", F.lit(WS_CHARS)), "\n", 1))
    first = let(start, lambda w: F.when(F.size(w) > 0, _mention(w, F.col("doc_id"), F.lit(0))))
    firsts = docs.select("doc_id", "lang", first.alias("next")).select(
        (F.col("doc_id") - 1).alias("doc_id"), F.col("lang").alias("next_lang"), "next")
    # Documents are dealt by id, so that the work per document runs in parallel even when the table is one
    # file; AQE chooses the number of partitions.
    docs = docs.repartition("doc_id").join(firsts, "doc_id", "left")
    none = F.array().cast("array<struct<line:bigint,sentence:string,t_start:int,t_end:int,trig:string>>")
    after = F.when(F.col("next").isNotNull(), F.array("next")).otherwise(none)
    row = let(_mentions(F.col("doc_id")), lambda own: let(F.concat(own, after), lambda m: F.when(
        (F.size(own) > 0) & (F.size(m) > 1), F.transform(F.sequence(F.lit(0), F.size(m) - 2), lambda k: F.struct(
            m[k].alias("a"), m[k + 1].alias("b"), (k + 1 == F.size(own)).alias("across"))))))
    both = docs.select("doc_id", "source", "lang", "next_lang", F.inline(row))
    j = both.select(
        F.col("a.line").alias("line1"), "source", F.col("doc_id").alias("doc1"),
        (F.col("doc_id") + F.col("across").cast("int")).alias("doc2"), F.col("lang").alias("lang1"),
        F.when(F.col("across"), F.col("next_lang")).otherwise(F.col("lang")).alias("lang2"),
        *_pair(F.col("a"), F.col("b")))
    same_initial = F.substring(F.lower("e1_trigger"), 1, 1) == F.substring(F.lower("e2_trigger"), 1, 1)
    return j.select(
        (F.col("doc1") * PAIR_ID_BASE + F.col("line1")).alias("pair_id"),
        "source", "doc1", "doc2", "lang1", "lang2",
        "sentence1", "e1_trigger_start", "e1_trigger_end", "e1_trigger",
        "sentence2", "e2_trigger_start", "e2_trigger_end", "e2_trigger",
        F.when(same_initial, F.lit(1)).otherwise(F.lit(0)).alias("label"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_wide(spark, sf_dir).select(*PAIR_COLUMNS)


def _shape(pair_id: Column) -> Column:
    return hash_int(F.concat(F.lit("r:"), pair_id.cast("string"))) % 8


def completion_for(shape: Column, label: Column) -> Column:
    """The eight response shapes (7 = no response)."""
    yn = F.when(label == 1, "Yes").otherwise("No")
    ny = F.when(label == 1, "No").otherwise("Yes")
    nl = F.lit("\n")
    L = F.lit
    return (
        F.when(shape == 0, F.concat(L("<reasoning>"), nl, L("same scene"), nl, L("</reasoning>"), nl,
                                    L("<answer>"), nl, yn, nl, L("</answer>"), nl))
        .when(shape == 1, F.concat(L("<reasoning>"), nl, L("two"), nl, L("lines"), nl, L("</reasoning>"), nl,
                                   L("<answer>"), nl, ny, nl, L("</answer>"), nl))
        .when(shape == 2, F.concat(L("<reasoning>r</reasoning> <answer>"), yn, L("</answer>")))
        .when(shape == 3, F.concat(L("<reasoning>"), nl, L("r"), nl, L("</reasoning>"), nl,
                                   L("<answer>"), nl, yn, nl, L("<answer>")))
        .when(shape == 4, L("I cannot tell"))
        .when(shape == 5, L("<answer>maybe</answer>"))
        .when(shape == 6, F.concat(L("Answer: "), ny, nl, L("Answer: "), yn, L(". </answer> tail")))
    )


def responses_shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir).select("pair_id", "source", "label")
    p = p.withColumn("shape", _shape(F.col("pair_id")))
    return p.withColumn("completion", completion_for(F.col("shape"), F.col("label")))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses_shaped(spark, sf_dir).select("pair_id", "source", "label", "completion")


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with N4 predictions; NULL = invalid."""
    r = responses_shaped(spark, sf_dir)
    return r.select("pair_id", "source", "label", tagged_answer(F.col("completion")).alias("pred"))


def preds_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-class labels: language of the first document vs the second."""
    p = pairs_wide(spark, sf_dir)
    return p.select("pair_id", F.col("lang1").alias("label"), F.col("lang2").alias("pred"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", (F.col("label") % 2).alias("label"),
                    F.col("embedding").cast("array<double>").alias("logits"))


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with the collected-response columns; shapes 4-7 have no reasoning."""
    p = pairs(spark, sf_dir).withColumn("shape", _shape(F.col("pair_id")))
    return p.select(
        *PAIR_COLUMNS,
        completion_for(F.col("shape"), F.col("label")).alias("model_response"),
        F.when(F.col("shape") < 4, F.concat(F.lit("reasoning "), F.col("shape").cast("string")))
        .alias("reasoning_content"),
    )


def response_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection attempts: pairs with ``pair_id % 7 = 0`` needed three."""
    a = answered(spark, sf_dir).select("pair_id", "model_response", "reasoning_content")
    a = a.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.when(F.col("pair_id") % 7 == 0, 3).otherwise(1))))
    retried = F.col("pair_id") % 7 == 0
    return a.select(
        "pair_id", "attempt",
        F.when(retried & (F.col("attempt") == 1), F.lit(None).cast("string"))
        .when(retried & (F.col("attempt") == 2), F.lit("draft"))
        .otherwise(F.col("model_response")).alias("model_response"),
        F.when(retried & (F.col("attempt") < 3), F.lit(None).cast("string"))
        .otherwise(F.col("reasoning_content")).alias("reasoning_content"),
        F.when(retried & (F.col("attempt") == 1), F.lit("timeout")).alias("error"),
    )


def split_of(pair_id: Column) -> Column:
    h = hash_int(F.concat(F.lit("s:"), pair_id.cast("string"))) % 10
    return F.when(h < 8, "train").when(h == 8, "dev").otherwise("test")


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with a ``split`` column; test rows carry the two event ids."""
    p = pairs_wide(spark, sf_dir).withColumn("split", split_of(F.col("pair_id")))
    is_test = F.col("split") == "test"
    return p.select(
        F.when(is_test, F.col("doc1").cast("string")).alias("event_id_1"),
        F.when(is_test, F.col("doc2").cast("string")).alias("event_id_2"),
        *PAIR_COLUMNS, "split",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training log from ``events``: one row per (run, hour step)."""
    ev = table(spark, sf_dir, "events")
    step = F.expr(f"timestampdiff(HOUR, TIMESTAMP_NTZ '{RUN_EPOCH}', ts)").cast("bigint")

    def comp(kind: str) -> Column:
        return F.round(F.avg(F.when(F.col("event_type") == kind, F.col("value"))), 6)

    return ev.groupBy((F.col("user_id") % 5).alias("run_id"), step.alias("step")).agg(
        F.round(F.avg("value"), 6).alias("reward"),
        F.round(F.stddev_pop("value"), 6).alias("reward_std"),
        comp("click").alias("rewards/click_reward_func"),
        comp("view").alias("rewards/view_reward_func"),
        comp("error").alias("rewards/int_reward_func"),
        F.count(F.lit(1)).alias("completion_length"),
    )


# Optional offsets written as -1 in the raw fixture lines.
OPTIONAL_OFFSETS = [f"{p}_{k}" for p in ("participant1", "participant2", "time", "loc") for k in ("start", "end")]


def raw_fields(p: DataFrame, broken: bool = False) -> list[Column]:
    """The 23 positional fields of a raw pair line, as strings."""
    neg = F.lit("-1")
    label = F.col("label").cast("string")
    e1_end = F.col("e1_trigger_end").cast("string")
    if broken:
        label = F.when(F.col("pair_id") % 50 == 0, F.lit("x")).otherwise(label)
        e1_end = F.when(F.col("pair_id") % 50 == 2, F.lit("999")).otherwise(e1_end)
    fields = [F.col("sentence1"), F.col("e1_trigger_start").cast("string"), e1_end]
    fields += [neg] * len(OPTIONAL_OFFSETS)
    fields += [F.col("sentence2"), F.col("e2_trigger_start").cast("string"), F.col("e2_trigger_end").cast("string")]
    fields += [neg] * len(OPTIONAL_OFFSETS)
    if broken:
        # pair_id % 50 = 1 loses its last field.
        fields.append(F.when(F.col("pair_id") % 50 != 1, label))
    else:
        fields.append(label)
    return fields


def raw_lines(spark: SparkSession, sf_dir: str, with_ids: bool = False, broken: bool = False) -> DataFrame:
    """Tab-separated raw pair lines (``value`` column), as the text reader gives them."""
    p = pairs_wide(spark, sf_dir)
    fields = raw_fields(p, broken)
    if with_ids:
        fields = [F.col("doc1").cast("string"), F.col("doc2").cast("string")] + fields
    # concat_ws skips NULLs, so a removed last field leaves no trailing tab.
    return p.select(F.concat_ws("\t", *fields).alias("value"))
