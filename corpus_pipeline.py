"""The corpus pipeline: a chain of stages over ``documents``, each one of the operators of ``corefkit.llm``.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and is written as Parquet in the cluster's shared folder and reread as the next
stage's input, so a lost executor repeats part of one stage at most.

1. toxicity: rows that the pattern grammar scores 0.5 or more go.
2. exact dedup: of equal texts (A-Z lower-cased) the row with the largest doc_id stays.
3. SimHash near-dedup: of each linked group the row with the smallest doc_id stays.
4. mixing: sources are mixed to their target weights; a document has a row for
   each time that words of it are taken, with these words as its text.
5. byte-level BPE: the ids of every text, with digests of ids and decoded bytes.

All but the last return the columns of documents. Null texts count as empty: they
are scored, compared and grouped as such, and leave in the mix, which takes words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corefkit.llm import bpe, exact_dedup, mixing, simhash, toxicity
from corefkit.llm.common import staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.production(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL expresses neither the trained toxicity score nor BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage{k}")
    return docs
