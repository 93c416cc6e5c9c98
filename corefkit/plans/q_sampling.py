"""Registered queries for sampling, batching, set operations and anti joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from corefkit.operators import sampling as S
from corefkit.operators.joins import distinct_values, union_all, unsampled
from corefkit.plans import fixtures as fx
from corefkit.plans.oracle_ctes import oracle
from corefkit.registry import register
from corefkit.session import staged

SEED = 42
N_SAMPLE = 1000
N_NEGATIVE = 800
N_UNIQUE = 600
DATA_COLS = [c for c in fx.PAIR_COLUMNS if c != "pair_id"]


def rk(salt: str | None = None, col: str = "pair_id") -> str:
    prefix = f"{SEED}:" if salt is None else f"{SEED}:{salt}:"
    return f"md5('{prefix}' || CAST({col} AS VARCHAR))"


_NEG_SAMPLE = f"(SELECT * FROM pairs WHERE label = 0 ORDER BY {rk()}, pair_id LIMIT {N_SAMPLE})"


@register("positives", oracle("SELECT pair_id, label FROM pairs WHERE label = 1"), "P4")
def q_positives(spark, sf_dir):
    return fx.pairs(spark, sf_dir).where(F.col("label") == 1).select("pair_id", "label")


@register("negatives", oracle("SELECT pair_id, label FROM pairs WHERE label = 0"), "P4")
def q_negatives(spark, sf_dir):
    return fx.pairs(spark, sf_dir).where(F.col("label") == 0).select("pair_id", "label")


@register("sample_n", oracle(f"SELECT pair_id, label FROM {_NEG_SAMPLE}"), "T1")
def q_sample_n(spark, sf_dir):
    neg = fx.pairs(spark, sf_dir).where(F.col("label") == 0)
    return S.sample_n(neg.select("pair_id", "label"), N_SAMPLE, SEED)


@register("sample_n_histogram", oracle(f"SELECT pair_id, label FROM {_NEG_SAMPLE}"), "T1")
def q_sample_n_histogram(spark, sf_dir):
    neg = fx.pairs(spark, sf_dir).where(F.col("label") == 0)
    return S.sample_n(neg.select("pair_id", "label"), N_SAMPLE, SEED)


@register("sample_fraction", oracle(
    f"""SELECT pair_id, label FROM (SELECT pair_id, label, row_number() OVER (ORDER BY {rk()}, pair_id) rn,
            count(*) OVER () c FROM pairs) WHERE rn <= round_even(0.1 * c, 0)"""), "T2")
def q_sample_fraction(spark, sf_dir):
    return S.sample_fraction(fx.pairs(spark, sf_dir).select("pair_id", "label"), 0.1, SEED)


@register("shuffle_keyed", oracle(f"SELECT pair_id, {rk('shuffle')} shuffle_key FROM pairs"), "T3")
def q_shuffle_keyed(spark, sf_dir):
    return S.shuffle_keyed(fx.pairs(spark, sf_dir), SEED).select("pair_id", "shuffle_key")


def bal_cte(src: str = "pairs") -> str:
    return f"""bal AS (SELECT * FROM {src} WHERE label = 1
    UNION ALL (SELECT * FROM {src} WHERE label = 0 ORDER BY {rk()}, pair_id LIMIT {N_NEGATIVE}))"""


_BAL = bal_cte()


@register("balanced_dataset", oracle(f"SELECT pair_id, label, {rk('shuffle')} shuffle_key FROM bal", _BAL), "T4")
def q_balanced_dataset(spark, sf_dir):
    return S.balanced(fx.pairs(spark, sf_dir).select("pair_id", "label"), N_NEGATIVE, SEED)


_DATA = ", ".join(DATA_COLS)


def t5_ctes(data_cols, src: str = "pairs") -> list[str]:
    """T5 over ``src``: balanced set, first rows per sentence, two samples, union, top-up."""
    data = ", ".join(data_cols)
    return [
        bal_cte(src),
        f"""f1 AS (SELECT min_by(pair_id, row({rk('shuffle')}, pair_id)) pair_id FROM bal GROUP BY sentence1)""",
        f"""f2 AS (SELECT min_by(pair_id, row({rk('shuffle')}, pair_id)) pair_id FROM bal GROUP BY sentence2)""",
        f"""u1 AS (SELECT b.* FROM bal b JOIN f1 USING (pair_id) ORDER BY {rk('s1')}, pair_id LIMIT {N_UNIQUE})""",
        f"""u2 AS (SELECT b.* FROM bal b JOIN f2 USING (pair_id) ORDER BY {rk('s2')}, pair_id LIMIT {N_UNIQUE})""",
        f"""comb AS (SELECT min(pair_id) pair_id FROM (SELECT * FROM u1 UNION ALL SELECT * FROM u2) GROUP BY {data})""",
        """rem AS (SELECT pair_id FROM bal WHERE label = 1 AND pair_id NOT IN (SELECT pair_id FROM comb))""",
        f"""cand AS (SELECT pair_id, 0 p, {rk('final')} k FROM comb UNION ALL
                     SELECT pair_id, 1 p, {rk('topup')} k FROM rem)""",
        f"""pick AS (SELECT pair_id FROM cand ORDER BY p, k, pair_id LIMIT {N_UNIQUE})""",
    ]


_T5 = t5_ctes(DATA_COLS)
T5_RESULT = f"SELECT pair_id, label, {rk('shuffle')} shuffle_key FROM pick JOIN bal USING (pair_id)"


@register("unique_sample", oracle(T5_RESULT, *_T5), "T5", "U1", "U2", "J1")
def q_unique_sample(spark, sf_dir):
    bal = S.balanced(fx.pairs(spark, sf_dir), N_NEGATIVE, SEED).drop("shuffle_key")
    return S.unique_sample(bal, N_UNIQUE, SEED).select("pair_id", "label", "shuffle_key")


@register("first_per_sentence", oracle(
    f"""SELECT p.pair_id, p.sentence1 FROM pairs p JOIN
        (SELECT min_by(pair_id, row({rk('shuffle')}, pair_id)) pair_id FROM pairs GROUP BY sentence1) f USING (pair_id)"""),
    "W2")
def q_first_per_sentence(spark, sf_dir):
    return S.first_per_key(fx.pairs(spark, sf_dir).select("pair_id", "sentence1"), "sentence1", SEED)


@register("assign_batches", oracle(
    """SELECT pair_id, source, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY pair_id) - 1) / 50) AS BIGINT)
        batch_id FROM pairs"""), "T6")
def q_assign_batches(spark, sf_dir):
    p = fx.pairs(spark, sf_dir).select("pair_id", "source")
    return S.assign_batches(p, 50, "pair_id", by=["source"]).select("pair_id", "source", "batch_id")


@register("batched_splits", oracle(
    f"""SELECT pair_id, split, CAST(floor((row_number() OVER (PARTITION BY split ORDER BY {rk('shuffle')}) - 1) / 64) AS BIGINT)
            batch_id FROM splits WHERE split = 'train'
        UNION ALL
        SELECT pair_id, split, CAST(floor((row_number() OVER (PARTITION BY split ORDER BY pair_id) - 1) / 128) AS BIGINT)
            batch_id FROM splits WHERE split <> 'train'"""), "T7")
def q_batched_splits(spark, sf_dir):
    s = staged(fx.splits(spark, sf_dir).select("pair_id", "split"), "splits")
    train = S.shuffle_keyed(s.where(F.col("split") == "train"), SEED)
    train = S.assign_batches(train, 64, "shuffle_key", by=["split"])
    rest = S.assign_batches(s.where(F.col("split") != "train"), 128, "pair_id", by=["split"])
    return train.select("pair_id", "split", "batch_id").unionByName(rest.select("pair_id", "split", "batch_id"))


@register("oversample_positives", oracle(
    """SELECT pair_id, CAST(unnest(range(1, CASE WHEN label = 1 THEN 4 ELSE 2 END)) AS INT) copy_no FROM pairs"""), "T8")
def q_oversample_positives(spark, sf_dir):
    return S.oversample_positives(fx.pairs(spark, sf_dir), 3).select("pair_id", "copy_no")


@register("row_range", oracle("SELECT pair_id FROM pairs ORDER BY pair_id LIMIT 500 OFFSET 100"), "P8")
def q_row_range(spark, sf_dir):
    return S.row_range(fx.pairs(spark, sf_dir).select("pair_id"), 100, 600)


@register("unsampled_rows", oracle(
    f"SELECT pair_id, label FROM pairs WHERE pair_id NOT IN (SELECT pair_id FROM {_NEG_SAMPLE})"), "J1")
def q_unsampled_rows(spark, sf_dir):
    p = staged(fx.pairs(spark, sf_dir).select("pair_id", "label"), "pairs")
    sample = S.sample_n(p.where(F.col("label") == 0), N_SAMPLE, SEED)
    return unsampled(p, sample)


@register("union_pairs", oracle(
    f"SELECT pair_id, label FROM pairs WHERE label = 1 UNION ALL SELECT pair_id, label FROM {_NEG_SAMPLE}"), "U1")
def q_union_pairs(spark, sf_dir):
    p = staged(fx.pairs(spark, sf_dir).select("pair_id", "label"), "pairs")
    pos = p.where(F.col("label") == 1)
    neg = S.sample_n(p.where(F.col("label") == 0), N_SAMPLE, SEED)
    return union_all(pos, neg)


@register("distinct_pairs", oracle(
    f"""SELECT min(pair_id) pair_id, label FROM (SELECT * FROM pairs WHERE label = 1 UNION ALL
        SELECT * FROM pairs WHERE label = 1 UNION ALL SELECT * FROM pairs) GROUP BY {_DATA}"""), "U2")
def q_distinct_pairs(spark, sf_dir):
    p = staged(fx.pairs(spark, sf_dir), "pairs")
    pos = p.where(F.col("label") == 1)
    return S.distinct_rows(union_all(pos, pos, p), DATA_COLS).select("pair_id", "label")


@register("distinct_classes", oracle(
    "SELECT DISTINCT v AS value FROM (SELECT label v FROM preds_multi UNION ALL SELECT pred FROM preds_multi) WHERE v IS NOT NULL"),
    "U3", "T9")
def q_distinct_classes(spark, sf_dir):
    return distinct_values(fx.preds_multi(spark, sf_dir), ["label", "pred"])
