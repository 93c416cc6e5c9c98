"""A pair classifier trained and applied as a Spark ML job (INF4).

The reference fine-tunes a transformer encoder on one GPU; that training
loop is not rebuilt. What is rebuilt is the *job*: featurize the marked
pair texts, fit a classifier on the training split, keep the setting with
the best class-1 F1 on the dev split, and score the test split -- all
distributed (Spark ML), with metrics from the same aggregates as A10.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corefkit.functions.text import BLANK, words
from corefkit.operators.metrics import encoder_eval
from corefkit.operators.prompts import encoder_text
from corefkit.session import staged

N_FEATURES = 1 << 12
N_OVERLAP = 4
MAX_ITER, TOL = 50, 1e-4


def _bigrams(w) -> Column:
    """Distinct character pairs of a string."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))),
                                        lambda k: F.substring(w, k, F.lit(2))))


def features(df: DataFrame) -> DataFrame:
    """M5 texts plus trigger-overlap features (pure column expressions)."""
    t = encoder_text(df)
    w1, w2 = words(F.lower("e1_trigger")), words(F.lower("e2_trigger"))
    s1, s2 = words(F.lower("sentence1")), words(F.lower("sentence2"))
    inter = F.size(F.array_intersect(s1, s2)).cast("double")
    union = F.size(F.array_union(s1, s2)).cast("double")
    c1, c2 = _bigrams(F.lower("e1_trigger")), _bigrams(F.lower("e2_trigger"))
    shared = F.size(F.array_intersect(c1, c2)).cast("double")
    return t.withColumns({
        "f_same_trigger": (F.lower("e1_trigger") == F.lower("e2_trigger")).cast("double"),
        "f_trigger_overlap": F.size(F.array_intersect(w1, w2)).cast("double"),
        "f_jaccard": F.when(union > 0, inter / union).otherwise(F.lit(0.0)),
        "f_trigger_chars": shared / F.size(F.array_union(c1, c2)),
        "label_d": F.col("label").cast("double"),
    })


def vectors(df: DataFrame, keep: Sequence[str] = (), n_features: int = N_FEATURES) -> DataFrame:
    """``label_d``, the ``keep`` columns and one sparse ``features`` vector: hashed words of both texts and the overlaps.

    The stages learn nothing, so every split gets its vectors in one pass of its own.
    """
    tok_a = RegexTokenizer(inputCol="text_a", outputCol="tok_a", pattern=BLANK + "+", toLowercase=True)
    tok_b = RegexTokenizer(inputCol="text_b", outputCol="tok_b", pattern=BLANK + "+", toLowercase=True)
    tf_a = HashingTF(inputCol="tok_a", outputCol="tf_a", numFeatures=n_features)
    tf_b = HashingTF(inputCol="tok_b", outputCol="tf_b", numFeatures=n_features)
    vec = VectorAssembler(inputCols=["tf_a", "tf_b", "f_same_trigger", "f_trigger_overlap", "f_jaccard",
                                     "f_trigger_chars"], outputCol="features")
    out = features(df)
    for stage in (tok_a, tok_b, tf_a, tf_b, vec):
        out = stage.transform(out)
    return out.select(*keep, "label_d", "features")


def fit(train: DataFrame, dev: DataFrame, reg_params: Sequence[float] = (0.01, 0.1), n_features: int = N_FEATURES,
        max_iter: int = MAX_ITER, tol: float = TOL) -> LogisticRegressionModel:
    """A class-weighted logistic regression per ``reg_param``; the one with the best class-1 F1 on ``dev``.

    The vectors of both tables are written once to the shared folder; all settings and
    optimizer iterations read them.
    """
    tr, dv = staged(vectors(train, n_features=n_features), "train_vectors"), staged(vectors(dev, n_features=n_features), "dev_vectors")
    share = tr.agg(F.avg("label_d")).first()[0] or 0.0
    positive = min(max(share, 1e-3), 1 - 1e-3)
    tr = tr.withColumn("weight", F.when(F.col("label_d") == 1, 0.5 / positive).otherwise(0.5 / (1 - positive)))
    best, best_f1 = None, -1.0
    for rp in reg_params:
        model = LogisticRegression(featuresCol="features", labelCol="label_d", maxIter=max_iter, tol=tol, regParam=rp,
                                   weightCol="weight").fit(tr)
        scored = _scored(model, dv.withColumn("label", F.col("label_d").cast("int")))
        m = encoder_eval(scored).select("f1_class1").first()
        f1 = m["f1_class1"] if m and m["f1_class1"] is not None else 0.0
        if f1 > best_f1:
            best, best_f1 = model, f1
    return best


def predict(model: LogisticRegressionModel, df: DataFrame, keep: Sequence[str] = ("pair_id", "label")) -> DataFrame:
    """The ``keep`` columns of every pair with ``pred`` (int) and ``prob1``."""
    n_features = (model.numFeatures - N_OVERLAP) // 2
    return _scored(model, vectors(df, keep, n_features)).select(*keep, "pred", "prob1")


def _scored(model: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumns({
        "pred": F.col("prediction").cast("int"),
        "prob1": F.get(vector_to_array(F.col("probability")), 1),
    })
