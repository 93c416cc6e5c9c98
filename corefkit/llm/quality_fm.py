"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector x: one feature per hashed distinct word (scaled to
unit length together), standardised statistics of its structure, and its length
as metadata. The machine scores

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

and the pair sum takes time linear in the non-zero features by the identity
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

It is fitted with Adam on the driver on a bounded sample of labelled rows that
are not held out (at most ``MAX_GOOD`` + ``MAX_BAD``; their features, never their
texts, reach the driver) and scores whole texts in Arrow batches where they lie.
The model is ``(BUCKETS + statistics) x (RANK + 1)`` numbers.

Null and empty texts have no words and the statistics of an empty text. With no
labelled row every score is 0.5; labels of one kind only give a constant score.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corefkit.llm.common import documents, held_out, labelled_sample

BUCKETS = 2048
RANK = 8
#: Bounds of the labelled sample that the model is fitted on.
MAX_GOOD, MAX_BAD = 3_000, 3_000
ROUNDS, LEARNING_RATE, L2 = 120, 0.03, 1e-4
THRESHOLD = 0.3

STATISTICS = ("log_chars", "log_words", "word_length", "distinct_words", "top_word", "adjacent_repeats", "upper", "title",
              "digits", "punctuation", "symbols", "ends_in_symbol", "short_words", "line_repeats", "line_length",
              "symbol_only_words", "period_lines")
SYMBOLS = "#$%&*|<>{}[]=+~^_\\@/!"


def statistics(text: str) -> list[float]:
    """Structure of a text, every value of a size near 1."""
    n = len(text)
    words = text.split()
    m = len(words)
    if not m:
        return [math.log1p(n)] + [0.0] * (len(STATISTICS) - 1)
    counts = Counter(words)
    lines = text.split("\n")
    symbols = sum(map(text.count, SYMBOLS))
    upper = sum(w.isupper() for w in words)
    return [
        math.log1p(n), math.log1p(m), n / m / 10, len(counts) / m, max(counts.values()) / m,
        sum(map(str.__eq__, words, words[1:])) / m, upper / m, sum(w[0].isupper() for w in words) / m,
        sum(map(text.count, "0123456789")) / n, sum(map(text.count, ".,;:?'\"()-")) / n, symbols / n,
        sum(w[-1] in SYMBOLS for w in words) / m, sum(len(w) <= 3 for w in words) / m,
        1 - len(set(lines)) / len(lines), math.log1p(n / len(lines)) / 5,
        sum(not w[0].isalnum() and len(w) == 1 for w in words) / m, sum(x.endswith(".") for x in lines) / len(lines),
    ]


def buckets(text: str) -> list[int]:
    """Hashed distinct words."""
    crc = zlib.crc32
    return sorted({crc(w) % BUCKETS for w in set(text.lower().encode().split())})


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # features
    factors: np.ndarray  # features x RANK
    mean: np.ndarray
    scale: np.ndarray

    def dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4)

    def scores(self, words: list[list[int]], stats: np.ndarray) -> np.ndarray:
        """Scores of documents given by their word buckets and statistics."""
        z = self.dense(stats)
        w, v = self.linear[BUCKETS:], self.factors[BUCKETS:]
        linear, sums, squares = z @ w, z @ v, (z * z) @ (v * v)
        sizes = np.array([len(x) for x in words])
        row = np.repeat(np.arange(len(words)), sizes)
        if len(row):
            at = np.concatenate([np.asarray(x, dtype=np.int64) for x in words if x])
            value = 1 / np.sqrt(sizes[row])
            first = np.concatenate([[0], np.cumsum(sizes[sizes > 0])[:-1]])
            have = sizes > 0
            vx = self.factors[at] * value[:, None]
            linear[have] += np.add.reduceat(self.linear[at] * value, first)
            sums[have] += np.add.reduceat(vx, first, axis=0)
            squares[have] += np.add.reduceat(vx * vx, first, axis=0)
        y = self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(y, -30, 30)))


def fit_machine(words: list[list[int]], stats: np.ndarray, labels: np.ndarray, weight: np.ndarray,
                rounds: int = ROUNDS, seed: int = 7) -> Machine:
    """Weighted logistic loss, full batches, Adam."""
    mean, scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3)
    n, d = len(words), BUCKETS + stats.shape[1]
    x = np.zeros((n, d), dtype=np.float32)
    for k, at in enumerate(words):
        if at:
            x[k, at] = 1 / math.sqrt(len(at))
    x[:, BUCKETS:] = np.clip((stats - mean) / scale, -4, 4)
    x2 = x * x
    rng = np.random.default_rng(seed)
    share = np.clip((weight * labels).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    params = [np.array([math.log(share / (1 - share))]), np.zeros(d), rng.normal(0, 0.02, (d, RANK))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = (weight / weight.sum()).astype(np.float32)
    for step in range(1, rounds + 1):
        bias, w, v = params[0], params[1].astype(np.float32), params[2].astype(np.float32)
        sums = x @ v
        y = bias[0] + x @ w + 0.5 * ((sums * sums).sum(axis=1) - x2 @ (v * v).sum(axis=1))
        g = weight * (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels).astype(np.float32)
        grads = [np.array([g.sum()]), x.T @ g + L2 * w, x.T @ (g[:, None] * sums) - (x2.T @ g)[:, None] * v + L2 * v]
        for p, m, s, grad in zip(params, first, second, grads):
            m += 0.1 * (grad - m)
            s += 0.001 * (grad * grad - s)
            p -= LEARNING_RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Machine(float(params[0][0]), params[1], params[2], mean, scale)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"label": pdf.label, "words": [buckets(t) for t in pdf.text],
                            "stats": [statistics(t) for t in pdf.text]})


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Machine:
    """Fit on the labelled rows that are not held out, weighted back to their true shares."""
    rows, shares = labelled_sample(docs, labels, label, {1: MAX_GOOD, 0: MAX_BAD})
    sample = rows.select("text", "label").mapInPandas(
        _features, "label int, words array<int>, stats array<double>").toPandas()
    size = len(STATISTICS)
    if sample.empty or sample.label.nunique() == 1:
        only = 0.0 if sample.empty else (4.0 if sample.label[0] else -4.0)
        return Machine(only, np.zeros(BUCKETS + size), np.zeros((BUCKETS + size, RANK)), np.zeros(size), np.ones(size))
    order = np.lexsort([sample.stats.map(str), sample.label])  # the fit doesn't depend on the order of arrival
    sample = sample.iloc[order]
    weight = np.array([1 / shares[int(v)] for v in sample.label])
    return fit_machine([list(x) for x in sample.words], np.stack(sample.stats.map(np.asarray)),
                       sample.label.to_numpy(float), weight)


def score_documents(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            stats = np.array([statistics(t) for t in pdf.text], dtype=float).reshape(len(pdf), len(STATISTICS))
            yield pd.DataFrame({"doc_id": pdf.doc_id, "score": machine.scores([buckets(t) for t in pdf.text], stats)})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return (rows.mapInPandas(run, "doc_id string, score double")
            .select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score_documents(docs, fit(docs, labels))
