"""Toxicity by a weighted finite-state pattern grammar.

A clause is read as a string of word classes: insult, threat, target, negation,
reported speech, other. Three small transducers rewrite it one after the other:
*negation* turns a hit within its scope into a negated one, *reported speech*
turns hits after a reporting word into reported ones, *target* binds hits to a
person named in the same clause. They are composed into one deterministic
machine, and its output symbols carry the weights. So "you are an idiot", "not
an idiot" and "she said idiot" are three different matches, and a document's
score is a weighted sum over its matched clauses, never over isolated words.

What is learned from labelled rows, at most ``MAX_POSITIVE`` + ``MAX_NEGATIVE``
of them, only those not held out: the insult lexicon (words and word beginnings
with their log-odds) and the weights of the output symbols. Threat, target,
negation and reporting words are fixed lists. Candidates for the lexicon count
by distinct preceding words, so a text copied a thousand times does not make its
words insults. Scoring runs over Arrow batches where the texts lie; the model is
a few thousand patterns and a dozen weights.

Null and empty texts match nothing and get the score of a text without matches.
Without any labelled toxic row every score is the smoothed share of toxic rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corefkit.llm.common import documents, held_out, labelled_sample, staged

#: Bounds of the labelled sample that the model is fitted on.
MAX_POSITIVE, MAX_NEGATIVE = 3_000, 6_000
#: The least evidence for a word of the lexicon.
MIN_DOCS, MIN_CONTEXTS, MIN_G2 = 3, 3, 12.0
PREFIXES = (3, 4, 5, 6)
CACHE_WORDS = 500_000

THREATS = frozenset("kill hurt beat destroy punish attack stab shoot burn töte töten schlage umbringen tuer frapper "
                    "matar golpear mataré".split())
TARGETS = frozenset("you your yours he she they them him her people du dich dir ihr sie er euch tu te toi vous il elle "
                    "ils elles tú usted ustedes él ella ellos ellas".split())
NEGATIONS = frozenset("not no never none isn't aren't nicht kein keine nie ne pas jamais aucun nunca ningún".split())
REPORTS = frozenset("said says told called wrote quoted claims sagte sagt schrieb nannte dit disait écrit appelé dijo "
                    "dice escribió llamó".split())

TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]")
CLAUSE_END = frozenset(".!?;:\n")

# Input symbols: I insult, H threat, T target, N negation, R reporting word, O other, . end of a clause.
# Output symbols: I H plain, J K bound to a target before, B a target that binds the hit before it, i h negated, q reported.
KINDS = "IHJKBihq"
#: Those that make a clause an attack; what is negated or reported counts by its own weight only.
ATTACKS = frozenset("IHJKB")


@dataclass
class Transducer:
    """Deterministic: ``step(state, symbol) -> (next state, output symbol)``; unknown arcs copy the symbol and stay."""

    start: int
    arcs: dict[tuple[int, str], tuple[int, str]] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs.get((state, symbol), (state, symbol))


def negation(scope: int = 3) -> Transducer:
    arcs: dict[tuple[int, str], tuple[int, str]] = {}
    for left in range(scope + 1):
        after = max(0, left - 1)
        arcs |= {(left, s): (after, s) for s in "OTR"} | {(left, "N"): (scope, "O"), (left, "."): (0, ".")}
        arcs |= {(left, "I"): (after, "i" if left else "I"), (left, "H"): (after, "h" if left else "H")}
    return Transducer(0, arcs)


def reported() -> Transducer:
    arcs = {(0, "R"): (1, "O"), (1, "R"): (1, "O"), (1, "."): (0, ".")}
    arcs |= {(1, s): (1, "q") for s in "IHih"}
    return Transducer(0, arcs)


def target() -> Transducer:
    arcs = {(0, "T"): (1, "O"), (1, "T"): (1, "O"), (2, "T"): (1, "B"), (1, "."): (0, "."), (2, "."): (0, ".")}
    arcs |= {(0, "I"): (2, "I"), (0, "H"): (2, "H"), (1, "I"): (1, "J"), (1, "H"): (1, "K")}
    return Transducer(0, arcs)


def compose(first: Transducer, second: Transducer, symbols: str = "IHTNRO.ihqJKB") -> Transducer:
    """The machine that feeds the output of ``first`` to ``second``; only reachable states."""
    number = {(first.start, second.start): 0}
    todo, arcs = [(first.start, second.start)], {}
    while todo:
        state = todo.pop()
        for s in symbols:
            a, between = first.step(state[0], s)
            b, out = second.step(state[1], between)
            if (a, b) not in number:
                number[a, b] = len(number)
                todo.append((a, b))
            arcs[number[state], s] = (number[a, b], out)
    return Transducer(0, arcs)


def grammar() -> Transducer:
    return compose(compose(negation(), reported()), target())


class Matcher:
    """Runs the grammar over a text with a lexicon of words ("word") and beginnings ("wor*")."""

    def __init__(self, lexicon: dict[str, float]):
        self.words = {p: w for p, w in lexicon.items() if not p.endswith("*")}
        self.starts = {p[:-1]: w for p, w in lexicon.items() if p.endswith("*")}
        self.machine = grammar()
        self.cache: dict[str, float] = {}

    def weight(self, word: str) -> float:
        """The weight of the strongest pattern that fits a word."""
        found = self.cache.get(word)
        if found is None:
            found = max([self.words.get(word, 0.0), *(self.starts.get(word[:k], 0.0) for k in PREFIXES if len(word) > k)])
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = found
        return found

    def features(self, text: str) -> list[float]:
        """Per output symbol the weight matched in all clauses, and the attacks of the strongest clause."""
        low = text.lower()
        weight = self.weight
        hits = {w for w in set(TOKEN.findall(low)) if w in THREATS or weight(w) > 0}
        if not hits:
            return [0.0] * (len(KINDS) + 1)
        total, clause, best = dict.fromkeys(KINDS, 0.0), 0.0, 0.0
        state, step, last = 0, self.machine.step, 0.0
        for match in TOKEN.finditer(low):
            word = match[0]
            if word in hits:
                symbol, last = ("H", 1.0) if word in THREATS else ("I", weight(word))
            elif word in CLAUSE_END:
                symbol = "."
                best, clause = max(best, clause), 0.0
            else:
                symbol = ("T" if word in TARGETS else "N" if word in NEGATIONS else "R" if word in REPORTS else "O")
            state, out = step(state, symbol)
            if out in total:
                total[out] += last
                if out in ATTACKS:
                    clause += last
        return [math.log1p(total[k]) for k in KINDS] + [math.log1p(max(best, clause))]


@dataclass
class Model:
    lexicon: dict[str, float]
    weights: np.ndarray  # of the features, and last the bias

    def score(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _patterns(text: str) -> set[str]:
    out = set()
    for w in {x for x in TOKEN.findall(text.lower()) if x not in CLAUSE_END}:
        out.add(w)
        out.update(w[:k] + "*" for k in PREFIXES if len(w) > k)
    return out


def _count_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        seen = {0: Counter(), 1: Counter()}
        for text, label in zip(pdf.text, pdf.label):
            seen[int(label)].update(_patterns(text))
        keys = sorted(seen[0].keys() | seen[1].keys())
        yield pd.DataFrame({"pattern": keys, "pos": [seen[1][k] for k in keys], "neg": [seen[0][k] for k in keys]})


def _g2(pos, neg, n_pos, n_neg) -> np.ndarray:
    """Log-likelihood ratio of 'toxic and not toxic differ in the share of documents with the pattern'."""
    def part(x, n, p):
        return x * np.log(np.maximum(x, 1e-9) / (n * p)) + (n - x) * np.log(np.maximum(n - x, 1e-9) / (n * (1 - p)))

    p = np.clip((pos + neg) / (n_pos + n_neg), 1e-9, 1 - 1e-9)
    return 2 * (part(pos, n_pos, p) + part(neg, n_neg, p))


def _log_odds(pos, neg, n_pos, n_neg) -> np.ndarray:
    return np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))


def learn_lexicon(rows: DataFrame, n_pos: int, n_neg: int) -> dict[str, float]:
    """Words and beginnings that mark toxic rows, with their log-odds. ``rows``: text, label."""
    counts = (rows.mapInPandas(_count_documents, "pattern string, pos long, neg long")
              .groupBy("pattern").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
              .where((F.col("pos") >= MIN_DOCS) & (F.col("pos") * n_neg > F.col("neg") * n_pos * 3))
              .orderBy("pattern").toPandas())  # patterns of the bounded sample, each in MIN_DOCS toxic rows at least
    if counts.empty:
        return {}
    candidates = frozenset(counts.pattern)

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = set()
            for text, label in zip(pdf.text, pdf.label):
                before = ""
                for w in TOKEN.findall(text.lower()):
                    for p in (w, *(w[:k] + "*" for k in PREFIXES if len(w) > k)):
                        if p in candidates:
                            out.add((p, int(label), xxhash.xxh32_intdigest(before)))
                    before = w
            yield pd.DataFrame(sorted(out), columns=["pattern", "label", "before"])

    seen = (rows.mapInPandas(contexts, "pattern string, label int, before long").distinct()
            .groupBy("pattern").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")).toPandas())
    found = counts.merge(seen, on="pattern", suffixes=("", "_ctx"))
    # A pattern counts for as many documents as it has different surroundings there, at most.
    pos, neg = np.minimum(found.pos, found.pos_ctx).to_numpy(float), found.neg.to_numpy(float)
    keep = (found.pos_ctx >= MIN_CONTEXTS) & (_g2(pos, neg, n_pos, n_neg) >= MIN_G2) & (pos * n_neg > 3 * neg * n_pos)
    odds = _log_odds(pos, neg, n_pos, n_neg)
    return {p: float(w) for p, w, k in zip(found.pattern, odds, keep) if k}


def _feature_batches(lexicon: dict[str, float]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(lexicon)
        for pdf in batches:
            yield pd.DataFrame({"label": pdf.label, "x": [matcher.features(t) for t in pdf.text]})

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 0.1, rounds: int = 200) -> np.ndarray:
    """Weighted logistic regression by Newton's method; the bias comes last and is not penalised.

    A full step can overshoot where nearly all rows are told apart, and then bounces for good; each step is
    therefore halved until the penalised loss falls, so the loss never rises and its minimum is reached.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, l2), 1e-6]

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(weight @ (np.logaddexp(0, z) - y * z) + penalty @ (w * w) / 2)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        g = x.T @ (weight * (p - y)) + penalty * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        move = np.linalg.solve(h, g)
        fall, share = float(g @ move), 1.0
        if fall < 1e-14 * (1 + now):
            break
        while (then := loss(w - share * move)) > now - 1e-4 * share * fall and share > 1e-9:
            share /= 2
        if then >= now:
            break
        w, now = w - share * move, then
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Learn the lexicon and the weights from the rows that are not held out."""
    rows, shares = labelled_sample(docs, labels, label, {1: MAX_POSITIVE, 0: MAX_NEGATIVE})
    rows = staged(rows, "toxic_sample")
    have = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}
    n_pos, n_neg = have.get(1, 0), have.get(0, 0)
    lexicon = learn_lexicon(rows, n_pos, n_neg) if n_pos and n_neg else {}
    size = len(KINDS) + 1
    if not lexicon:
        return Model({}, np.r_[np.zeros(size), math.log((n_pos + 0.5) / (n_neg + 0.5)) if n_neg else 0.0])
    sample = rows.select("text", "label").mapInPandas(_feature_batches(lexicon), "label int, x array<double>").toPandas()
    x, y = np.stack(sample.x.map(np.asarray)), sample.label.to_numpy(float)
    return Model(lexicon, fit_logistic(x, y, np.array([1 / shares[int(v)] for v in y])))


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(model.lexicon)
        for pdf in batches:
            x = np.array([matcher.features(t) for t in pdf.text], dtype=float).reshape(len(pdf), -1)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "score": model.score(x) if len(pdf) else []})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return (rows.mapInPandas(run, "doc_id string, score double")
            .select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(model.lexicon)
        for texts in parts:
            x = np.array([matcher.features(t) for t in texts], dtype=float).reshape(len(texts), len(KINDS) + 1)
            yield pd.Series(model.score(x))

    return docs.where(score(F.coalesce("text", F.lit(""))) < threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score_documents(docs, fit(docs, labels))
