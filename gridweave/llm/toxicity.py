"""Toxicity scores by non-negative positive-unlabelled learning (operator 8).

Confirmed toxic documents and unlabelled text train a linear classifier in numpy.  With
class prior p, loss l and score g, the risk is p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)]):
the second term is the risk on negatives as the unlabelled text shows it, and where it
falls below zero a step undoes it instead of following it.

Features are words and word beginnings (PREFIXES bytes) by presence, chosen from those that
MIN_DOCS toxic documents have and whose holders, by the prior and the shares in toxic and
unlabelled text (one more unlabelled holder is assumed), are toxic with MIN_PRECISION.  The
count is fixed, whatever the number of toxic documents, so that words of languages with a
small part of them are learned as data grow.  The unlabelled text is a sample of all
training documents, whatever their labels, as the risk asks for; so a confirmed toxic
document may serve on both sides.  Equal texts count once on each side.  Fitting takes at
most about MAX_TOXIC and MAX_UNLABELLED documents, chosen by a hash of the id, whole texts
each, and the MAX_FEATURES most telling features; scoring reads every whole text once.  The
prior is the share of toxic among all labelled training rows.

Defined cases: null and empty texts have no features and score as such; of several labels
of a document the greatest counts; without a toxic training row, or without a feature, every
score is the prior.  Rows without an id have no label and are never fitted on, but scored;
rows of one id have that id's label each, and are in the sample all or none; repeated rows
have equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import cut, strings

MAX_TOXIC = 4000
MAX_UNLABELLED = 12000
MAX_FEATURES = 1 << 16
MIN_DOCS = 4
MIN_PRECISION = 0.6
PREFIXES = (4, 5, 6)
_WORD = bytes(x if x >= 0x80 or 0x61 <= x <= 0x7A else 0x20 for x in range(256))


def words(text: str | None) -> set[bytes]:
    return set(text.lower().encode("utf-8", "surrogatepass").translate(_WORD).split()) if text else set()


def features_of(word: bytes) -> list[bytes]:
    return [b"=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)]


def features(text: str | None) -> set[bytes]:
    return {f for w in words(text) for f in features_of(w)}


class Classifier:
    """Weights by feature; score() is the probability of the positive class."""

    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias = weights, bias
        self._by_word: dict[bytes, tuple[bytes, ...]] = {}

    def __getstate__(self):
        return self.weights, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def score(self, text: str | None) -> float:
        found: set[bytes] = set()
        memo = self._by_word
        for word in words(text):
            known = memo.get(word)
            if known is None:
                if len(memo) >= 1 << 18:
                    memo.clear()
                known = memo[word] = tuple(f for f in features_of(word) if f in self.weights)
            if known:
                found.update(known)
        return float(1 / (1 + np.exp(-(self.bias + sum(self.weights[f] for f in sorted(found))))))


def fit(rows: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float, steps: int = 800, rate: float = 0.1, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Non-negative PU risk minimised by Adam.  rows: the feature numbers of each document;
    positive: whether it is a confirmed positive (else unlabelled)."""
    index = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate(rows) if rows else np.empty(0, np.int64)
    w, b = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    weight = np.where(positive, 1 / max(1, positive.sum()), 1 / max(1, (~positive).sum()))
    first, second = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, steps + 1):
        g = b + np.bincount(index, w[column], len(rows))
        up = 1 / (1 + np.exp(-g))  # derivative of l(-g) = log(1 + e^g)
        loss = np.logaddexp(0, g)
        negative = (weight * loss)[~positive].sum() - prior * (weight * loss)[positive].sum()
        if negative >= 0:
            d = np.where(positive, prior * weight * (up - 1) - prior * weight * up, weight * up)
        else:
            d = np.where(positive, prior * weight * up, -weight * up)
        grad = np.append(np.bincount(column, d[index], n_features) + l2 * w, d.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        step = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and how many unlabelled documents of a batch each feature occurs."""
    for batch in batches:
        found: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for text, positive in zip(batch.column("text").to_pylist(), batch.column("positive").to_pylist(), strict=True):
            found[positive].update(features(text))
        if keys := list(found[True].keys() | found[False].keys()):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array([found[x][k] for k in keys], pa.int64()) for x in (True, False))], ["feature", "toxic", "other"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_unlabelled: int = MAX_UNLABELLED) -> Classifier:
    """Fit from the documents given.  labels: rows (id, 0 or 1) for some of them; only the
    toxic ones serve as examples, all documents as the unlabelled text."""
    spark = docs.sparkSession
    marks = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    marked = docs.select(F.col(f"`{id_col}`").alias("doc_id")).distinct().join(marks, "doc_id", "left")
    n_toxic, n_clean, n_all = marked.agg(*(F.count_if(F.expr(x)) for x in ("label = 1", "label = 0")), F.count("*")).first()
    prior = min(0.99, max(0.001, n_toxic / max(1, n_toxic + n_clean)))
    bias = float(np.log(prior / (1 - prior)))
    if not n_toxic:
        return Classifier({}, bias)
    chance = lambda what: F.pmod(F.xxhash64("doc_id", F.lit(what)), F.lit(1 << 20)) / float(1 << 20)
    toxic = marked.where((F.col("label") == 1) & (chance("toxicity") < max_toxic / n_toxic)).select("doc_id", F.lit(True).alias("positive"))
    free = marked.where(chance("unlabelled") < max_unlabelled / n_all).select("doc_id", F.lit(False).alias("positive"))
    ids = toxic.union(free)
    text = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    # The sample's size is bounded by max_toxic and max_unlabelled, so its ids can be broadcast.
    sample = cut(text.join(F.broadcast(ids), "doc_id").select("text", "positive").distinct())
    sizes = {r.positive: r["count"] for r in sample.groupBy("positive").count().collect()}
    p, u = sizes.get(True, 0), sizes.get(False, 0)
    if not p or not u:
        return Classifier({}, bias)
    counted = sample.mapInArrow(_counts, "feature binary, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    precision = prior * (F.col("toxic") / p) / ((F.col("other") + 1) / u)
    picked = counted.where((F.col("toxic") >= MIN_DOCS) & (precision >= MIN_PRECISION)).orderBy(F.desc(F.col("toxic") * precision), "feature").limit(MAX_FEATURES).select("feature").collect()
    number = {bytes(r.feature): i for i, r in enumerate(picked)}
    if not number:
        return Classifier({}, bias)
    shared = spark.sparkContext.broadcast(number)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows = [sorted(known[f] for f in features(t) if f in known) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), batch.column("positive")], ["features", "positive"])

    found = sample.mapInArrow(rows_of, "features array<int>, positive boolean").toArrow()
    rows = [np.array(r, np.int64) for r in found["features"].to_pylist()]
    w, b = fit(rows, np.array(found["positive"].to_pylist(), bool), len(number), prior)
    return Classifier({f: float(w[i]) for f, i in number.items()}, b)


def score(model: Classifier, text: Column | str, spark) -> Column:
    """The probability of toxicity of a text column."""
    shared = spark.sparkContext.broadcast(model)

    def scored(texts: pa.Array) -> pa.Array:
        return pa.array((shared.value.score(x) for x in strings(texts)), pa.float64())

    return F.arrow_udf(scored, "double")(text)
