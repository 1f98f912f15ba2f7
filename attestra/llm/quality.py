"""Quality scores learnt from trusted positives and unlabelled text (non-negative unbiased PU risk)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.rows import only, text_bytes
from attestra.session import cut_lineage

#: Most rows that a model is fitted on, of each kind; they are those with the smallest hash of the id.
MAX_POSITIVES = 20_000
MAX_UNLABELLED = 20_000
#: Added to the counts of both labels when the class prior is estimated.
SMOOTHING = 1.0
STEPS, RATE, HIDDEN, DECAY, BATCH = 1500, 0.01, 16, 1e-4, 2048
THRESHOLD = 0.3
BYTES = np.arange(256)
ASCII_SYMBOLS = [b for b in range(33, 127) if not chr(b).isalnum()]
N_FEATURES = len(ASCII_SYMBOLS) + 19


def features_of(text: bytes) -> np.ndarray:
    """Counts and shares of a whole text, the same for any language; an empty text has zeros."""
    out = np.zeros(N_FEATURES, np.float32)
    words = text.split()
    if not words:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    spaces = counts[32] + counts[9:14].sum()
    solid = max(len(text) - spaces, 1)
    n = len(words)
    tally = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    k = len(ASCII_SYMBOLS)
    out[:k] = np.minimum(counts[ASCII_SYMBOLS] / n, 2.0)
    out[k:] = (
        np.log1p(n), upper / solid, lower / solid, digits / solid, counts[128:].sum() / solid,
        upper / max(upper + lower, 1), spaces / len(text), counts[ASCII_SYMBOLS].sum() / solid,
        lengths.mean() / 10, min(lengths.std() / 10, 5), min(lengths.max() / 100, 5), len(tally) / n,
        max(tally.values()) / n, repeated / n, np.log1p(len(lines)), len(set(lines)) / len(lines),
        np.log1p(n / len(lines)), (lengths == 1).mean(), np.log1p(n) * repeated / n,
    )
    return out


@F.pandas_udf(T.BinaryType())
def _features(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield pd.Series([features_of(t).tobytes() for t in part])


@dataclass
class Model:
    """Standardised features, one hidden layer, one logit."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(((x - self.mean) / self.scale) @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -50, 50)))


def constant(score: float) -> Model:
    """A model that gives every text the same score."""
    logit = np.log(score / (1 - score))
    return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), [np.zeros((N_FEATURES, 1)), np.zeros(1), np.zeros(1), np.array([logit])])


def pu_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Non-negative PU risk of logits under the logistic loss, and what to descend along.

    Risk: prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)). Where the second part falls
    below zero, the step goes up its slope instead, which takes the over-fit back.
    """
    sp, su = 1 / (1 + np.exp(-positive)), 1 / (1 + np.exp(-unlabelled))
    plus = np.logaddexp(0, -positive).mean()
    negative = np.logaddexp(0, unlabelled).mean() - prior * np.logaddexp(0, positive).mean()
    slope_negative_p, slope_negative_u = -prior * sp / len(sp), su / len(su)
    if negative >= 0:
        return prior * plus + negative, prior * (sp - 1) / len(sp) + slope_negative_p, slope_negative_u
    return prior * plus, -slope_negative_p, -slope_negative_u


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimise the risk by Adam on mini-batches, in a fixed random order."""
    rng = np.random.default_rng(0)
    both = np.vstack([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(axis=0), np.maximum(both.std(axis=0), 1e-3)
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    weights = [rng.normal(0, p.shape[1] ** -0.5, (p.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, STEPS + 1):
        x = np.vstack([p[rng.integers(0, len(p), min(BATCH, len(p)))], u[rng.integers(0, len(u), min(BATCH, len(u)))]])
        at = min(BATCH, len(p))
        w1, b1, w2, b2 = weights
        hidden = np.tanh(x @ w1 + b1)
        logit = hidden @ w2 + b2
        _, slope_p, slope_u = pu_risk(logit[:at], logit[at:], prior)
        slope = np.concatenate([slope_p, slope_u])
        back = slope[:, None] * w2 * (1 - hidden**2)
        grads = [x.T @ back + DECAY * w1, back.sum(axis=0), hidden.T @ slope + DECAY * w2, np.array([slope.sum()])]
        rate = RATE * (1 - step / (STEPS + 1))
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            weights[i] = weights[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, weights)


def held_out(id_column: Column, folds: int = 5) -> Column:
    """Whether the CRC-32 of the id as text leaves no remainder; a row without an id is held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == 0, F.lit(True))


def class_prior(trusted: DataFrame) -> float:
    """Share of good documents among the labelled training rows, over all of them."""
    good, bad = trusted.agg(F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)).collect()[0]
    return (good + SMOOTHING) / (good + bad + 2 * SMOOTHING)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", *, prior: float | None = None) -> Model:
    """Fit on documents that are not held out; ``labels`` has the id and ``quality``.

    Trusted positives are those labelled 1; unlabelled text is any of them, labels unseen. Labels 0 only
    enter the class prior, which is estimated over all training labels unless it is given. A document
    labelled both ways is not trusted; null labels, null ids, labels of absent documents and ids that several
    rows carry are left out of the fit. At most MAX_POSITIVES and MAX_UNLABELLED documents are used, those with
    the smallest hash of the id; only their ids and N_FEATURES numbers each reach the driver. Without
    positives or text the model gives every text the prior.
    """
    rows = only(docs, id_column, text).toDF("id", "_text")
    marks = only(labels, id_column, "quality").toDF("id", "quality").filter("id IS NOT NULL AND quality IS NOT NULL")
    trusted = cut_lineage(marks.groupBy("id").agg(F.min("quality").alias("quality")).filter(~held_out(F.col("id"))))
    prior = class_prior(trusted) if prior is None else prior
    ids = rows.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 1)
    ids = cut_lineage(ids.select("id").filter(~held_out(F.col("id"))))
    order = [F.xxhash64("id"), F.col("id")]
    positive = ids.join(trusted.filter("quality = 1"), "id", "left_semi").orderBy(*order).limit(MAX_POSITIVES)
    unlabelled = ids.orderBy(*order).limit(MAX_UNLABELLED)
    sample = (
        positive.withColumn("p", F.lit(1)).withColumn("u", F.lit(0))
        .unionByName(unlabelled.withColumn("p", F.lit(0)).withColumn("u", F.lit(1)))
        .groupBy("id").agg(F.max("p").alias("p"), F.max("u").alias("u"))
    )
    # The sample's size is bounded above, so it may be broadcast; the texts stay where they are.
    got = rows.join(F.broadcast(sample), "id").select("id", "p", "u", _features(text_bytes("_text")).alias("features")).toPandas()
    got = got.sort_values("id")
    x = np.frombuffer(b"".join(map(bytes, got["features"])), np.float32).reshape(-1, N_FEATURES).astype(np.float64)
    p, u = x[got["p"].to_numpy() == 1], x[got["u"].to_numpy() == 1]
    return fit(p, u, prior) if len(p) and len(u) else constant(prior)


def score_column(model: Model, text: str = "text") -> Column:
    """The model's score of a whole text, between 0 and 1; null counts as empty."""

    @F.pandas_udf(T.DoubleType())
    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            x = np.array([features_of(t) for t in part], np.float64).reshape(-1, N_FEATURES)
            yield pd.Series(model.scores(x))

    return scores(text_bytes(f"`{text}`"))


def score(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", *, prior: float | None = None) -> DataFrame:
    """``(id, held_out, score, predicted)`` per row of ``docs``, by the model of ``train``.

    The model sees the text and nothing else. Every row is scored where it lies, repeated rows, empty and
    null texts too; there is no shuffle of texts.
    """
    model = train(docs, labels, id_column, text, prior=prior)
    rows = only(docs, id_column, text).toDF("id", "_text")
    scored = rows.select("id", held_out(F.col("id")).alias("held_out"), score_column(model, "_text").alias("score"))
    return scored.select(
        F.col("id").alias(id_column), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose text scores THRESHOLD or more, with all their columns."""
    return docs.filter(score_column(train(docs, labels, id_column, text), text) >= THRESHOLD)
