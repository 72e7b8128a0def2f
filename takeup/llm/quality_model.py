"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Texts become sparse vectors: words and runs of symbols, and pairs of neighbours, hashed into
``2 ** bits`` places, with log-scaled counts of unit length. Training reads the labelled rows that
are not held out, at most ``sample`` of them (those with the smallest hashed ids; a
documented bound, not a cut of the corpus) with one document each (of several under one id, that with the smallest hash), in one task that keeps a vector per row and
runs FTRL-proximal updates in a fixed order, so reruns agree. The model has at most
``2 ** bits`` weights. Every document is scored as a sparse dot product.

Null and empty texts score the bias alone. A null id counts as not held out; null labels and labels
without a document are ignored; a repeated label counts once, an id with two labels has a row for each. Ids, labels,
language and source are no inputs of a score. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from takeup.llm.common import bounded_batches, stage

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_CACHE_WORDS = 500_000
_hashed: dict[str, int] = {}


def features(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's vector."""
    found = _TOKEN.findall(text or "")
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0)
    if len(_hashed) > _CACHE_WORDS:
        _hashed.clear()
    numbers = np.empty(len(found), dtype=np.uint64)
    for i, w in enumerate(found):
        h = _hashed.get(w)
        if h is None:
            h = _hashed[w] = crc32(w.encode())
        numbers[i] = h
    pairs = numbers[:-1] * np.uint64(0x9E3779B97F4A7C15) + numbers[1:]
    places = np.concatenate([numbers * np.uint64(0xC2B2AE3D27D4EB4F), pairs * np.uint64(0xD6E8FEB86659FD93)])
    places, counts = np.unique((places >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
    values = 1 + np.log(counts)
    return places, values / np.sqrt(values @ values)


class FollowTheLeader:
    """FTRL-proximal for the logistic loss; the last coordinate is the bias."""

    def __init__(self, bits: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(2 ** bits + 1), np.zeros(2 ** bits + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        at, x = np.append(places, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def remainder(id_column: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, bits: int = 18,
          sample: int = 20_000, epochs: int = 3) -> np.ndarray:
    """Weights of the model, the bias last."""
    known = labels.select(F.col(id_column).alias("_id"), F.col(label_column).cast("int").alias("_label")).where(
        f"_label is not null and _id is not null")
    known = known.where(remainder("_id") != 2)
    order = F.xxhash64("_id").alias("_order")
    chosen = stage(known.select("_id", "_label", order).orderBy("_order", "_id", "_label").limit(sample), "labelled")
    # at most ``sample`` rows of three numbers
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).join(F.broadcast(chosen), "_id")

    @F.pandas_udf("places array<long>, values array<double>")
    def vector(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([features(t, bits) for t in texts], columns=["places", "values"])

    # one document per labelled row, chosen before rows meet: the training task holds at most ``sample`` vectors
    vectors = rows.select("_order", "_id", "_label", vector("_text").alias("v")).groupBy("_order", "_id", "_label").agg(
        F.min_by("v", F.xxhash64("v.places")).alias("v"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = [(p.astype(np.int32), x.astype(np.float32), y) for batch in batches
                for p, x, y in zip(batch["places"], batch["values"], batch["_label"])]
        model = FollowTheLeader(bits)
        for _ in range(epochs):
            for p, x, y in kept:
                model.learn(p, x, y)
        weights = model.weights(slice(None))
        places = np.flatnonzero(weights)
        yield pd.DataFrame({"place": places, "weight": weights[places]})

    ordered = vectors.orderBy("_order", "_id", "_label", F.xxhash64("v.places")).select("_label", "v.*").coalesce(1)
    model = stage(ordered.mapInPandas(fit, "place long, weight double"), "quality_model").toPandas()
    weights = np.zeros(2 ** bits + 1)
    weights[model["place"].to_numpy(dtype=np.int64)] = model["weight"].to_numpy()
    return weights


def scorer(spark, weights: np.ndarray, bits: int):
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))  # 2 ** bits + 1 numbers

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        w = shared.value
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            places, values = features(t, bits)
            out[i] = w[-1] + w[places] @ values
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return score


def score_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  label_column: str = "quality", threshold: float = 0.7, bits: int = 18, sample: int = 20_000,
                  epochs: int = 3) -> DataFrame:
    """id, held_out, score and predicted of every document."""
    bounded_batches(docs.sparkSession)
    weights = train(docs, labels, id_column, text_column, label_column, bits, sample, epochs)
    score = scorer(docs.sparkSession, weights, bits)
    rows = docs.select(id_column, (remainder(id_column) == 2).alias("held_out"), score(F.col(text_column)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
