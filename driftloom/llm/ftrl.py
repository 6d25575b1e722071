"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits, A-Z lower-cased; a word that is longer than five, six or seven bytes is also read as the stem
of that many. A document's features are indicators of its words, of its pairs of
neighbours and of its pairs with one word between, each hashed to ``2**bits`` coordinates. Every coordinate has its own learning
rate, and L1 keeps all coordinates at zero that earn no weight, so the model is a short list of (coordinate, weight) and is
broadcast: it can't exceed ``2**bits`` entries.

The fit reads at most ``sample`` labelled documents (those of the least hashed ids, a documented bound): they go through one task
in a set order, so the model doesn't depend on partitions. Scoring is one pass over all documents, without a shuffle.

A null text scores as the empty one, by the intercept alone. Repeated rows are scored each. A label that is null is no label; of
repeated labels of a document the greatest counts. Without labels every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm import words

BITS, SAMPLE, STEMS = 18, 16_000, (5, 6, 7)


def features(texts: list[str], bits: int = BITS) -> Iterator[np.ndarray]:
    """The distinct coordinates of each text."""
    scratch = np.zeros(1 << bits, dtype=np.int64)
    shift = np.uint64(64 - bits)
    for part in words.parts(texts):
        value, ends, *stems = words.hash_words(part, words.MARKS, stems=STEMS)
        start = 0
        for end in ends:
            w = value[start:end]
            found = np.concatenate((w, words.chain(w[:-1], w[1:]), words.chain(~w[:-2], w[2:]), *(s[start:end] for s in stems)))
            start = end
            yield words.distinct((found >> shift).astype(np.int64), scratch)


def fit(texts: list[str], labels: np.ndarray, bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0, epochs: int = 3) -> dict[int, float]:
    """FTRL-proximal over the rows in order, ``epochs`` times; weights that are not zero. The intercept has the key -1."""
    return fit_rows(coordinates(texts, bits), labels, bits, alpha, beta, l1, l2, epochs)


def coordinates(texts: list[str], bits: int) -> list[np.ndarray]:
    """The coordinates of each text and the intercept's, which is the last; in four bytes each, as all of a sample are held at once."""
    return [np.append(f.astype(np.int32), np.int32(1 << bits)) for f in features(texts, bits)]


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0, epochs: int = 3) -> dict[int, float]:
    """``fit`` of rows of ``coordinates``."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        # The last coordinate is the intercept, which no penalty touches.
        bound = np.where(at == size, 0.0, l1)
        w = -(zs - np.sign(zs) * bound) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zs) <= bound, 0.0, w)

    for _ in range(epochs):
        for at, label in zip(rows, labels):
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - rate * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    return {(-1 if i == size else int(i)): float(w[i]) for i in np.flatnonzero(w)}


def held_out(doc_id: Column) -> Column:
    """A fixed fourth of all documents, never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int, text: str = "text") -> DataFrame:
    """At most ``sample`` labelled documents outside the held-out fourth, as (doc_id, text, label) in one partition.

    Only ids are ranked; as many as the bound says meet the documents in a broadcast join. Of an id that repeats, the least text is
    kept, before anything reaches the one task. Ids are whole numbers.
    """
    ids = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    found = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label").repartition(1)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, bits: int = BITS, **rates: float) -> dict[int, float]:
    """Fit on the labelled sample in one task; the compact weights come back."""

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Texts become coordinates batch by batch. Ids stand once each and their hash is one-to-one, so the order is theirs alone.
        rows, order, marks = [], [np.zeros(0, np.uint64)], [np.zeros(0)]
        for batch in batches:
            for start in range(0, len(batch), 500):
                rows += coordinates(batch["text"].iloc[start : start + 500].tolist(), bits)
            order.append(words.mix(batch["doc_id"].to_numpy().astype(np.int64).astype(np.uint64)))
            marks.append(batch["label"].to_numpy(dtype=float))
        at = np.argsort(np.concatenate(order), kind="stable")
        model = fit_rows([rows[k] for k in at], np.concatenate(marks)[at], bits, **rates) if rows else {}
        yield pd.DataFrame({"feature": list(model), "weight": list(model.values())}).astype({"feature": "int64", "weight": "float64"})

    return {r.feature: r.weight for r in labelled_sample(docs, labels, label, sample).mapInPandas(learn, "feature long, weight double").collect()}


def score(spark, model: dict[int, float], text: Column, bits: int = BITS) -> Column:
    """The probability of the label, from broadcast weights."""
    shared = spark.sparkContext.broadcast((np.array(list(model), dtype=np.int64), np.array(list(model.values()))))

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        keys, values = shared.value
        dense = np.zeros((1 << bits) + 1)
        dense[keys] = values  # the key -1 is the last place
        bias = dense[-1]
        for batch in batches:
            total = np.array([dense[f].sum() for f in features(batch, bits)]) + bias
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))) if len(keys) else np.zeros(len(batch)))

    return scores(text)


def with_toxicity(docs: DataFrame, labels: DataFrame, column: str = "toxicity", sample: int = SAMPLE) -> DataFrame:
    """Add the toxicity of every document, learnt from the labelled sample."""
    model = train(docs, labels, sample=sample)
    return docs.withColumn(column, score(docs.sparkSession, model, F.col("text")))
