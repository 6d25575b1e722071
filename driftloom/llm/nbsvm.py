"""Quality scores: naive Bayes support vectors.

Features are indicators of a text's word n-grams (one and two words, A-Z lower-cased) and of the same with every letter, digit and
other character written as its class, which sees how words are shaped and where marks repeat; each is hashed to ``2**bits``
coordinates. Every coordinate has a class log-count ratio, the log of its smoothed share in texts of label 1 over that in label 0;
Spark counts it over *all* labelled rows outside the held-out fourth. Indicators scaled by the ratios feed a linear hinge-loss model,
fitted by dual coordinate descent on at most ``sample`` labelled rows (a documented bound) in one task, in a set order. A logistic
curve through the sample's margins turns a margin into a probability.

The weights are one value per coordinate, so the model is broadcast: it has at most ``2**bits`` of them. Scoring is one pass, no
shuffle.

A null text scores as the empty one, by the intercept alone. Repeated rows are scored each. A label that is null is no label; of
repeated labels of a document the greatest counts. With labels of one kind only, every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm import words
from driftloom.llm.ftrl import held_out, labelled_sample
from driftloom.llm.meeting import meet

BITS, SAMPLE = 17, 12_000

#: A byte's class: a small letter, a capital, a digit, one letter of another alphabet; every mark stands for itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[128:] = ord("a")


def features(texts: Iterator[str | None], bits: int = BITS) -> Iterator[np.ndarray]:
    """The distinct coordinates of each text."""
    scratch = np.zeros(1 << bits, dtype=np.int64)
    shift = np.uint64(64 - bits)
    for part in words.parts(texts):
        value, ends = words.hash_words(part)
        shape = words.word_shapes(part, _SHAPE)
        start = 0
        for end in ends:
            w, s = value[start:end], shape[start:end]
            start = end
            repeat = words.mix(np.uint64(7) + (w[1:] == w[:-1]).astype(np.uint64))
            found = np.concatenate((w, words.chain(w[:-1], w[1:]), s, words.chain(s[:-1], s[1:]), words.chain(s[:-2], words.chain(s[1:-1], s[2:])), repeat))
            yield words.distinct((found >> shift).astype(np.int64), scratch)


def counts(docs: DataFrame, labels: DataFrame, label: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """How many labelled texts have each coordinate: [label, coordinate], and how many texts there are of each label.

    Each task gives a row per label and coordinate at most, however many texts it reads.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("label"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, (1 << bits) + 1), dtype=np.int64)  # the last place counts texts
        for batch in batches:
            for kind, at in zip(batch.column("label").to_pylist(), features(batch.column("text").to_pylist(), bits)):
                total[kind, at] += 1
                total[kind, -1] += 1
        kind, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(at), pa.array(total[kind, at])], ["label", "feature", "n"])

    rows = meet(docs.select("doc_id", "text"), known, "doc_id").select("text", "label").mapInArrow(add, "label long, feature long, n long")
    summed = rows.groupBy("label", "feature").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((2, (1 << bits) + 1))
    total[summed["label"], summed["feature"]] = summed["n"]
    return total[:, :-1], total[:, -1]


def log_ratios(total: np.ndarray, texts: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Class log-count ratios: positive where a coordinate is commoner in texts of label 1."""
    share = (total + smooth) / (texts[:, None] + 2 * smooth)
    return np.log(share[1]) - np.log(share[0])


def fit(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, c: float = 1.0, epochs: int = 12) -> tuple[np.ndarray, float]:
    """Hinge loss by dual coordinate descent over texts as sets of coordinates; weights on indicators, and the intercept.

    Texts have length 1 after scaling, the intercept is a coordinate of its own. Both labels weigh the same in total.
    """
    y = np.where(labels > 0, 1.0, -1.0)
    upper = c * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))  # the box of each dual value
    scaled = [ratio[at] for at in rows]
    norm = np.array([max(1e-9, float(v @ v)) for v in scaled])
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(y))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            at, v = rows[i], scaled[i] / np.sqrt(norm[i])
            gradient = y[i] * (w[at] @ v + bias) - 1.0
            new = min(max(alpha[i] - gradient / 2.0, 0.0), upper[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * v
                bias += step
                alpha[i] = new
    return w * ratio, bias


def margins(rows: Iterator[np.ndarray], w: np.ndarray, bias: float, ratio: np.ndarray) -> np.ndarray:
    square = ratio * ratio
    return np.array([w[at].sum() / np.sqrt(max(1e-9, square[at].sum())) + bias for at in rows])


def curve(margin: np.ndarray, labels: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Platt's logistic curve through the margins, by Newton steps."""
    n1, n0 = (labels > 0).sum(), (labels <= 0).sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        d, h = p - target, p * (1 - p) + 1e-9
        g = np.array([(d * margin).sum() + 1e-6 * a, d.sum()])
        m = np.array([[(h * margin * margin).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float, float, float] | None:
    """Weights, ratios, intercept and curve; None if the labels are of one kind."""
    total, texts = counts(docs, labels, label, bits)
    if not texts.all():
        return None
    ratio = log_ratios(total, texts)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"doc_id": [], "text": [], "label": []}), *batches])
        order = words.mix(rows["doc_id"].to_numpy().astype(np.int64).astype(np.uint64))
        rows = rows.assign(order=order).sort_values(["order", "text"], kind="stable")
        known, found = (rows["label"].to_numpy(dtype=float) > 0).astype(float), list(features(rows["text"], bits))
        r = shared.value
        # The curve is drawn through margins of rows that the weights have not seen.
        fold = np.arange(len(found)) % 4 == 3
        part = [x for x, f in zip(found, fold) if not f]
        a, b = 0.0, 0.0
        if len(set(known[~fold])) == 2 and len(set(known[fold])) == 2:
            w, bias = fit(part, known[~fold], r)
            a, b = curve(margins([x for x, f in zip(found, fold) if f], w, bias, r), known[fold])
        w, bias = fit(found, known, r) if len(set(known)) == 2 else (np.zeros(len(r)), 0.0)
        at = np.flatnonzero(w)
        yield pd.DataFrame({"feature": [-1, -2, -3, *at], "weight": [bias, a, b, *w[at]]}).astype({"feature": "int64", "weight": "float64"})

    rows = labelled_sample(docs, labels, label, sample).mapInPandas(learn, "feature long, weight double").toPandas()
    model = dict(zip(rows["feature"], rows["weight"]))
    bias, a, b = (model.pop(k) for k in (-1, -2, -3))
    w = np.zeros(1 << bits)
    w[list(model)] = list(model.values())
    return w, ratio, bias, a, b


def with_quality(docs: DataFrame, labels: DataFrame, column: str = "quality_score", sample: int = SAMPLE, bits: int = BITS) -> DataFrame:
    """Add the probability of label 1 for every document."""
    model = train(docs, labels, sample=sample, bits=bits)
    return docs.withColumn(column, score(docs.sparkSession, model, F.col("text"), bits) if model else F.lit(0.5))


def score(spark, model, text: Column, bits: int = BITS) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, ratio, bias, a, b = shared.value
        for batch in batches:
            yield pd.Series(1 / (1 + np.exp(-np.clip(a * margins(features(batch, bits), w, bias, ratio) + b, -35, 35))))

    return scores(text)
