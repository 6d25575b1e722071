import random

import numpy as np
import pytest
from made import labelled

from driftloom.llm import ftrl, nbsvm, words


@pytest.fixture(scope="module")
def split(spark):
    return labelled(spark)


def measured(frame, truth, least):
    rows = [r for r in frame.collect() if r.held]
    assert rows and all(0 <= r.score <= 1 for r in rows)
    return np.mean([(r.score >= least) == truth[r.doc_id] for r in rows])


def test_toxicity(split):
    docs, labels, truth = split
    found = ftrl.with_toxicity(docs, labels, "score").withColumn("held", ftrl.held_out(docs.doc_id))
    assert measured(found, truth, 0.3) >= 0.95


def test_quality(split):
    docs, labels, truth = split
    found = nbsvm.with_quality(docs, labels.withColumnRenamed("toxic", "quality"), "score").withColumn("held", ftrl.held_out(docs.doc_id))
    assert measured(found, truth, 0.7) >= 0.95


def test_held_out_labels_are_not_read(split):
    docs, labels, _ = split
    flipped = labels.withColumn("toxic", (ftrl.held_out(labels.doc_id).cast("int") + labels.toxic) % 2)
    assert ftrl.train(docs, labels) == ftrl.train(docs, flipped)


def test_odd_rows(spark, docs, none, texts):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 0, 1), (None, 1, 1), (3, None, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    for with_score, name in ((ftrl.with_toxicity, "toxicity"), (nbsvm.with_quality, "quality_score")):
        for known in (labels, labels.limit(0)):
            rows = with_score(docs, known).collect()
            assert len(rows) == len(texts) and all(0 <= r[name] <= 1 for r in rows)
        assert with_score(none, labels).count() == 0


def test_the_model_is_sparse_and_ordered(split):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefghij") * 3 for _ in range(20)) + (" awful" if i % 2 else "") for i in range(200)]
    model = ftrl.fit(texts, np.arange(200) % 2, l1=2.0)
    assert len(model) < 400 and max(model.values()) > 0
    assert model == ftrl.fit(texts, np.arange(200) % 2, l1=2.0)


def test_dual_coordinate_descent_separates():
    rows = [np.array([0, 2 + i % 5]) if i % 2 else np.array([1, 2 + i % 5]) for i in range(100)]
    ratio = np.array([2.0, -2.0, 0.1, 0.1, 0.1, 0.1, 0.1])
    w, bias = nbsvm.fit(rows, np.arange(100) % 2, ratio)
    m = nbsvm.margins(rows, w, bias, ratio)
    assert (m[1::2] > 0.9).all() and (m[::2] < -0.9).all()


def test_log_ratios():
    r = nbsvm.log_ratios(np.array([[10.0, 0], [0, 10]]), np.array([10.0, 10]))
    assert r[0] < 0 < r[1] and r[0] == pytest.approx(-r[1])


def test_word_hashes_tell_words_apart():
    value, ends = words.hash_words(["Aa aA\tb", "", "é b"])
    assert ends.tolist() == [3, 3, 5] and value[0] == value[1] and value[2] == value[4] and len(set(value.tolist())) == 3
    many = [f"w{i}" for i in range(50_000)]
    assert len(set(words.hash_words([" ".join(many)])[0].tolist())) == 50_000
    _, _, stem = words.hash_words(["idiot idiots"], stems=(5,))
    assert stem[0] == 0 and stem[1] != 0


def test_rows_of_the_toxicity_fit_take_four_bytes_a_coordinate():
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(200)]
    labels = np.array([float("w1 " in t) for t in texts])
    wide = [np.append(f, 1 << ftrl.BITS) for f in ftrl.features(texts)]
    rows = ftrl.coordinates(texts, ftrl.BITS)
    assert all((a == b).all() for a, b in zip(rows, wide)) and sum(r.nbytes for r in rows) * 2 == sum(r.nbytes for r in wide)
    assert ftrl.fit_rows(rows, labels) == ftrl.fit_rows(wide, labels) == ftrl.fit(texts, labels)
