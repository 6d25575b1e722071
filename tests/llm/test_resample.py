import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftloom.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def features(text, sizes=(1, 2, 3)):
    w = words(text)
    return [" ".join(w[i : i + k]).encode() for k in sizes for i in range(len(w) - k + 1)]


def plain(docs, target):
    """Weight, score and rank of (doc_id, text) rows, one by one."""
    s, t = (Counter(zlib.crc32(f) % 10_000 for x in own for f in features(x)) for own in ([x for _, x in docs], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    rows = []
    for i, x in docs:
        own = features(x)
        weight = sum(gain(zlib.crc32(f) % 10_000) for f in own)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(own), weight, score, len(words(x))])
    able = sorted((r for r in rows if r[0] is not None and r[4] >= 20), key=lambda r: (-r[3], r[0], r[1]))
    rank = {id(r): n + 1 for n, r in enumerate(able[: 5 * len(able) // 100])}
    return Counter((i, n, weight, score, rank.get(id(r))) for r in rows for i, n, weight, score, _ in [r])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.sampled_from(["a b a b a", "x" * 70_000 + " y", "Ab\x00c\x7fD  e", "é日 本z"])), max_size=6))
def test_crcs_of_runs(texts):
    found = list(resample.runs(pa.array(texts, pa.string())))
    for size, (row, which, crc) in enumerate(found, 1):
        assert Counter(zip(row.tolist(), crc[which].tolist())) == Counter((i, zlib.crc32(f)) for i, t in enumerate(texts) for f in features(t, [size]))
        assert (np.diff(row) >= 0).all()


def test_zero_bytes():
    for n in (0, 1, 2, 7, 300):
        for value in (b"", b"abc", b"\xff" * 9):
            crc = np.array([zlib.crc32(value)], dtype=np.uint32)
            assert resample.shifted(resample.zeros(n)[None], np.array([0]), crc)[0] ^ zlib.crc32(b"\0" * n) == zlib.crc32(value + b"\0" * n)


@pytest.mark.parametrize("target", [["abc def ghi", None, "", "a b c d"], []])
def test_by_brute_force(spark, docs, texts, target):
    # Enough rows that some are drawn; ties between equal texts are broken by noise, between repeated rows by nothing.
    found = resample.resampled(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()) == plain(texts, target)


def test_empty(spark, none):
    assert resample.resampled(none, none).count() == 0


def test_columns_pass(docs, texts):
    found = resample.with_weights(docs.withColumn("weight", docs.n), np.arange(10_000))
    assert set(found.columns) == {*docs.columns, "weight", "n_words", "n_features"}
    assert found.filter("n <> 7 OR size <> 'wide'").count() == 0 and found.count() == len(texts)


def test_a_hot_bucket_and_target(spark):
    rows = [(i, "same words here " * 10) for i in range(150)] + [(1000 + i, f"other{i} text{i} " * 15) for i in range(50)]
    target = ["same words here same words"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = resample.resampled(docs, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found) == plain(rows, target)
