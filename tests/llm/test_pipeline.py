"""The pipeline's stages on rows that are hard to keep right."""

import random
from collections import Counter

import corpus_pipeline
from conftest import sentence, table
from test_jaccard_join import shingles

from driftloom.llm import ftrl


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def kept_by_hand(rows):
    """Row numbers that stay: rows without id or words, and the least (id, text) of each group."""
    own = [(k, i, shingles(t)) for k, (i, t) in enumerate(rows)]
    group = {k: k for k, _, _ in own}

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for k, i, a in own:
        for m, j, b in own[:k]:
            if a and b and None not in (i, j) and 100 * len(a & b) >= 75 * len(a | b):
                group[find(k)] = find(m)
    groups = {}
    for k, i, a in own:
        if i is not None and a:
            groups.setdefault(find(k), []).append(k)
    return [k for k, i, a in own if i is None or not a], list(groups.values())


def test_near_copies_keep_different_texts_of_one_id(spark):
    rng = random.Random(8)
    one, two, three = (sentence(rng, 40) for _ in range(3))
    rows = [(1, one), (1, two), (1, one + " tail"), (2, two), (3, three), (3, three), (3, three.upper()), (4, ""), (4, ""), (None, one), (None, None), (5, None), (9, "a b"), (9, "A b")]
    found = Counter((r.doc_id, r.text) for r in stage("near_copies")(spark, table(spark, rows).repartition(5), "").collect())
    free, groups = kept_by_hand(rows)
    for k in free:
        assert found[rows[k]] == sum(rows[m] == rows[k] for m in free)
    for members in groups:
        ids = [rows[m][0] for m in members]
        stayed = [rows[m] for m in set(members) if rows[m] in found]
        assert sum(found[r] for r in set(stayed)) == 1 and stayed[0][0] == min(ids)
    assert sum(found.values()) == len(free) + len(groups)
    assert found[(3, three.upper())] == 1 and found[(9, "A b")] == 1  # the least of equal sets
    assert {t for i, t in found if i == 1} >= {two} and len([1 for i, _ in found if i == 1]) == 2


def test_near_copies_of_the_usual_rows(spark, docs, texts):
    found = Counter((r.doc_id, r.text) for r in stage("near_copies")(spark, docs, "").collect())
    free, groups = kept_by_hand(texts)
    assert sum(found.values()) == len(free) + len(groups)
    assert all(any(texts[m] in found for m in members) for members in groups)


def test_a_hot_id_gives_one_row_to_the_sample(spark):
    rows = [(i, f"text {i}") for i in range(40)] + [(3, f"hot {i}") for i in range(500)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    found = ftrl.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), labels, "toxic", 100).collect()
    assert max(Counter(r.doc_id for r in found).values()) == 1
    assert {r.text for r in found if r.doc_id == 3} <= {"hot 0"} and len(found) > 20
