import itertools
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from conftest import sentence
from graphs import components_of

from driftloom import session
from driftloom.llm import components, jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} - {()}


def by_hand(texts):
    own = [(i, shingles(t)) for i, t in texts]
    links = [(i, i) for i, _ in own]
    for (i, a), (j, b) in itertools.combinations(own, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b) and None not in (i, j):
            links.append((i, j))
    return own, components_of(links)


@pytest.mark.parametrize("x", [None, 0, 64])
def test_components(docs, texts, x, monkeypatch):
    if x is not None:
        monkeypatch.setattr(jaccard_join, "boundary", lambda sizes, scan: x)
    own, component = by_hand(texts)
    found = jaccard_join.join(docs).collect()
    want = sorted((str(i), len(s), str(component[i] if i is not None else None)) for i, s in own)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == want


def test_frequent_shingles_and_salted_lists(spark, monkeypatch):
    """A common passage in texts that are not alike, with every shingle of it frequent."""
    monkeypatch.setattr(jaccard_join, "FREQUENT", 10_000)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(i, f"{passage} " + " ".join(f"w{i}x{k}" for k in range(8 if i % 2 else 40))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(10)]
    _, component = by_hand(rows)
    found = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert {r.doc_id: r.component_id for r in found} == component


def test_no_step_keeps_a_row_for_each_shingle(spark):
    """Families of edited copies that share most lists without linking: what is kept grows with the texts, not with their shingles."""
    rng, rows = random.Random(3), []
    for family in range(12):
        base = sentence(rng, 200).split()
        for _ in range(5):
            own = list(base)
            for _ in range(9):
                own[rng.randrange(len(own))] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(own)))
    kept = []

    def keep(df):
        out = session.reliable_checkpoint(df)
        kept.append(out.count())
        return out

    _, component = by_hand(rows)
    found = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), keep=keep).collect()
    assert {r.doc_id: r.component_id for r in found} == component
    assert max(kept) <= 3 * len(rows)


def test_hopeful_sets_of_blocks(spark):
    """Copies of a class in several blocks are one class; classes that agree in their lower bits stay; too few lists are too few."""
    rng = np.random.default_rng(4)
    new = lambda k: np.unique(rng.integers(0, 2**63, k).astype(np.uint64) & ~np.uint64(1))
    one, other, alone, few = new(40), new(40), new(40), new(40)
    sets = {11: one, 12: np.concatenate((one[:30], new(10))), 13: np.concatenate((one[:29], new(11))), 7: alone, 21: other, 21 + (5 << 32): other, -9: few}
    blocks = []
    for names in ([11, 7, 21], [7, 12, 13], [7, -9, 21 + (5 << 32), 11]):
        blocks += jaccard_join.blocks(((k, sets[k], 10) for k in names), 3)
    entries = spark.createDataFrame(pa.Table.from_batches(blocks))
    assert entries.schema.simpleString() == spark.createDataFrame([], jaccard_join.BLOCK).schema.simpleString()
    classes = spark.createDataFrame([(k, len(s)) for k, s in sets.items()], "class long, n int")
    assert {r["class"]: r.met for r in jaccard_join.hopeful(entries, classes).collect()} == {11: 30, 12: 30, 21: 40, 21 + (5 << 32): 40}


def test_a_repeated_row_gives_its_set_once(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "h i j"), (1, "k l m n o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = jaccard_join.fetch_sets(docs, spark.createDataFrame([(1,)], "doc_id long"), session.reliable_checkpoint).collect()
    assert sorted(len(r.shingles) for r in found) == [8, 24]


def test_empty_table(none):
    assert jaccard_join.join(none).count() == 0


def test_needed_overlap_and_boundary():
    for n, m in itertools.product(range(1, 60), repeat=2):
        for common in range(min(n, m) + 1):
            if 100 * common >= 75 * (n + m - common):
                assert common >= max(jaccard_join.needed(n), jaccard_join.needed(m))
    assert jaccard_join.boundary({}, 0.0) == 0
    assert jaccard_join.boundary({8: 1000, 400: 10}, 500.0) > 8


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 3)]
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    want = components_of([x for x in links if None not in x])
    assert {r.node: r.component for r in found} == want and len(found) == len(want)


def test_frequent_shingles_of_a_batch_in_little_memory():
    """Counted in ranges of hashes: the same shingles and counts as all at once, and no copy of the whole pool."""
    rng = np.random.default_rng(6)
    often = rng.integers(0, 2**64, 50, dtype=np.uint64)
    pool = [np.unique(np.concatenate((rng.integers(0, 2**64, 2000, dtype=np.uint64), rng.choice(often, 5)))) for _ in range(300)]
    tokens, counts = np.unique(np.concatenate(pool), return_counts=True)
    tracemalloc.start()
    found, many = jaccard_join.frequent_in(pool)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    enough = counts >= jaccard_join.BATCH_LEAST
    assert (found == tokens[enough]).all() and (many == counts[enough]).all() and len(found) > 40
    assert peak < sum(s.nbytes for s in pool)
