import itertools
import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from driftloom.llm import decontaminate, hilbert, licences, quotations


def weighted(items, a, b):
    df = Counter(s for own in items for s in set(own))
    weight = lambda s: np.log1p(len(items) / max(1, df[s]))
    x, y = Counter(a), Counter(b)
    return sum(weight(s) * n for s, n in (x & y).items()) / sum(weight(s) * n for s, n in (x | y).items())


def grams(text):
    words = text.lower().split()
    return [tuple(words[k : k + 5]) for k in range(len(words) - 4)] or [tuple(words)]


@pytest.fixture(scope="module")
def bench():
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([12, 20, 20, 35])))) for i in range(30)]
    return [*items, (30, "too few words"), (31, items[0][1]), (32, None), (33, "")], vocabulary


def leaky(bench):
    rng = random.Random(6)
    items, vocabulary = bench
    rows = []
    for i in range(150):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        passage = (rng.choice(items[:31])[1] or "").split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            passage[rng.randrange(len(passage))] = "changed"
        at = rng.randint(0, len(own))
        rows.append((i, " ".join(own[:at] + (passage if i % 2 else []) + own[at:]).upper() if i % 3 else " ".join(own)))
    return rows


def test_leaks(spark, bench):
    items, _ = bench
    rows = leaky(bench)
    known = [(i, t) for i, t in items if t]
    own = [grams(t) for _, t in known]
    want = set()
    for doc, text in rows:
        if text.split():
            found = grams(text)
            for (item, _), g in zip(known, own):
                width = min(len(g), len(found))
                if max(weighted(own, found[k : k + width], g) for k in range(len(found) - width + 1)) >= 0.75:
                    want.add((doc, item))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, x.item_id): x for r in decontaminate.with_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect() for x in r.leaks}
    assert set(got) == want and len(want) > 20
    assert all(x.hamming <= decontaminate.RADIUS for x in got.values())


def test_leaks_in_blocks_and_odd_rows(spark, docs, none, texts, bench, monkeypatch):
    items = spark.createDataFrame(bench[0], "item_id long, text string")
    rows = spark.createDataFrame(leaky(bench), "doc_id long, text string")
    whole = {r.doc_id: {x.item_id for x in r.leaks} for r in decontaminate.with_leaks(rows, items).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK", 9)
    parts = {r.doc_id: {x.item_id for x in r.leaks} for r in decontaminate.with_leaks(rows, items).collect()}
    # Weights are those of a block, so only similarities near the threshold could differ.
    assert sum(whole[d] != parts[d] for d in whole) <= 2
    found = decontaminate.with_leaks(docs, items)
    assert found.columns == [*docs.columns, "leaks"] and found.count() == len(texts) and found.filter("size(leaks) > 0").count() == 0
    assert decontaminate.with_leaks(none, items).count() == 0
    assert decontaminate.with_leaks(docs, items.limit(0)).filter("size(leaks) > 0").count() == 0


def test_leaks_do_not_depend_on_the_blocks(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(200)]
    common = [rng.choice(vocabulary) for _ in range(14)]
    # Half of the items hold a passage in common, two are the same row, and one has no id.
    items = [(i, " ".join((common if i % 2 else []) + [rng.choice(vocabulary) for _ in range(12 if i % 2 else 26)])) for i in range(40)]
    items += [items[0], (None, items[1][1]), (40, " \t"), (41, None)]
    rows = []
    for i in range(16):
        passage = rng.choice(items[:40])[1].split()
        if i % 4:
            passage[i % 4 - 1] = "changed"
        rows.append((i, " ".join([*common, "x", *passage, *rng.choices(vocabulary, k=5)])))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {r.doc_id: r.leaks for r in decontaminate.with_leaks(docs, bench).collect()}
    known = [(i, t) for i, t in items if t and t.split()]
    own = [grams(t) for _, t in known]
    want = {(doc, item) for doc, text in rows for found in [grams(text)] for (item, _), g in zip(known, own) if max(weighted(own, found[k : k + len(g)], g) for k in range(len(found) - len(g) + 1)) >= 0.75}
    assert {(d, x.item_id) for d, leaks in whole.items() for x in leaks} == want and len(want) > 8
    for size in (14, 30):
        monkeypatch.setattr(decontaminate, "BLOCK", size)
        assert {r.doc_id: r.leaks for r in decontaminate.with_leaks(docs, bench).collect()} == whole, size


def test_block_tables_find_every_print_within_the_radius():
    rng = np.random.default_rng(3)
    own = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    probes = own[rng.integers(0, 40, 3000)].copy()
    for k in range(len(probes)):
        for bit in rng.choice(64, rng.integers(0, 30), replace=False):
            probes[k] ^= np.uint64(1) << np.uint64(bit)
    items = decontaminate.Items([])
    items.prints, items.tables = {1: own}, {1: items.table(own)}
    got = {(w, i) for w, i, _ in items.near(probes, 1)}
    assert got == {(w, i) for w, i in itertools.product(range(3000), range(40)) if int(probes[w] ^ own[i]).bit_count() <= decontaminate.RADIUS}


@pytest.mark.parametrize("dims, bits", [(1, 5), (2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_each_cell_next_to_the_last(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    index = hilbert.curve_index(cells, bits)
    assert sorted(index.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(1) == 1).all()


def test_shards(docs, none, texts):
    rows = hilbert.assign(docs).collect()
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in counts.items())
    assert [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))] == sorted(r.curve for r in rows)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert hilbert.assign(none).count() == 0
    assert {r.shard for r in hilbert.assign(docs.limit(5)).collect()} == {0, 3, 6, 9, 12}


def test_files_prune_in_every_dimension(spark, tmp_path):
    rng = random.Random(8)
    rows = spark.createDataFrame([(i, "x" * rng.randint(1, 900), rng.choice("abcdefgh"), f"s{rng.randint(10, 90)}") for i in range(4000)], "doc_id long, text string, lang string, source string")
    placed = hilbert.assign(rows)
    hilbert.write_shards(rows, placed, str(tmp_path / "out"), files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 4000 and back.select("shard").distinct().count() == 16
    spread = [len({r[d] for r in part}) for part in ([r for r in back.collect() if r.shard == s] for s in range(16)) for d in ("lang", "source")]
    assert np.mean(spread[::2]) < 8 and np.mean(spread[1::2]) < 60


LICENSED = [
    ("Some text.\nReleased under the MIT License.", {"mit"}),
    ("released UNDER  the-MIT license", {"mit"}),
    ("All rights reserved.\r\nx", {"all-rights-reserved"}),
    ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nCode.", {"gpl-3.0-notice"}),
    ("All rights are not reserved here.", set()),
    ("Released under no licence at all, ever.", set()),
    ("Licensed under CC BY-NC 4.0.", {"cc-by-nc-4.0"}),
    ("Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", {"apache-2.0", "mit"}),
]


def test_licences(spark, docs, none):
    rows = spark.createDataFrame([(i, t, "old") for i, (t, _) in enumerate(LICENSED)], "doc_id long, text string, licences string")
    for r in licences.with_licences(rows).collect():
        assert {m.licence for m in r.licences} == LICENSED[r.doc_id][1], LICENSED[r.doc_id]
    assert licences.with_licences(docs).filter("size(licences) > 0").count() == 0
    assert licences.with_licences(docs).columns == [*docs.columns, "licences"]
    assert licences.with_licences(none).count() == 0


@pytest.mark.parametrize("tenths", [5, 8, 9, 10])
def test_size_bounds_lose_nothing(spark, tenths):
    rng = random.Random(tenths)
    template = "alpha beta gamma delta epsilon zeta eta theta"
    own = set(licences.bigrams_of(template))
    rows = []
    for i in range(300):
        words = template.split()
        for _ in range(rng.randint(0, 6)):
            (words.insert if rng.random() < 0.5 else lambda at, w: words.pop(at % max(1, len(words))))(rng.randint(0, len(words)), "alpha")
        rows.append((i, " ".join(words)))
    found = {r.doc_id for r in licences.with_licences(spark.createDataFrame(rows, "doc_id long, text string"), {"t": template}, tenths).collect() if r.licences}
    dice = lambda g: 2 * len(g & own) / (len(g) + len(own))
    assert found == {i for i, t in rows if (g := set(licences.bigrams_of(t))) and 10 * dice(g) >= tenths - 1e-9}


MESSAGES = [
    (1, 0, "user", "Hello, how do I sort a list of numbers?\nThanks"),
    (1, 1, "assistant", "Use the sorted function on it.\nIt returns a new list always."),
    (1, 2, "user", "> Use the sorted function on it.\n> It returns a new list always.\nBut what about in place sorting please?"),
    (1, 3, "assistant", "Ann wrote:\n>> Use the sorted function on it.\n> > It returns a new list always.\n> But what about in place sorting please?\nCall sort on the list itself."),
    (1, 4, "user", "> Hello,  HOW do I sort a list of numbers\nNever mind that question."),
    (2, 0, "user", None),
    (2, 0, "user", None),
    (2, 1, "user", "> never said by anyone in here\n"),
    (2, None, "user", "> x"),
    (None, 0, "user", "> Never mind that question."),
]


def test_quotations(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = quotations.conversations(spark.createDataFrame(MESSAGES, schema)).collect()
    assert len(rows) == len(MESSAGES)
    first = {r.turn: r for r in rows if r.conv_id == 1}
    assert {t: (r.parent_turn, r.root_turn, r.depth, r.position) for t, r in first.items()} == {0: (None, 0, 0, 0), 4: (0, 0, 1, 1), 1: (None, 1, 0, 2), 2: (1, 1, 1, 3), 3: (2, 1, 2, 4)}
    assert first[3].text == "Call sort on the list itself." and first[3].n_quotes == 3
    assert all(r.parent_turn is None for r in rows if r.conv_id != 1)
    assert sorted(r.position for r in rows if r.conv_id == 2) == [0, 1, 2, 3]
    assert quotations.conversations(spark.createDataFrame([], schema)).count() == 0


def test_short_wrapped_and_mixed_quotes(spark):
    first = "Dear all,\n\nthe release of the engine is planned for Monday of next week. Please test it until Friday.\n\nWho signs off?\nRegards"
    second = "I can test the reader tomorrow, but not the writer.\nThanks"
    third = "Fine with me. Who pays?"
    quotes = [
        ("> Who signs off?\nI do.", 0),
        ("> the release of the engine is planned for\n> Monday of next week. Please test\n> it until Friday.\nOk.", 0),
        ("> the release of the engine is\n> planned for Monday of next week.\nNo.", 0),
        ("> Who signs off?\nMe.\n> I can test the reader\n> tomorrow, but not the writer.\nGood.", 1),
        ("> Who signs off?\nAnn.\n> Thanks\nYou are welcome.", 1),
        ("> Who pays?\nWe do.", 2),
        ("> Who signs\nNobody knows.", None),
    ]
    rows = [(c, t, "user", x) for c in range(len(quotes)) for t, x in enumerate([first, second, third, quotes[c][0]])]
    found = {r.conv_id: r.parent_turn for r in quotations.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect() if r.turn == 3}
    assert found == {c: want for c, (_, want) in enumerate(quotes)}


def test_long_chains_of_replies(spark):
    rows = [(1, i, "user", (f"> this is said in turn number {i - 1}\n" if i else "") + f"this is said in turn number {i}") for i in range(40)]
    found = {r.turn: r for r in quotations.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all((r.root_turn, r.depth, r.position) == (0, t, t) for t, r in found.items())


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    done = corpus_pipeline.run(spark, sf)
    assert {*docs.columns, "ids", "decoded", "n_tokens"} == set(done.columns)
    rows = done.collect()
    assert 0 < len(rows) < docs.count() and len({r.doc_id for r in rows}) == len(rows)
    assert all(r.decoded == r.text and r.n_tokens == len(r.ids) for r in rows)


def test_stages_keep_columns_and_odd_rows(spark, sf, docs, none):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert out.filter("doc_id IS NULL").count() == 2 and out.filter("_text = 'kept'").count() == out.count()
        assert stage(spark, none, sf).count() == 0
