import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import sentence

from driftloom.llm import chunks, suffix_tree

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or "")), None]


def out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


class Plain:
    """The same tree by dictionaries; strings are tuples."""

    def __init__(self, rows, least, depth=2):
        self.train = [tokens(t) for i, t in rows if not out(i)]
        self.count = Counter(w for t in self.train for w in t)
        self.n, self.v = sum(self.count.values()), len(self.count)
        strings = Counter()
        for t in self.train:
            full = [None, *t]
            for size in range(2, depth + 2):
                strings.update(tuple(full[k : k + size]) for k in range(len(full) - size + 1))
        single = Counter({(w,): n for w, n in self.count.items()})
        self.strings = {s: n for s, n in (strings + single).items() if n >= least}
        self.marked = {}
        for s, n in self.strings.items():
            if len(s) > 1:
                self.marked.setdefault(s[:-1], {})[s[-1]] = n
        self.kept = {}
        for context in sorted(self.marked, key=len):
            total, next_ = self.strings[context], self.marked[context]
            short = {w: self.p(w, context[1:]) for w in next_}
            rest = total - sum(next_.values())
            gain = sum(n * math.log(n / total / short[w]) for w, n in next_.items())
            if rest > 0:
                gain += rest * math.log(rest / total / max(1e-12, 1 - sum(short.values())))
            self.kept[context] = gain > 0.5 * len(next_) * math.log(total)

    def p(self, word, context):
        if not context:
            return (self.count[word] + 1) / (self.n + self.v + 1)
        short = self.p(word, context[1:])
        if not self.kept.get(context):
            return short
        total, next_ = self.strings[context], self.marked[context]
        handed = 1 - sum(n - 0.5 for n in next_.values()) / total
        return max(0, next_.get(word, 0.5) - 0.5) / total + handed * short

    def row(self, i, text):
        t = tokens(text)
        full = [None, *t]
        score = sum(math.log10(self.p(full[k], tuple(full[max(0, k - 2) : k]))) for k in range(1, len(full)))
        base = sum(math.log10((self.count[w] + 1) / (self.n + self.v + 1)) for w in t)
        return i, out(i), len(t), sum(self.count[w] > 0 for w in t), self.n, base, score


def prose(n=150):
    rng = random.Random(3)
    names = ["ada", "bob", "eve"]
    lines = [f"the {rng.choice(names)} went to the {rng.choice(['town', 'sea'])} and saw {rng.choice(names)} again ." for _ in range(n)]
    rows = [(i, " ".join(lines[i : i + rng.randint(1, 5)]).upper() if i % 2 else lines[i]) for i in range(n)]
    return [*rows, *((1000 + i, sentence(rng, rng.randint(0, 30))) for i in range(40)), (2000, ""), (2001, None), (2002, "the\x1cada unseen-word"), (None, "the ada"), (3, "the ada went")]


def check(frame, rows, least):
    plain = Plain(rows, least)
    want = sorted((plain.row(i, t) for i, t in rows), key=repr)
    got = sorted((tuple(r) for r in suffix_tree.scores(frame, least=least).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in sorted(got, key=lambda r: (r[:5], r[5]) if r[0] is not None else ((-1,), 0))], [r[5:] for r in sorted(want, key=lambda r: (r[:5], r[5]) if r[0] is not None else ((-1,), 0))], rtol=1e-9)
    return plain


def test_by_brute_force(spark):
    rows = prose()
    plain = check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows, 3)
    assert any(len(c) == 2 and k for c, k in plain.kept.items()) and any(not k for k in plain.kept.values())


def test_small_chunks_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "PIECE", 20)
    rows = prose(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert suffix_tree.chunked(docs, size=300).count() > 5
    values = np.array([0, 5, 70_000, 3, 2**31 - 1])
    assert chunks.unpacked(chunks.packed(values)).tolist() == values.tolist() and len(chunks.unpacked(chunks.packed(values[:0]))) == 0
    sizes, body = np.array([1, 30, 2, 1, 25]), np.arange(1, 60)
    seen = [(a, b, t.tolist(), h.tolist()) for a, b, t, h in suffix_tree.pieces(sizes, body)]
    assert [x[:2] for x in seen] == [(0, 1), (1, 2), (2, 4), (4, 5)] and seen[2][2:] == ([0, 32, 33, 0, 34], [0, 3])
    assert sum((x[2] for x in seen), []).count(0) == 5


def test_odd_rows(docs, texts):
    check(docs, texts, 2)


def test_distributions_sum_to_one():
    rows = prose()
    plain = Plain(rows, 3)
    for context in [c for c, k in plain.kept.items() if k][:30]:
        known = sum(plain.p(w, context) for w in plain.count)
        assert known + plain.p("never seen", context) == pytest.approx(1)


def test_word_order_counts(spark):
    rows = [(i, "one two three four five six") for i in range(100)] + [(500, "six five four three two one"), (501, "one two three four five six")]
    found = {r.doc_id: r for r in suffix_tree.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[500].base_score == pytest.approx(found[501].base_score) and found[501].score > found[500].score + 3


def test_empty_and_untrained(spark, none):
    assert suffix_tree.scores(none).count() == 0
    only = next(i for i in range(100) if out(i))
    row = suffix_tree.scores(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert row.n_tokens == 3 and row.n_known == 0 and row.train_tokens == 0 and row.score == row.base_score == 0.0


def test_no_string_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK", 300)
    monkeypatch.setattr(suffix_tree, "PIECE", 50)
    rows = [*prose(80), (3000, "never said before"), (3001, "never said before"), (3002, "only here once"), (3003, "said never before")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert suffix_tree.chunked(frame).count() > 10
    plain = Plain(rows, 1)
    want = sorted((plain.row(i, t) for i, t in rows), key=repr)
    for least in ({}, {"least": 1}):
        got = sorted((tuple(r) for r in suffix_tree.scores(frame, **least).collect()), key=repr)
        assert [r[:5] for r in got] == [r[:5] for r in want]
        by = lambda found: [r[5:] for r in sorted(found, key=lambda r: (r[0] is not None, r[:5], r[5]) if r[0] is not None else (False, (), 0))]
        np.testing.assert_allclose(by(got), by(want), rtol=1e-9)
    assert any(n == 1 and len(s) == 3 for s, n in plain.strings.items()) and any(k and plain.strings[c] < 8 for c, k in plain.kept.items())


@pytest.mark.parametrize("least, depth", [(1, 0), (1, 1), (1, 3), (2, 3), (3, 1)])
def test_depths_by_brute_force(spark, monkeypatch, least, depth):
    monkeypatch.setattr(chunks, "CHUNK", 500)
    rows = [(i, t) for i, t in prose(40) if i is not None and i != 3]
    plain = Plain(rows, least, depth)
    found = {r.doc_id: r.score for r in suffix_tree.scores(spark.createDataFrame(rows, "doc_id long, text string"), least=least, depth=depth).collect()}
    for i, t in rows:
        full = [None, *tokens(t)]
        assert found[i] == pytest.approx(sum(math.log10(plain.p(full[k], tuple(full[max(0, k - depth) : k]))) for k in range(1, len(full))), rel=1e-9)


def test_a_larger_corpus_keeps_its_rare_strings(spark):
    twice = "never said before in any other place"
    rows = [(i, "one two three four five six") for i in range(4000)] + [(9000 + i, twice) for i in range(2)]
    rows = [(i, t) for i, t in rows if not out(i)]
    found = {r.doc_id: r for r in suffix_tree.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    plain = Plain(rows, 1)
    for i, t in rows[-2:]:
        assert found[i].score == pytest.approx(plain.row(i, t)[-1], rel=1e-9) and found[i].score > found[i].base_score + 10
