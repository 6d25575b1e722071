import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import sentence, table
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from driftloom.llm import chunks, token_alignment

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
OWN = token_alignment.pair(token_alignment.PATH_A, token_alignment.PATH_B)
ODD = ["<|endoftext|>", "<s>", "</s><unk>", "日本語 𓀀", "▁x", "a b", "\r\n\t", "   ", "x" * 3000, " " * 2500, "\0", "é é", "don't", "ﬁ"]


def ends(raw):
    return np.cumsum([len(r) for r in raw]).tolist()


def groups(text):
    """Groups by a plain merge of both lists of ends."""
    if not text:
        return []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    raw_a, raw_b = [OWN.bytes[0][i].as_py() for i in a], [OWN.piece(B.id_to_piece(i)) for i in b]
    if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
        return []
    end_a, end_b = ends(raw_a), ends(raw_b)
    at_a, at_b = ({end: k + 1 for k, end in enumerate(ends)} for ends in (end_a, end_b))
    out, i, j = [], 0, 0
    for cut in sorted(set(end_a) & set(end_b)):
        k, m = at_a[cut], at_b[cut]
        out.append((a[i:k], b[j:m]))
        i, j = k, m
    return out


def plain(rows):
    """The query's rows, link by link."""
    per = [(i, g, Counter((x, y) for a, b in g for x in a for y in b)) for i, g in ((i, groups(t)) for i, t in rows)]
    count = Counter(p for _, _, links in per for p in links)
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = Counter()
    for i, g, links in per:
        listed = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        sha = hashlib.sha256(listed.encode()).hexdigest() if g else ""
        n_best = sum(n for p, n in links.items() if count[p] == best[p[0]])
        row = i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(links.values()), n_best, sum(n * count[p] for p, n in links.items()), sha
        out[row] += 1
    return out


def found(frame):
    return Counter(tuple(r) for r in token_alignment.aligned(frame).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def test_by_brute_force(spark, docs, texts, monkeypatch):
    assert found(docs) == plain(texts)
    rows = [*((i, t) for i, t in enumerate(ODD)), *((100 + i, a + " " + b) for i, (a, b) in enumerate(zip(ODD, ODD[1:])))]
    assert found(table(spark, rows).repartition(3)) == plain(rows)


def test_small_chunks_and_wide_groups(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, "same hot line" if i % 3 == 0 else sentence(rng, rng.randint(0, 40)) + "é日ß"[i % 3]) for i in range(120)]
    monkeypatch.setattr(chunks, "CHUNK", 500)
    monkeypatch.setattr(token_alignment, "WIDE", 1)
    monkeypatch.setattr(token_alignment, "PART", 200)
    aligned = [token_alignment.align(OWN, [t or "" for _, t in rows[k : k + 7]]) for k in range(0, 120, 7)]
    monkeypatch.undo()
    usual = [token_alignment.align(OWN, [t or "" for _, t in rows[k : k + 7]]) for k in range(0, 120, 7)]
    for x, y in zip(aligned, usual):
        assert all(np.array_equal(x[k], y[k]) for k in x)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    held = token_alignment.chunked(docs, size=500)
    assert held.count() > 10
    assert found(docs) == plain(rows)


def test_empty(none):
    assert token_alignment.aligned(none).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.sampled_from(ODD)), max_size=5).map("".join))
def test_tokens_and_cuts(text):
    assert OWN.encode_a(text) == A.encode(" " + text, add_special_tokens=False).ids
    got = token_alignment.align(OWN, [text, "", text + "x"])
    for k, t in ((0, text), (2, text + "x")):
        g = groups(t)
        assert got["n_groups"][k] == len(g) and got["n_a"][k] == sum(len(a) for a, _ in g)


@pytest.mark.parametrize("n", [1, 2, 50, 3000])
def test_divide_and_conquer_finds_all_cuts(n):
    rng = np.random.default_rng(n)
    sizes_a, sizes_b, end_a, end_b, start = [], [], [], [], 0
    for _ in range(6):
        total = int(rng.integers(1, n + 1)) * 4
        a, b = (np.union1d(rng.choice(total, size=min(total, k), replace=False), [total - 1]) for k in (n, max(1, n // 50)))
        sizes_a.append(len(a)), sizes_b.append(len(b)), end_a.append(a + start), end_b.append(b + start)
        start += total
    a, b = np.concatenate(end_a), np.concatenate(end_b)
    last_a, last_b = token_alignment.cuts(a, b, np.array(sizes_a), np.array(sizes_b))
    assert a[last_a].tolist() == b[last_b].tolist() == np.intersect1d(a, b).tolist()
