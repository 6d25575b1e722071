import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from driftloom.llm import bpe

KNOWN = bpe.tokenizer(bpe.VOCABULARY)
LIBRARY = Tokenizer.from_file(bpe.VOCABULARY)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=20), st.sampled_from(["<|endoftext|>", "'ll", "  ", "\r\n", " \t x", "don't", " \x1c", "日本", "a" * 90])), max_size=8).map("".join))
def test_ids_and_text_are_the_librarys(text):
    ids = KNOWN.encode(text).tolist()
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    assert KNOWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("start", ["", "<|endoftext|>", " ", "\n", "<|endoftext|> ", "x "])
@pytest.mark.parametrize("word", ["'very", "'red", "'ment", "'stop", "'then", "'llama", "'dear", "'very,", "'reply.", "'", "'s", "1abc", "(abc,", "\u00e9t\u00e9", "_x"])
def test_first_words_that_start_with_no_letter(start, word):
    for text in (start + word, start + word + " and more", start + word + start + word):
        assert KNOWN.encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids, text


def test_lone_and_joint_merges_agree():
    rng = random.Random(1)
    pieces = [bytes(rng.choice(b"theanisr \xc3\xa9") for _ in range(rng.randint(1, 32))) for _ in range(400)]
    together = KNOWN.table.merge_together(pieces, 32)
    alone = [bpe.merge([KNOWN.start[b] for b in p], KNOWN.ranks) for p in pieces]
    assert [list(memoryview(t).cast("i")) for t in together] == alone


def test_leftmost_of_equal_ranks_merges_first():
    assert bpe.merge([1, 1, 1], {(1, 1): (0, 2)}) == [2, 1]
    assert bpe.merge([1, 1, 1, 1, 1], {(1, 1): (0, 2), (2, 2): (1, 3)}) == [3, 1]
    assert bpe.merge([], {}) == [] and bpe.merge([4], {}) == [4]


def test_a_very_long_piece():
    text = "ab" * 30_000
    assert KNOWN.encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_the_memo_stays_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 50)
    monkeypatch.setattr(bpe, "CUT_CHARS", 200)
    own = bpe.Tokenizer(bpe.VOCABULARY)
    texts = [" ".join(f"w{i % 97}x{j}" for j in range(30)) for i in range(200)]
    assert [x.tolist() for x in own.encode_batch(texts)] == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert len(own.memo) < 400


def test_bytes_that_are_no_text():
    assert KNOWN.decode([KNOWN.start[0xFF]]) == "�" and KNOWN.decode(None) == ""


@pytest.mark.parametrize("columns", [["doc_id", "text"], None])
def test_frames(docs, none, texts, columns):
    rows = docs.select(*columns) if columns else docs.withColumn("ids", docs.n)
    found = bpe.with_tokens(rows, decoded="decoded").select("doc_id", "text", "ids", "decoded").collect()
    assert len(found) == len(texts)
    for r in found:
        assert r.decoded == (r.text or "") and r.ids == LIBRARY.encode(r.text or "", add_special_tokens=False).ids
    assert bpe.with_tokens(none, decoded="decoded").count() == 0


def test_columns(docs, texts):
    found = docs.select("text", bpe.encode(docs.text).alias("ids"))
    assert found.select("text", bpe.decode(found.ids).alias("back")).filter("coalesce(text, '') <> back").count() == 0
