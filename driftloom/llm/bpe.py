"""Byte-pair encoding and decoding.

A text is cut into pieces by the tokenizer's pattern. A piece starts as its bytes; a segment tree over the ranks of adjacent
pairs keeps the lowest rank of every range at the range's node, so the root yields the leftmost pair of the lowest rank. A merge
is a point update of two or three leaves, each in logarithmic time; it ends when the root holds no mergeable pair. Long pieces
(a line without white space, say) therefore cost n log n, not n squared.

Most pieces are short words. Those that a worker has not met yet are merged together, one segment tree per row of a matrix, so that
a step costs a few array operations for all of them; a piece longer than ``TOGETHER`` bytes gets a tree of its own.

Both directions are Arrow functions of one row each: no shuffle, and a lost executor only repeats its own rows. The memo of
pieces is bounded in entries and bytes, and cleared when full, so that memory does not grow with the corpus.

Nulls encode like the empty text, to no ids; null ids decode to the empty text. Other columns pass through untouched.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The default vocabulary: byte-level BPE with 50,257 entries.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

#: Words remembered by a worker, twice at most; those of more characters than ``TOGETHER`` are not.
MEMO_WORDS = 150_000

#: Longest piece that is merged together with others, and the characters of text cut into pieces at a time.
TOGETHER, CUT_CHARS = 64, 1_000_000

_NONE = 1 << 60
_WIDE = re.compile(r" (?!\S)")
_LAST = frozenset(".,;:!?")
_GAP = re.compile(r"(?= \S)")


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def merge(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge the leftmost pair of the lowest rank until none is left. ``ranks``: pair -> (rank, merged symbol)."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = list(symbols)
    get = ranks.get
    leaves = 1 << (n - 2).bit_length() if n > 2 else 1
    # A leaf holds rank * width + position: the least of a range is its lowest rank, and the leftmost among equals.
    width = leaves
    tree = [_NONE] * (2 * leaves)
    for i in range(n - 1):
        found = get((symbols[i], symbols[i + 1]))
        if found is not None:
            tree[leaves + i] = found[0] * width + i
    for at in range(leaves - 1, 0, -1):
        a, b = tree[2 * at], tree[2 * at + 1]
        tree[at] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        at = leaves + i
        tree[at] = value
        while at > 1:
            at >>= 1
            a, b = tree[2 * at], tree[2 * at + 1]
            low = a if a < b else b
            if tree[at] == low:
                break
            tree[at] = low

    def pair(i: int) -> int:
        j = after[i]
        found = get((symbols[i], symbols[j])) if j < n else None
        return _NONE if found is None else found[0] * width + i

    while tree[1] < _NONE:
        i = tree[1] % width
        j = after[i]
        symbols[i] = get((symbols[i], symbols[j]))[1]
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        if j < n - 1:
            put(j, _NONE)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return out


def _cut(text: str) -> list[str]:
    if _WIDE.search(text) is None and "\0" not in text:
        return text.replace(" ", "\0 ").split("\0")
    return _GAP.split(text)


class PairTable:
    """Ranks and results of symbol pairs, looked up by array."""

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]], start: list[int], width: int) -> None:
        self.width = width
        pairs = np.array([a * width + b for a, b in ranks], dtype=np.int64)
        order = np.argsort(pairs)
        self.keys = pairs[order]
        values = np.array(list(ranks.values()), dtype=np.int64).reshape(-1, 2)
        self.rank_at, self.merged = values[order, 0], np.zeros(len(values) + 1, dtype=np.int32)
        self.merged[values[:, 0]] = values[:, 1]
        self.start = np.array(start, dtype=np.int32)
        first = np.repeat(self.start, 256), np.tile(self.start, 256)
        self.none = len(ranks)
        self.first_rank = self.rank(*first).reshape(256, 256)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``none`` where it has none or a symbol is -1."""
        key = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.rank_at[at], self.none)

    def merge_together(self, pieces: list[bytes], leaves: int) -> list[bytes]:
        """``merge`` of pieces of at most ``leaves`` bytes (a power of two), as bytes of int32: row w of every matrix is piece w."""
        w = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), dtype=np.uint8).reshape(w, leaves)
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=w)
        place = np.arange(leaves)
        symbols = np.full((w, leaves + 1), -1, dtype=np.int32)
        symbols[:, :leaves] = np.where(place < sizes[:, None], self.start[raw], -1)
        none = self.none * leaves + leaves
        tree = np.full((w, 2 * leaves), none, dtype=np.int64)
        ranks = np.where(place[1:] < sizes[:, None], self.first_rank[raw[:, :-1], raw[:, 1:]], self.none)
        tree[:, leaves:-1] = np.where(ranks < self.none, ranks * leaves + place[:-1], none)
        level = leaves
        while level > 1:
            level >>= 1
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        after = np.tile(np.arange(1, leaves + 2), (w, 1))
        before = np.tile(np.arange(-1, leaves), (w, 1))
        rows = np.arange(w)

        def put(rows: np.ndarray, i: np.ndarray, rank: np.ndarray) -> None:
            tree[rows, leaves + i] = np.where(rank < self.none, rank * leaves + i, none)
            at = leaves + i
            for _ in range(leaves.bit_length() - 1):
                at = at >> 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

        while True:
            root = tree[rows, 1]
            rows, root = rows[root < none], root[root < none]
            if not len(rows):
                break
            rank, i = np.divmod(root, leaves)
            j = after[rows, i]
            k = after[rows, j]
            symbols[rows, i] = self.merged[rank]
            symbols[rows, j] = -1
            after[rows, i] = k
            inside = k < leaves
            before[rows[inside], k[inside]] = i[inside]
            put(rows, j, np.full(len(rows), self.none))
            put(rows, i, self.rank(symbols[rows, i], symbols[rows, np.minimum(k, leaves)]))
            b = before[rows, i]
            has = b >= 0
            put(rows[has], b[has], self.rank(symbols[rows[has], b[has]], symbols[rows[has], i[has]]))
        live = symbols >= 0
        flat, ends = symbols[live].tobytes(), (4 * np.cumsum(live.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]


class Tokenizer:
    """One vocabulary file: its merges, pieces and special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, model = byte_letters(), spec["model"]
        vocab: dict[str, int] = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.start = [0] * 256
        for letter, byte in letters.items():
            self.start[byte] = vocab[letter]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_id = {i: bytes(letters[c] for c in token) for token, i in vocab.items() if token not in self.special}
        by_id |= {i: token.encode() for token, i in self.special.items()}
        self.bytes_of = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self.table = PairTable(self.ranks, self.start, len(self.bytes_of))
        self.special_ids = {p: np.int32(i).tobytes() for p, i in self.special.items()}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of new words, of one or more pieces each, as bytes of int32."""
        cut = {w: self.split(w) for w in words}
        ids: dict[str, bytes] = {}
        by_size: dict[int, list[bytes]] = {}
        for text in set().union(*cut.values()):
            raw = text.encode()
            if len(raw) > TOGETHER:
                ids[text] = np.array(merge([self.start[b] for b in raw], self.ranks), dtype=np.int32).tobytes()
            else:
                by_size.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append(raw)
        for leaves, pieces in by_size.items():
            for at in range(0, len(pieces), 8_000):
                part = pieces[at : at + 8_000]
                ids.update(zip(map(bytes.decode, part), self.table.merge_together(part, leaves)))
        return {w: b"".join([ids[p] for p in own]) for w, own in cut.items()}

    def split(self, word: str) -> tuple[str, ...]:
        """The pattern's pieces of a word; letters alone, and letters with a mark after them, are cut without it.

        Only a space may stand before the letters: the first word of a text can start with an apostrophe and a contraction.
        """
        letters = word[1:] if word[:1] == " " else word
        if letters.isalpha():
            return (word,)
        if letters[-1:] in _LAST and letters[:-1].isalpha():
            return (word[:-1], word[-1])
        return tuple(self.pieces.findall(word))

    def words(self, text: str) -> list[str]:
        """A text cut at special tokens, and before each space that a visible character follows.

        The pattern has a boundary at such a space whatever stands around it, so a word's pieces depend on the word alone.
        """
        out, at = [], 0
        for hit in self.cut.finditer(text) if self.cut else ():
            out += [*_cut(text[at : hit.start()]), hit.group()]
            at = hit.end()
        return out + _cut(text[at:] if at else text)

    def encode_batch(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, in order; null is the empty text."""
        held: list[list[str]] = []
        chars = 0
        for text in texts:
            held.append(self.words(text or ""))
            chars += len(text or "")
            if chars >= CUT_CHARS:
                yield from self._ids(held)
                held, chars = [], 0
        yield from self._ids(held)

    def _ids(self, held: list[list[str]]) -> Iterator[np.ndarray]:
        words = set().union(*held)
        if len(self.memo) > MEMO_WORDS:
            # Words that are met again come back from the older half; the others go with it.
            self.memo, self.older = {}, self.memo
        new = words.difference(self.memo)
        again = new.intersection(self.older)
        self.memo.update({w: self.older[w] for w in again})
        self.memo.update(self.special_ids)
        self.memo.update(self.learn(new.difference(again)))
        known = self.memo.__getitem__
        for own in held:
            yield np.frombuffer(b"".join(map(known, own)), dtype=np.int32)
        for word in [w for w in words if len(w) > TOGETHER]:
            del self.memo[word]

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_batch([text]))

    def decode(self, ids: Iterable[int] | None) -> str:
        table = self.bytes_of
        return b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace") if ids is not None else ""


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode(text: Column, path: str = VOCABULARY) -> Column:
    """The ids of a text, without special tokens added; ``<|endoftext|>`` in a text is the special token, as in the library."""

    @F.pandas_udf(T.ArrayType(T.IntegerType(), False))
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = tokenizer(path)
        for batch in texts:
            yield pd.Series(list(known.encode_batch(batch)), dtype=object)

    return ids(text)


def decode(ids: Column, path: str = VOCABULARY) -> Column:
    """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""

    @F.pandas_udf(T.StringType())
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = tokenizer(path)
        for batch in batches:
            yield pd.Series([known.decode(x.tolist() if x is not None else None) for x in batch], dtype=object)

    return text(ids)


def slices(batch: pa.RecordBatch, column: str, size: int = CUT_CHARS) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``size`` bytes of a text column, of one row at least."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, end - start)
        start = end


def with_tokens(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str | None = None, path: str = VOCABULARY) -> DataFrame:
    """Add the ids of ``text`` and, on request, what they decode to. Columns of these names are replaced.

    Rows pass as Arrow batches and leave in small parts, so a worker never holds the ids of a whole batch.
    """
    kept = [c for c in df.columns if c not in (ids, decoded)]
    fields = [df.schema[c] for c in kept] + [T.StructField(ids, T.ArrayType(T.IntegerType(), True))] + [T.StructField(decoded, T.StringType())] * bool(decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizer(path)
        for batch in batches:
            for part in slices(batch, text):
                rows = list(known.encode_batch(part.column(text).to_pylist()))
                ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
                out = [part.column(c) for c in kept] + [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rows)))]
                if decoded:
                    out.append(pa.array([known.decode(x.tolist()) for x in rows], pa.string()))
                yield pa.RecordBatch.from_arrays(out, [f.name for f in fields])

    return df.mapInArrow(run, T.StructType(fields))
