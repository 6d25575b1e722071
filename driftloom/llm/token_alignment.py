"""Alignment of two tokenizers' views of the same bytes.

A byte-level tokenizer (A) reads a space and the text, a piece tokenizer (B) reads the text and adds that space itself. Both give the
same bytes, cut differently. Where a token of A and one of B end at the same byte is a shared cut; between cuts lie the groups.

Groups are found by divide and conquer: in an interval of a document the token of A nearest to the middle whose end is also an
end of B (found by bisection among B's ends) splits it; both halves go on; an interval without a cut inside, or with one token on a
side, is a leaf, which is a group. All intervals of a batch take each step together. The search around the middle doubles its radius, so a
long stretch without a cut costs its length once.

A token pair of a group is a link; a pair's count is the number of documents of the corpus that hold it linked. Documents are kept as
chunks (see ``chunks``) whose dictionaries hold each pair once; only those meet the corpus-wide counts, in a shuffle, and come back. No
link is dropped: in groups of very many tokens links are counted by distinct pairs rather than written out.

Null and empty texts have no tokens, nor have texts that a tokenizer does not give back byte for byte (B normalises some characters):
zeros, and an empty ``groups_sha256``. Repeated rows count as documents each. Ties of counts are all highest. An empty table gives none.
Other columns are not carried.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm import chunks
from driftloom.llm.bpe import byte_letters, slices

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Bytes of text aligned at a time; links of a group beyond which its distinct pairs are counted instead.
PART, WIDE = 2_000_000, 4096
#: Runs that the fast encoder would cut in quadratic time.
_LONG = re.compile(r"\S{1000}|\s{1000}")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Pair:
    """Two tokenizers with the bytes of each of their tokens."""

    def __init__(self, path_a: str, path_b: str) -> None:
        letters = byte_letters()
        with open(path_a, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        special = {t["content"] for t in spec["added_tokens"]}
        ids = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
        self.size_a = max(vocab.values()) + 1
        bytes_a = [b""] * self.size_a
        for raw, i in ids.items():
            bytes_a[i] = raw
        self.slow = tokenizers.Tokenizer.from_file(path_a)
        self.slow.encode_special_tokens = True
        # Ranks by id are right for a vocabulary whose ids follow its merges.
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ids, special_tokens={}) if made == sorted(made) and made[0] == 256 else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.size_b = self.b.get_piece_size()
        bytes_b = [self.piece(self.b.id_to_piece(i)) for i in range(self.size_b)]
        self.bytes = [pa.array(x, pa.binary()) for x in (bytes_a, bytes_b)]
        self.length = [np.array([len(t) for t in x], dtype=np.int64) for x in (bytes_a, bytes_b)]
        marks = [f"{i}{mark}" for size, between in ((self.size_a, ",|"), (self.size_b, ",;")) for mark in between for i in range(size)]
        self.written = pa.array(marks, pa.string())

    @staticmethod
    def piece(piece: str) -> bytes:
        byte = _BYTE.fullmatch(piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def encode_a(self, text: str) -> list[int]:
        if self.fast is None or _LONG.search(text):
            return self.slow.encode(" " + text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(" " + text)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and of B of each text; none where either does not give back the bytes."""
        rows_a = [np.array(self.encode_a(t) if t else [], dtype=np.int32) for t in texts]
        rows_b = [np.array(self.b.encode(t, num_threads=1) if t else [], dtype=np.int32) for t in texts]
        for i, text in enumerate(texts):
            raw = (" " + text).encode() if text else b""
            if any(self.joined(side, rows[i]) != raw for side, rows in enumerate((rows_a, rows_b))):
                rows_a[i] = rows_b[i] = np.zeros(0, dtype=np.int32)
        return rows_a, rows_b

    def joined(self, side: int, ids: np.ndarray) -> bytes:
        """The bytes of tokens one after the other."""
        if not len(ids):
            return b""
        return self.bytes[side].take(pa.array(ids)).buffers()[2].to_pybytes()[: int(self.length[side][ids].sum())]


@functools.lru_cache(maxsize=2)
def pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All values of the ranges, and which range each belongs to."""
    size = np.maximum(stop - start, 0)
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + start[which], which


def cuts(end_a: np.ndarray, end_b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of A and of B that end a group, in order. ``end_a``, ``end_b``: increasing byte ends over all documents, whose last
    tokens end at the same byte; ``sizes_a``, ``sizes_b``: tokens of each document, one at least."""
    hi_a, hi_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    lo_a, lo_b = hi_a - sizes_a, hi_b - sizes_b
    found_a, found_b = [hi_a - 1], [hi_b - 1]
    tried = np.zeros(len(hi_a), dtype=np.int64)  # places on each side of the middle that hold no cut, the middle among them
    while True:
        middle = (lo_a + hi_a - 2) // 2
        inside = (hi_b - lo_b > 1) & (hi_a - lo_a > 1) & ((middle - tried >= lo_a) | (middle + tried <= hi_a - 2))
        lo_a, hi_a, lo_b, hi_b, tried, middle = (x[inside] for x in (lo_a, hi_a, lo_b, hi_b, tried, middle))
        if not len(lo_a):
            break
        reach = 2 * tried + 1
        # Places at distance tried .. reach - 1 on both sides; distance 0 only once.
        left, of_left = ranges(np.maximum(middle - reach + 1, lo_a), middle - tried + 1)
        right, of_right = ranges(middle + np.maximum(tried, 1), np.minimum(middle + reach, hi_a - 1))
        at, of = np.concatenate((left, right)), np.concatenate((of_left, of_right))
        there = np.searchsorted(end_b, end_a[at])
        hit = end_b[there] == end_a[at]
        at, there, of = at[hit], there[hit], of[hit]
        order = np.lexsort((np.abs(at - middle[of]), of))
        at, there, of = at[order], there[order], of[order]
        nearest = np.diff(of, prepend=-1) > 0
        at, there, of = at[nearest], there[nearest], of[nearest]
        found_a.append(at)
        found_b.append(there)
        missed = np.ones(len(lo_a), dtype=bool)
        missed[of] = False
        none = np.zeros(2 * len(of), dtype=np.int64)
        lo_a, hi_a = np.concatenate((lo_a[of], at + 1, lo_a[missed])), np.concatenate((at + 1, hi_a[of], hi_a[missed]))
        lo_b, hi_b = np.concatenate((lo_b[of], there + 1, lo_b[missed])), np.concatenate((there + 1, hi_b[of], hi_b[missed]))
        tried = np.concatenate((none, reach[missed]))
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


def links(ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, pair (A id times ``width`` plus B id) and number of links of each distinct pair of a document. ``doc``: of each group."""
    from_a, from_b = np.append(0, last_a[:-1] + 1), np.append(0, last_b[:-1] + 1)
    size_a, size_b = last_a + 1 - from_a, last_b + 1 - from_b
    wide = size_a * size_b > WIDE
    a, group = ranges(from_a[~wide], last_a[~wide] + 1)
    b, of = ranges(from_b[~wide][group], last_b[~wide][group] + 1)
    keys = [doc[~wide][group[of]] << 40 | ids_a[a[of]].astype(np.int64) * width + ids_b[b]]
    times = [np.ones(len(b), dtype=np.int64)]
    for g in np.flatnonzero(wide):
        (one, n), (two, m) = (np.unique(x, return_counts=True) for x in (ids_a[from_a[g] : last_a[g] + 1], ids_b[from_b[g] : last_b[g] + 1]))
        keys.append((doc[g] << 40 | one.astype(np.int64)[:, None] * width + two).ravel())
        times.append((n[:, None] * m).ravel())
    if len(keys) == 1:
        key, n = np.unique(keys[0], return_counts=True)
    else:
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.zeros(len(key), dtype=np.int64)
        np.add.at(n, at, np.concatenate(times))
    return key >> 40, key & ((1 << 40) - 1), n


def digests(own: Pair, ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, doc_a: np.ndarray, doc_b: np.ndarray) -> list[str]:
    """SHA-256 of each document's groups as text. ``doc_a``, ``doc_b``: tokens up to the end of each document."""
    closes_a, closes_b = np.zeros(len(ids_a), dtype=bool), np.zeros(len(ids_b), dtype=bool)
    closes_a[last_a], closes_b[last_b] = True, True
    group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
    order = np.empty(len(ids_a) + len(ids_b), dtype=np.int32)
    order[np.arange(len(ids_a)) + np.append(0, last_b + 1)[group_a]] = ids_a + closes_a * own.size_a
    order[np.arange(len(ids_b)) + (last_a + 1)[group_b]] = 2 * own.size_a + ids_b + closes_b * own.size_b
    text = own.written.take(pa.array(order))
    ends = np.frombuffer(text.buffers()[1], dtype=np.int32)[np.append(0, doc_a + doc_b)]
    raw = memoryview(text.buffers()[2])
    return [hashlib.sha256(raw[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def align(own: Pair, texts: list[str]) -> dict[str, np.ndarray | list]:
    """Figures of each text, and its distinct linked pairs: how many, which, and how often each."""
    rows_a, rows_b = own.encode(texts)
    sizes_a, sizes_b = (np.array([len(x) for x in rows], dtype=np.int64) for rows in (rows_a, rows_b))
    ids_a, ids_b = np.concatenate(rows_a), np.concatenate(rows_b)
    full = np.flatnonzero(sizes_a)
    if not len(full):
        zero = np.zeros(len(texts), dtype=np.int64)
        return {"n_a": zero, "n_b": zero, "n_groups": zero, "n_links": zero, "sha": [""] * len(texts), "sizes": zero, "pairs": zero[:0], "times": zero[:0]}
    last_a, last_b = cuts(np.cumsum(own.length[0][ids_a]), np.cumsum(own.length[1][ids_b]), sizes_a[full], sizes_b[full])
    doc = full[np.searchsorted(np.cumsum(sizes_a[full]), last_a, side="right")]
    spread = np.diff(last_a, prepend=-1) * np.diff(last_b, prepend=-1)
    add = lambda x: np.bincount(doc, weights=x, minlength=len(texts)).astype(np.int64)
    of, pairs, times = links(ids_a, ids_b, last_a, last_b, doc, own.size_b)
    sha = digests(own, ids_a, ids_b, last_a, last_b, np.cumsum(sizes_a), np.cumsum(sizes_b))
    sizes = np.bincount(of, minlength=len(texts))
    return {"n_a": sizes_a, "n_b": sizes_b, "n_groups": add(np.ones(len(doc))), "n_links": add(spread), "sha": sha, "sizes": sizes, "pairs": pairs, "times": times}


LISTS = ("n_a", "n_b", "n_groups", "n_links", "sizes")
CHUNK_SCHEMA = "chunk long, ids array<{}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sizes array<long>, sha array<string>, links binary, times binary, pairs array<long>, docs array<int>"


def _chunk(number: int, ids: list, parts: list[dict], id_type: pa.DataType) -> pa.RecordBatch:
    """One row: each document's figures, and its pairs as places in the chunk's list of pairs, commonest first."""
    pairs, at, often = np.unique(np.concatenate([p["pairs"] for p in parts]), return_inverse=True, return_counts=True)
    order = np.argsort(-often, kind="stable")
    place = np.empty(len(pairs), dtype=np.int64)
    place[order] = np.arange(len(pairs))
    times = np.concatenate([p["times"] for p in parts])
    row = [number, ids, *(np.concatenate([p[k] for p in parts]) for k in LISTS), sum((p["sha"] for p in parts), [])]
    row += [chunks.packed(place[at]), chunks.packed(times), pairs[order], often[order].astype(np.int32)]
    kinds = [pa.int64(), pa.list_(id_type), *[pa.list_(pa.int64())] * len(LISTS), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["chunk", "ids", *LISTS, "sha", "links", "times", "pairs", "docs"])


def chunked(docs: DataFrame, path_a: str = PATH_A, path_b: str = PATH_B, size: int | None = None) -> DataFrame:
    """The documents (doc_id, text), aligned, as written chunks."""
    size = size or chunks.CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, numbers, held = pair(path_a, path_b), chunks.chunk_ids(), 0
        ids, parts, kind = [], [], pa.int64()
        for batch in batches:
            kind = batch.column("doc_id").type
            for part in slices(batch, "text", min(PART, size)):
                ids += part.column("doc_id").to_pylist()
                parts.append(align(own, [t or "" for t in part.column("text").to_pylist()]))
                held += part.column("text").nbytes
                if held >= size:
                    yield _chunk(next(numbers), ids, parts, kind)
                    ids, parts, held = [], [], 0
        if ids:
            yield _chunk(next(numbers), ids, parts, kind)

    rows = docs.select("doc_id", "text").mapInArrow(run, CHUNK_SCHEMA.format(docs.schema["doc_id"].dataType.simpleString()))
    return chunks.written(rows, "token-alignment-chunks")


def pair_counts(held: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): in how many documents each pair is linked, and whether no pair of its A id is in more."""
    entries = held.select(F.explode(F.arrays_zip("pairs", "docs")).alias("entry"))
    counted = entries.groupBy(F.col("entry.pairs").alias("pair")).agg(F.sum("entry.docs").alias("n"))
    # An A id has at most as many pairs as B has ids.
    highest = F.max("n").over(Window.partitionBy(F.floor(F.col("pair") / width)))
    return counted.withColumn("best", F.col("n") == highest)


def aligned(docs: DataFrame, path_a: str = PATH_A, path_b: str = PATH_B) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document (doc_id, text)."""
    held = chunked(docs, path_a, path_b)
    counted = pair_counts(held, sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size())
    entries = held.select("chunk", F.posexplode("pairs").alias("at", "pair"))
    back = chunks.joined(entries, counted, "pair").select("chunk", "at", "n", "best")

    def run(rows: pa.Table, figures: pa.Table) -> pa.Table:
        row = rows.to_pylist()[0]
        at = figures.column("at").to_numpy()
        n, best = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        n[at], best[at] = figures.column("n").to_numpy(), figures.column("best").to_numpy()
        which, times = chunks.unpacked(row["links"]), chunks.unpacked(row["times"]).astype(np.int64)
        ends = np.append(0, np.cumsum(np.array(row["sizes"], dtype=np.int64)))
        add = lambda x: np.diff(np.append(0, np.cumsum(x))[ends])
        columns = [row["ids"], *(row[k] for k in LISTS[:4]), add(best[which] * times), add(n[which] * times), row["sha"]]
        kinds = [rows.schema.field("ids").type.value_type, *[pa.int64()] * 6, pa.string()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", *LISTS[:4], "n_best", "count_sum", "groups_sha256"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return chunks.with_figures(held.drop("pairs", "docs"), back, run, schema)
