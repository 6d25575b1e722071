"""Language-model scores from a probabilistic suffix tree over words.

Tokens are the words of a text (A-Z lower-cased) and one end; a text's first word follows the end of another. The root of the tree is
the add-one distribution over all words of the training documents. A node stands for a context of one or two words. Its
*marked* next words are those that make, with the context, a string of the training documents (of ``least`` occurrences, 1 unless a caller
asks for more); the rest of its occurrences is a remainder. A context is retained if its next words diverge from what the shorter context
predicts: the Kullback-Leibler divergence times its occurrences must exceed half the number of marked words times the log of the occurrences
(the Bayesian criterion). A retained context gives a marked word its discounted share and hands the rest of its mass to the shorter context,
so every distribution sums to one. A token is scored in the state of the longest retained suffix of what stands before it.

No string is left out, however rare, so the tree grows with the corpus and is held nowhere as a whole. Documents lie in chunks (see
``chunks``). A chunk finds its distinct strings and sends them, as sorted keys in blocks, to buckets of keys; a bucket adds up what the chunks
have seen and answers each with the counts of its own strings. Sums over a context's next words go the same way: each string is counted in
one chunk that holds it, its owner. A string whose two shorter strings are not both in other chunks is in none, and is counted where it lies.
Sums are of whole numbers (logarithms in steps of 2**-22), so they do not hang on how documents were cut into chunks.

Words and strings are 64-bit hashes: of V distinct ones some two agree with a chance of V * V / 2**65.

Null and empty texts are one end. A null id is a training document. Repeated rows count, and are scored, each. An empty table has
no scores; without training documents every token is unknown and the root alone scores. Other columns are not carried.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm import chunks, words
from driftloom.llm.bpe import slices

LEAST, DEPTH, DISCOUNT = 1, 2, 0.5
#: Hash of the end, and the tokens that are looked at together.
END, PIECE = np.int64(-1), 300_000
#: Tokens of the corpus for each bucket of strings, and the fewest buckets (a power of 2).
BUCKET, FEWEST = 6_000_000, 5
#: Steps of a logarithm, and of a probability, in sums.
LOG_STEPS, P_STEPS = 2.0**22, 2.0**60
#: What a bucket says of a chunk's string: it is in no other chunk; this chunk is its owner.
ALONE, OWNER = 1, 2
CHUNK_SCHEMA = "chunk long, ids array<{}>, held array<boolean>, sizes array<int>, tokens binary, words array<long>, seen array<int>"
#: Blocks of strings of kind / 2 + 1 words: their counts (even kinds), or the sums over the next words of these contexts (odd kinds).
BLOCK_SCHEMA = "chunk long, kind int, bucket int, data array<binary>"


def held_out(doc_id: Column) -> Column:
    """A fixed seventh of all documents, never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _chunk(number: int, ids: list, held: list, found: list[tuple[np.ndarray, np.ndarray]], id_type: pa.DataType) -> pa.RecordBatch:
    """One row: the documents' tokens as places in the chunk's list of words, commonest first; the end has place 0."""
    value = np.concatenate([v for v, _ in found])
    sizes = np.concatenate([np.diff(e, prepend=0) for _, e in found])
    known, at, often = np.unique(value, return_inverse=True, return_counts=True)
    order = np.argsort(-often, kind="stable")
    place = np.empty(len(known), dtype=np.int32)
    place[order] = np.arange(1, len(known) + 1, dtype=np.int32)
    tokens = np.zeros(len(value) + len(sizes), dtype=np.int32)
    tokens[np.arange(len(value)) + np.repeat(np.arange(len(sizes)), sizes)] = place[at]
    learnt = np.repeat(~np.array(held, dtype=bool), sizes + 1)
    seen = np.bincount(tokens[learnt], minlength=len(known) + 1)
    own = np.append(END, known[order].view(np.int64))
    row = [[number], [ids], [held], [(sizes + 1).astype(np.int32)], [chunks.packed(tokens)], [own], [seen.astype(np.int32)]]
    kinds = [pa.int64(), pa.list_(id_type), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["chunk", "ids", "held", "sizes", "tokens", "words", "seen"])


def chunked(docs: DataFrame, size: int | None = None) -> DataFrame:
    """The documents (doc_id, text) as written chunks; held-out ones are marked."""
    size = size or chunks.CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held_bytes = chunks.chunk_ids(), 0
        ids, held, found = [], [], []
        kind = pa.int64()
        for batch in batches:
            kind = batch.column("doc_id").type
            for part in slices(batch, "text", min(1_000_000, size)):
                texts = part.column("text").to_pylist()
                ids += part.column("doc_id").to_pylist()
                held += part.column("held").to_pylist()
                found.append(words.hash_words([t or "" for t in texts]))
                held_bytes += part.column("text").nbytes
                if held_bytes >= size:
                    yield _chunk(next(numbers), ids, held, found, kind)
                    ids, held, found, held_bytes = [], [], [], 0
        if ids:
            yield _chunk(next(numbers), ids, held, found, kind)

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held"))
    return chunks.written(rows.mapInArrow(run, CHUNK_SCHEMA.format(docs.schema["doc_id"].dataType.simpleString())), "suffix-tree-chunks")


def pieces(sizes: np.ndarray, tokens: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents of about ``PIECE`` tokens: first and last document, tokens with an end before each document, its places."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + PIECE, side="right")))
        own = sizes[start:end]
        heads = np.cumsum(own + 1) - own - 1
        out = np.zeros(int(own.sum()) + len(own), dtype=np.int32)
        body = np.ones(len(out), dtype=bool)
        body[heads] = False
        out[body] = tokens[before : ends[end - 1]]
        yield start, end, out, heads
        start = end


def bucketed(chunk: int, kind: int, bucket: np.ndarray, key: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
    """Sorted keys with their figures as one block per bucket."""
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(key)] if len(key) else [0]
    runs = [slice(a, b) for a, b in zip(cuts, cuts[1:])]
    data = [[chunks.packed(np.diff(key[r], prepend=key.dtype.type(0)), 8), *(chunks.packed(c[r], 8) for c in columns)] for r in runs]
    row = [[chunk] * len(runs), [kind] * len(runs), [int(bucket[r.start]) for r in runs], data]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.binary())]
    return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["chunk", "kind", "bucket", "data"])


def retained(total: np.ndarray, marked: np.ndarray, share: np.ndarray, gain: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Whether contexts pass the test: their occurrences and, summed over marked next words, number, occurrences, gain and shorter prediction."""
    n = np.maximum(total, 1).astype(float)
    rest = np.maximum(n - share, 0.0)
    left = np.where(rest > 0, rest * np.log(np.maximum(rest, 1e-300) / n / np.maximum(1.0 - short / P_STEPS, 1e-12)), 0.0)
    return (marked > 0) & (gain / LOG_STEPS + left > 0.5 * marked * np.log(n))


def meet(blocks: DataFrame) -> DataFrame:
    """What each bucket answers its chunks, block by block, written. Counts: rank of the key in the bucket, count, state; contexts: number and
    occurrences of marked words, whether retained. ``tokens`` and ``known``: of all words of the bucket, in one of its rows."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        keys, columns = [], []
        for data in table.column("data"):
            key, *rest = (chunks.unpacked(x.as_py(), 8) for x in data)
            keys.append(np.cumsum(key.view(np.uint64)))
            columns.append(rest)
        ends = np.cumsum([len(k) for k in keys])[:-1]
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        often = np.diff(new, append=len(key))
        rank = np.empty(len(key), dtype=np.int64)
        rank[order] = np.repeat(np.arange(len(new)), often)
        sums = [np.add.reduceat(np.concatenate(c)[order], new) for c in zip(*columns)]
        if kind % 2:
            answer = [sums[1][rank], sums[2][rank], retained(*sums)[rank]]
        else:
            state = np.where(often == 1, ALONE, 0)[rank]
            state[order[new]] |= OWNER
            answer = [rank, sums[0][rank], state]
        split = [np.split(x, ends) for x in answer]
        if not kind % 2:
            split[0] = [np.diff(x, prepend=0) for x in split[0]]
        data = [[chunks.packed(x, 8) for x in own] for own in zip(*split)]
        n = len(data)
        tokens, known = (int(sums[0].sum()), int((sums[0] > 0).sum())) if kind == 0 else (0, 0)
        out = [table.column("chunk").combine_chunks(), [kind] * n, [bucket] * n, data, [tokens] + [0] * (n - 1), [known] + [0] * (n - 1)]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["chunk", "kind", "bucket", "data", "tokens", "known"])

    return chunks.written(blocks.groupBy("kind", "bucket").applyInArrow(run, f"{BLOCK_SCHEMA}, tokens long, known long"), "suffix-tree-figures")


@dataclass
class Strings:
    """The distinct strings of some number of words in a chunk, sorted by key (words: as the chunk lists them)."""

    key: np.ndarray
    #: The string that ends at each place, -1 for none.
    code: np.ndarray
    #: Its occurrences in the chunk's training documents; after the answer those in all of them.
    n: np.ndarray
    #: The strings that are sent to buckets, by key.
    sent: np.ndarray
    #: The string without its last word, and one place where it ends.
    context: np.ndarray
    place: np.ndarray
    alone: np.ndarray
    owner: np.ndarray
    #: Bucket and rank in it, of the strings that are sent.
    number: np.ndarray | None = None
    #: As contexts: whether retained, and the mass handed on.
    kept: np.ndarray | None = None
    handed: np.ndarray | None = None


class Sight:
    """A chunk's places (an end before each document, then its tokens), its strings and what the buckets said of them."""

    def __init__(self, rows: pa.Table, least: int, bits: int) -> None:
        values = lambda name: rows.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.chunk, self.least, self.bits = rows.column("chunk")[0].as_py(), least, bits
        self.sizes = values("sizes").astype(np.int64)
        found = [t for _, _, t, _ in pieces(self.sizes, chunks.unpacked(rows.column("tokens")[0].as_py()))]
        tokens = np.concatenate(found)
        self.edges = np.cumsum([0, *map(len, found)])
        self.heads = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.first = np.zeros(len(tokens), dtype=bool)
        self.first[self.heads] = True
        self.learnt = np.repeat(~values("held").astype(bool), self.sizes + 1) & ~self.first
        key = values("words").view(np.uint64)
        n, nothing = np.bincount(tokens[self.learnt], minlength=len(key)), np.zeros(0, dtype=np.int64)
        self.levels = [Strings(key, tokens, n, np.argsort(key), nothing, nothing, np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool))]

    def lengthen(self) -> None:
        """Find the strings of one word more, with their occurrences in the chunk. Those of two words are sent before words are counted, so all are."""
        below, word = self.levels[-1], self.levels[0]
        ok = below.code >= 0
        if below is not word:
            ok[ok] = below.n[below.code[ok]] >= self.least
        ok[1:] &= ok[:-1].copy()
        at = np.flatnonzero(ok & ~self.first).astype(np.int32)
        key = words.chain(below.key[below.code[at - 1]], word.key[word.code[at]])
        order = np.argsort(key)
        key, at = key[order], at[order]
        del order
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        new = np.flatnonzero(fresh)
        full = np.full(len(ok), -1, dtype=np.int32)
        full[at] = np.cumsum(fresh, dtype=np.int32) - 1
        n = np.add.reduceat(self.learnt[at], new, dtype=np.int64) if len(new) else np.zeros(0, dtype=np.int64)
        key, place = key[new], at[new]
        context = below.code[place - 1]
        sent = np.flatnonzero(~below.alone[context] & ~below.alone[below.code[place]]) if below is not word else np.arange(len(key))
        self.levels.append(Strings(key, full, n, sent.astype(np.int32), context, place, np.ones(len(key), dtype=bool), np.ones(len(key), dtype=bool)))

    def counts(self, level: int) -> pa.Table:
        """The blocks of a level's strings with their occurrences."""
        own = self.levels[level]
        key = own.key[own.sent]
        return bucketed(self.chunk, 2 * level, (key >> np.uint64(64 - self.bits)).astype(np.int64), key, [own.n[own.sent]])

    def counted(self, level: int, blocks: list[tuple[int, list[bytes]]]) -> None:
        """Take the answer: counts of the whole corpus."""
        own = self.levels[level]
        found = [(b, *(chunks.unpacked(x, 8) for x in data)) for b, data in blocks]
        joined = lambda parts: np.concatenate([np.zeros(0, dtype=np.int64), *parts])
        own.number = joined((np.int64(b) << 40) + np.cumsum(r) for b, r, _, _ in found)
        own.n[own.sent] = joined(n for _, _, n, _ in found)
        state = joined(s for *_, s in found)
        own.alone[own.sent], own.owner[own.sent] = state & ALONE > 0, state & OWNER > 0

    def root(self, unit: int) -> np.ndarray:
        """The probability of each place's token by words alone."""
        word = self.levels[0]
        return ((word.n + 1.0) / unit)[word.code]

    def asked(self, level: int) -> np.ndarray:
        """Which of the strings that were sent are contexts that other chunks hold too."""
        own = self.levels[level]
        return ~own.alone[own.sent] & (own.n[own.sent] >= self.least)

    def sums(self, level: int, p: np.ndarray, alone: bool) -> list[np.ndarray]:
        """For each context of a level, of those in this chunk alone or of the others, its occurrences, and number, occurrences, gain and
        shorter prediction of the marked next words that this chunk owns. ``p``: the shorter context's probability at each place."""
        own, longer = self.levels[level], self.levels[level + 1]
        mine = np.flatnonzero(longer.owner & (longer.n >= self.least) & (own.alone[longer.context] == alone)).astype(np.int32)
        marked, share, total_gain, parts = (np.zeros(len(own.n), dtype=np.int64) for _ in range(4))
        for start in range(0, len(mine), PIECE):
            at = mine[start : start + PIECE]
            context, n, short = longer.context[at], longer.n[at], p[longer.place[at]]
            gain = n * np.rint(np.log(n / own.n[context] / short) * LOG_STEPS).astype(np.int64)
            np.add.at(marked, context, 1)
            np.add.at(share, context, n)
            np.add.at(total_gain, context, gain)
            if self.least > 1:
                # Without a remainder, as where every string counts, the shorter prediction is not asked for.
                np.add.at(parts, context, np.rint(short * P_STEPS).astype(np.int64))
        return [np.where(own.owner, own.n, 0), marked, share, total_gain, parts]

    def contexts(self, level: int, p: np.ndarray) -> pa.Table:
        """The blocks of a level's contexts with their sums."""
        own = self.levels[level]
        asked = self.asked(level)
        number, at = own.number[asked], own.sent[asked]
        return bucketed(self.chunk, 2 * level + 1, number >> 40, number, [x[at] for x in self.sums(level, p, alone=False)])

    def tested(self, level: int, blocks: list[tuple[int, list[bytes]]], p: np.ndarray) -> None:
        """Take the answer on contexts, and change the probability of each place's token to the one with them."""
        own, longer = self.levels[level], self.levels[level + 1]
        sums = self.sums(level, p, alone=True)
        marked, share = sums[1:3]
        own.kept = np.zeros(len(own.n), dtype=bool)
        for start in range(0, len(own.n), PIECE):
            part = slice(start, start + PIECE)
            own.kept[part] = retained(*(x[part] for x in sums)) & (own.n[part] >= self.least)
        del sums
        found = [[chunks.unpacked(x, 8) for x in data] for _, data in blocks]
        at = own.sent[self.asked(level)]
        for to, k in ((marked, 0), (share, 1), (own.kept, 2)):
            to[at] = np.concatenate([np.zeros(0, dtype=np.int64), *(f[k] for f in found)])
        own.handed = 1.0 - (share - DISCOUNT * marked) / np.maximum(own.n, 1)
        for start, end in zip(self.edges, self.edges[1:]):
            at = np.arange(start + 1, end)
            at = at[~self.first[at] & (own.code[at - 1] >= 0)]
            at = at[own.kept[own.code[at - 1]]]
            context, string = own.code[at - 1], longer.code[at]
            n = np.zeros(len(at))
            seen = string >= 0
            n[seen] = longer.n[string[seen]]
            p[at] = np.where(n >= self.least, n - DISCOUNT, 0.0) / own.n[context] + own.handed[context] * p[at]


def sight(rows: pa.Table, figures: pa.Table, least: int, bits: int, unit: int, depth: int, tested: int) -> tuple[Sight, np.ndarray]:
    """A chunk with all counts that came back (of strings up to ``depth`` + 1 words), and the probabilities by contexts of up to ``tested`` words."""
    blocks: dict[int, list[tuple[int, list[bytes]]]] = {}
    figures = figures.select(["kind", "bucket", "data"]).sort_by([("kind", "ascending"), ("bucket", "ascending")])
    for row in figures.to_pylist():
        blocks.setdefault(row["kind"], []).append((row["bucket"], row["data"]))
    own = Sight(rows, least, bits)
    for level in range(depth + 1):
        if level:
            own.lengthen()
        own.counted(level, blocks.pop(2 * level, []))
    p = own.root(unit)
    for level in range(tested):
        own.tested(level, blocks.pop(2 * level + 1, []), p)
    return own, p


def next_blocks(level: int, least: int, bits: int, unit: int, depth: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What a chunk sends once strings of ``level`` + 2 words are counted: sums of the contexts before their last words, and the next level's strings."""

    def run(rows: pa.Table, figures: pa.Table) -> pa.Table:
        own, p = sight(rows, figures, least, bits, unit, level + 1, level)
        out = [own.contexts(level, p)]
        if level + 1 < depth:
            own.lengthen()
            out.append(own.counts(level + 2))
        return pa.concat_tables(out)

    return run


def grow(held: DataFrame, least: int = LEAST, depth: int = DEPTH) -> tuple[DataFrame, int, int, int]:
    """The tree over all strings of the chunks' training documents: what the buckets answered each chunk, the bits of a bucket's number,
    and the occurrences and number of all words."""
    size = held.select(F.aggregate("sizes", F.lit(0).cast("long"), lambda total, x: total + x).alias("n")).agg(F.sum("n")).first()[0] or 0
    bits = max(FEWEST, math.ceil(math.log2(max(size, 1) / BUCKET)))
    columns = ["chunk", "held", "sizes", "tokens", "words"]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                own = Sight(pa.Table.from_batches([batch.slice(at, 1)]), least, bits)
                yield from own.counts(0).to_batches()
                if depth:
                    own.lengthen()
                    yield from own.counts(1).to_batches()

    answers = [meet(held.select(*columns).mapInArrow(start, BLOCK_SCHEMA))]
    tokens, known, _ = chunks.total(answers[0], "tokens", "known")
    unit = tokens + known + 1
    for level in range(depth):
        answers.append(meet(chunks.with_figures(held.select(*columns), union(answers), next_blocks(level, least, bits, unit, depth), BLOCK_SCHEMA)))
    return union(answers), bits, tokens, known


def union(answers: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, (a.select("chunk", "kind", "bucket", "data") for a in answers))


def scores(docs: DataFrame, least: int = LEAST, depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document (doc_id, text)."""
    held = chunked(docs)
    figures, bits, total, known = grow(held, least, depth)
    unit = total + known + 1
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(rows: pa.Table, figures: pa.Table) -> pa.Table:
        own, p = sight(rows, figures, least, bits, unit, depth, depth)
        word = own.levels[0]
        seen = (word.n[word.code] > 0) & ~own.first
        found = [np.add.reduceat(seen.astype(np.int64), own.heads)]
        for x in (own.root(unit), p):
            log = np.log10(x)
            log[own.heads] = 0.0
            found.append(np.add.reduceat(log, own.heads))
        n = len(own.sizes)
        row = rows.select(["ids", "held"]).to_pylist()[0]
        columns = [row["ids"], row["held"], own.sizes, found[0], np.full(n, total), *found[1:]]
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        kinds = [rows.schema.field("ids").type.value_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.with_figures(held.select("chunk", "ids", "held", "sizes", "tokens", "words"), figures, run, schema)
