"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, exact weighted similarity.

Every window of a document that has as many words as a benchmark item gets a 64-bit fingerprint: the sign of the sum, bit by bit,
of its five-word shingles' weighted hashes (running totals make each window a difference of two rows). Shingles weigh what they tell
of an item: log(1 + items / items with it). Fingerprints are cut into 8 blocks of 8 bits. Two that differ in at most ``RADIUS`` = 23
bits differ in at most 2 bits of some block, so a table of each block's values within 2 bits finds every item within the radius:
none is missed. What is found is compared by the exact weighted Jaccard similarity of the shingles, and leaks at 0.75 or more. Equal
fingerprints are expected 11 bits apart at 0.75, 23 is four standard deviations more.

A window that has no shingle of an item of its size can't be similar to one, so only windows with such a shingle are fingerprinted.

Documents are not shuffled; the items are broadcast in blocks of ``BLOCK`` (about), one pass per block, so that a larger benchmark
means more passes. Shingles are counted once over all items, so neither weights nor leaks depend on the blocks; with each block go
the counts of the shingles that two or more items hold (16 bytes each), as one in a single item, or in none, weighs log(1 + items).

A-Z are lower-cased; words are runs without white space. A text of fewer words than an item is one window. Null and empty texts
have no leaks, nor have items without words; repeated rows are judged each; an item id of null is reported as such.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.llm import words
from driftloom.llm.bpe import slices
from driftloom.llm.jaccard_join import SHINGLE

BLOCK, RADIUS, SIMILARITY = 20_000, 23, 0.75

BLOCKS, NEAR = 8, RADIUS // 8

LEAK = pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("n_words", pa.int32()), ("hamming", pa.int32()), ("similarity", pa.float64())])

#: The values of a block's 8 bits that are within NEAR bits of zero.
_MASKS = np.array([sum(1 << b for b in bits) for k in range(NEAR + 1) for bits in itertools.combinations(range(8), k)], dtype=np.uint8)


def shingles(value: np.ndarray) -> np.ndarray:
    """Shingle hashes of a run of words, in order; fewer words than a shingle has are one."""
    if len(value) >= SHINGLE:
        return words.window_hashes(value, SHINGLE)
    whole = value[:1]
    for at in range(1, len(value)):
        whole = words.chain(whole, value[at : at + 1])
    return words.mix(whole + np.uint64(len(value))) if len(value) else value


class Items:
    """A block of benchmark items: weights of shingles, and for each size the fingerprints with their block tables.

    ``total``: the items of all blocks. ``shared``: the shingles that two or more of them hold, in order, and how many hold each.
    """

    def __init__(self, rows: list[tuple[int, str]], total: int = 0, shared: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0))) -> None:
        own: list[tuple[int, int, np.ndarray]] = []
        for part in words.parts(text for _, text in rows):
            value, ends = words.hash_words(part)
            for a, b in zip([0, *ends[:-1]], ends):
                own.append((rows[len(own)][0], int(b - a), shingles(value[a:b])))
        own = [x for x in own if x[1]]
        self.known = np.unique(np.concatenate([x[2] for x in own])) if own else np.zeros(0, np.uint64)
        self.shared, self.weight, self.other = shared[0], np.log1p(total / shared[1]), float(np.log1p(total))
        self.by_size: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        sizes_of: dict[int, set[int]] = defaultdict(set)
        for item, size, found in own:
            self.by_size[size].append((item, found))
            for at in self.known_at(found)[0].tolist():
                sizes_of[at].add(size)
        #: The sizes of the items that hold a known shingle.
        self.sizes = [sorted(sizes_of[at]) for at in range(len(self.known))]
        self.prints = {size: np.concatenate([self.prints_of(s, len(s)) for _, s in found]) for size, found in self.by_size.items()}
        self.tables = {size: self.table(p) for size, p in self.prints.items()}

    def known_at(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each shingle its place among the items' shingles, and whether it is one."""
        at = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
        return at, self.known[at] == found

    def weights(self, found: np.ndarray) -> np.ndarray:
        if not len(self.shared):
            return np.full(len(found), self.other)
        at = np.minimum(np.searchsorted(self.shared, found), len(self.shared) - 1)
        return np.where(self.shared[at] == found, self.weight[at], self.other)

    def prints_of(self, found: np.ndarray, size: int, starts: np.ndarray | None = None) -> np.ndarray:
        """Fingerprints of the windows of ``size`` shingles."""
        signs = np.unpackbits(words.mix(found).view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64) * 2 - 1
        total = np.zeros((len(found) + 1, 64))
        np.cumsum(signs * self.weights(found)[:, None], axis=0, out=total[1:])
        starts = np.arange(len(found) - size + 1) if starts is None else starts
        # A tie of sums counts as 0 whatever the rounding.
        return np.packbits(total[starts + size] - total[starts] > 1e-9, axis=1).reshape(-1).view(np.uint64)

    @staticmethod
    def table(prints: np.ndarray) -> np.ndarray:
        """[block, value, item]: whether the item's block is within NEAR bits of the value."""
        out = np.zeros((BLOCKS, 256, len(prints)), dtype=bool)
        for block, values in enumerate(prints.view(np.uint8).reshape(-1, 8).T):
            for mask in _MASKS:
                out[block, values ^ mask, np.arange(len(prints))] = True
        return out

    def near(self, prints: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
        """(window, item, distance) of every item within the radius."""
        table, own = self.tables[size], self.prints[size]
        step = max(1, 4_000_000 // len(own))
        for at in range(0, len(prints), step):
            part = prints[at : at + step]
            found = np.zeros((len(part), len(own)), dtype=bool)
            for block, values in enumerate(part.view(np.uint8).reshape(-1, 8).T):
                found |= table[block, values]
            window, item = np.nonzero(found)
            distance = np.bitwise_count(part[window] ^ own[item])
            for k in np.flatnonzero(distance <= RADIUS):
                yield at + int(window[k]), int(item[k]), int(distance[k])

    def similarity(self, a: np.ndarray, b: np.ndarray) -> float:
        """Weighted Jaccard similarity of two multisets of shingles."""
        value, place = np.unique(np.concatenate((a, b)), return_inverse=True)
        x, y = np.bincount(place[: len(a)], minlength=len(value)), np.bincount(place[len(a) :], minlength=len(value))
        w = self.weights(value)
        return float((w * np.minimum(x, y)).sum() / (w * np.maximum(x, y)).sum())

    def leaks(self, value: np.ndarray) -> list[dict]:
        """The best window of each item that a document's words hold."""
        found = shingles(value)
        at, hit = self.known_at(found)
        places: dict[int, list[int]] = defaultdict(list)
        for place in np.flatnonzero(hit).tolist():
            for size in self.sizes[at[place]]:
                places[size].append(place)
        best: dict[tuple, dict] = {}
        for size, held in places.items():
            items = self.by_size[size]
            width = min(max(1, size - SHINGLE + 1), len(found))
            hits = np.concatenate(([0], np.cumsum(np.bincount(held, minlength=len(found)))))
            starts = np.flatnonzero(hits[width:] > hits[:-width])
            # Prints are made where the hits are: a run of windows at a time, so a long text needs no matrix of its length.
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > width) + 1) if len(starts) else ():
                for chunk in np.array_split(run, -(-len(run) // 20_000)):
                    low, high = chunk[0], chunk[-1] + width
                    prints = self.prints_of(found[low:high], width, chunk - low)
                    for w, i, distance in self.near(prints, size):
                        start, (item, own) = int(chunk[w]), items[i]
                        alike = self.similarity(found[start : start + width], own)
                        if alike >= SIMILARITY and ((size, i) not in best or alike > best[size, i]["similarity"]):
                            best[size, i] = {"item_id": item, "start": start, "n_words": min(size, len(value)), "hamming": distance, "similarity": alike}
        return list(best.values())


def shared_shingles(items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that two or more items hold, in order, and how many items hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                value, ends = words.hash_words(part.column("text").to_pylist())
                own = [np.unique(shingles(value[a:b])) for a, b in zip([0, *ends[:-1]], ends)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], ["shingle"])

    counted = items.select("text").mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").toArrow()
    shingle, n = counted["shingle"].to_numpy().view(np.uint64), counted["n"].to_numpy()
    order = np.argsort(shingle)
    return shingle[order], n[order]


def with_leaks(docs: DataFrame, benchmark: DataFrame, column: str = "leaks") -> DataFrame:
    """Add an array of the leaks of each document: item_id, first word, words, Hamming distance and similarity of the best window.
    A column of that name is replaced."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), "text").filter(F.col("text").rlike(r"[^\x20\x09-\x0d]"))
    total, shared_by = items.count(), shared_shingles(items)
    blocks = max(1, -(-total // BLOCK))
    kept = [c for c in docs.columns if c != column]
    leak = "array<struct<item_id:long,start:int,n_words:int,hamming:int,similarity:double>>"
    out, parts = docs.select(*kept), []
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(Items([tuple(r) for r in rows], total, shared_by))
        parts.append(f"{column}_{k}_" + "_" * max(map(len, kept)))
        out = out.mapInArrow(finder(shared, out.columns), T.StructType([*out.schema.fields, T.StructField(parts[-1], T._parse_datatype_string(leak))]))
    # One order whatever the blocks.
    keyed = F.transform(F.concat(*parts), lambda x: F.struct(x.start.alias("start"), x.item_id.isNull().alias("unnamed"), x.item_id.alias("item_id"), x.n_words.alias("n_words"), x.alias("leak")))
    return out.select(*kept, F.transform(F.array_sort(keyed), lambda x: x.leak).alias(column))


def finder(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                value, ends = words.hash_words([t or "" for t in part.column("text").to_pylist()])
                # Which texts have a shingle of an item at all; a shingle across two texts only costs a second look.
                hit = np.zeros(len(value), dtype=bool)
                grams = words.window_hashes(value, SHINGLE)
                if len(items.known):
                    hit[: len(grams)] = items.known_at(grams)[1]
                count = np.concatenate(([0], np.cumsum(hit)))
                out = []
                for a, b in zip([0, *ends[:-1]], ends):
                    look = len(items.known) and b > a and (b - a < SHINGLE or count[b] > count[a])
                    out.append(items.leaks(value[a:b]) if look else [])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.list_(LEAK))], [*names, "leaks"])

    return run
