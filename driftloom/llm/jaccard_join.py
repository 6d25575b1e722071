"""Exact Jaccard join of documents on five-word shingles: a size-aware heavy-light join.

Two documents link when ``100 * intersection >= 75 * union`` of their shingle sets. Sets are ordered by one order for all: shingles
in no long list first, by hash, then the frequent ones, rarest first. Two sets that link share ``c = ceil(0.75 * n)`` shingles at
least, so

* small (light) sets enumerate the subsets of ``K`` shingles of their first ``n - c + K``: two small sets that link share a subset;
* large (heavy) sets read the inverted lists of their first ``n - c + 1`` shingles, where every set large enough to be their
  partner stands, and count what they share: a count that can't reach the needed overlap any more ends a pair exactly;
* a large set also lists every shingle whose hash is below ``CUT``. One that links has some of these in lists (at most the rest can lie
  beyond the cut), so sets that meet others in too few lists leave, such as a long text with one common passage. Few stay; they are
  read whole, and one with less than ``c`` of *all* its shingles in lists leaves as well, such as a much edited copy;
* the size where light ends is the one of least cost: subsets written, against list entries written and met.

What links is found whole: no list, partner or candidate is cut off. Three things keep it from growing with the square of a group:

* equal sets are one class from the start, so copies are never compared;
* before the join proper, two rounds compare each class with one leader of the lists it shares most and merge what links. The join
  then only makes pairs of *different* components, so a large group of near copies makes none;
* shingles in many documents come last in the order, so a common passage is in a prefix only if it is most of a document.

Hashes have 64 bits: of N distinct shingles or sets some two agree with a chance of N * N / 2**65.

Null, empty and white-space texts have the empty set and link with nothing. Repeated rows are copies. A document without an id has
no component (null). Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.llm import words
from driftloom.llm.components import components
from driftloom.llm.meeting import meet
from driftloom.session import reliable_checkpoint

SHINGLE, K = 5, 2

#: A shingle is frequent in a batch of documents if it is in so many of them; frequent overall if in this share of all classes.
#: So there are at most ``mean set size * FREQUENT`` frequent shingles, whatever the size of the corpus.
BATCH_LEAST, FREQUENT = 4, 2000

#: The share of hashes below which a large set lists all its shingles: some more than its first quarter.
CUT = 0.3

#: Entries of a block's run at most, and shingles whose entries share a bucket, about: both bound a task's memory, whatever the corpus.
BLOCK_ENTRIES, BUCKET_SHINGLES = 500_000, 500_000

#: Sets of so many shingles find their leader by a fourth of their lists.
LARGE = 64

LOW = np.uint64(0xFFFFFFFF)

#: Sizes at which light sets may end.
BOUNDARIES = (0, 4, 6, 8, 12, 16, 24, 32, 48, 64)


def needed(n):
    """The least overlap of a set of n shingles with any partner."""
    return (3 * n + 3) // 4


def shingle_sets(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for part in words.parts(texts):
        value, ends = words.hash_words(part)
        grams = words.window_hashes(value, SHINGLE)
        start = 0
        for end in ends:
            n = end - start
            if n >= SHINGLE:
                yield np.unique(grams[start : end - SHINGLE + 1])
            elif n:
                whole = value[start : start + 1]
                for at in range(start + 1, end):
                    whole = words.chain(whole, value[at : at + 1])
                yield words.mix(whole + np.uint64(n))
            else:
                yield np.zeros(0, dtype=np.uint64)
            start = end


def class_of(shingles: np.ndarray) -> int:
    """One 64-bit name for a set."""
    mixed = words.mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    both = words.chain(mixed.sum(dtype=np.uint64, keepdims=True), np.bitwise_xor.reduce(mixed, keepdims=True) + np.uint64(len(shingles)))
    return int(both.astype(np.int64)[0])


def frequent_in(pool: list[np.ndarray], parts: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that ``BATCH_LEAST`` sets or more hold, sorted, and in how many they are; counted in ranges of hashes, as the
    shingles of a whole batch would need the space several times."""
    tokens, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    edges = [np.searchsorted(s, np.arange(1, parts, dtype=np.uint64) * np.uint64(2**64 // parts)).tolist() for s in pool]
    for k in range(parts if pool else 0):
        found, count = np.unique(np.concatenate([s[([0] + e)[k] : (e + [len(s)])[k]] for s, e in zip(pool, edges)]), return_counts=True)
        tokens.append(found[count >= BATCH_LEAST])
        counts.append(count[count >= BATCH_LEAST])
    return np.concatenate(tokens), np.concatenate(counts)


def sets_of(docs: DataFrame) -> DataFrame:
    """(doc_id, n, class) of each document; on one row of each batch also the shingles that are frequent in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, seen, pool = [], [], set(), []
            for s in shingle_sets(words.texts_of(batch.column("text"))):
                sizes.append(len(s))
                names.append(class_of(s) if len(s) else 0)
                if len(s) and names[-1] not in seen:
                    seen.add(names[-1])
                    pool.append(s)
            tokens, counts = frequent_in(pool)
            nulls = [None] * (len(sizes) - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(names, pa.int64()),
                    pa.array([tokens.astype(np.int64), *nulls][: len(sizes)], pa.list_(pa.int64())),
                    pa.array([counts, *nulls][: len(sizes)], pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "class", "tokens", "counts"],
            )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, class long, tokens array<long>, counts array<long>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def with_class(docs: DataFrame, column: str) -> DataFrame:
    """Add the class of each document's shingle set, as ``join`` names it; 0 for documents without words."""
    schema = T.StructType([*docs.schema, T.StructField(column, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [class_of(s) if len(s) else 0 for s in shingle_sets(words.texts_of(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.int64())], schema.names)

    return docs.mapInArrow(run, schema)


def boundary(sizes: Counter, scan: float) -> int:
    """The size where light sets end: least rows written and list entries met. ``scan``: entries met by a listed shingle."""

    def cost(x: int) -> float:
        total = 0.0
        for n, count in sizes.items():
            p = n - needed(n) + K
            total += count * p * (p - 1) / 2 * (n < x) + count * (p - 1) * (1 + scan) * (4 * n >= 3 * x)
        return total

    return min(BOUNDARIES, key=lambda x: (cost(x), x))


def head_of(s: np.ndarray, frequent: np.ndarray, weight: np.ndarray, x: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], int]:
    """What the set ``s`` lists: its subsets of K shingles if it is light, its shingles if it is heavy or may meet one that is, each with a
    mask of those without a frequent shingle, and ``q``, the number of its shingles below the cut, frequent ones aside. The lowest bit
    of a token tells a subset from a shingle. ``frequent``: the frequent shingles, sorted; ``weight``: their counts."""
    n = len(s)
    often = is_frequent(s, frequent)
    last = s[often]
    last = last[np.argsort(weight[np.searchsorted(frequent, last)], kind="stable")] if len(last) else last
    order, rare = np.concatenate((s[~often], last)), n - len(last)
    light = heavy = (s[:0], np.zeros(0, dtype=bool))
    if n < x:
        head = order[: n - needed(n) + K]
        i, j = np.triu_indices(len(head), 1)
        light = words.chain(head[i], head[j]) | np.uint64(1), j < rare
    q = int(np.searchsorted(order[:rare], np.uint64(int(CUT * 2**64))))
    if 4 * n >= 3 * x:
        head = order[: max(q, n - needed(n) + 1)]
        heavy = head & ~np.uint64(1), np.arange(len(head)) < rare
    return light, heavy, q


def is_frequent(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(s), dtype=bool)
    return frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s


def blocks(listed: Iterator[tuple[int, np.ndarray, int]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Entries in blocks: for each run of sets and each bucket of tokens one row, with the entries of the run in the bucket as 32 bits of the
    token and 32 of the class each, and a row that names the run's classes. ``listed``: (class, tokens, spare) of each set, where
    ``spare`` is how many of its tokens may stand in no other list although the set links. ``least`` is how many must stand in one."""
    held: list[tuple[int, np.ndarray, int, bool]] = []
    size = 0
    for name, tokens, spare in listed:
        # Tokens that fall together count once, so a set is never thought to miss more than it does.
        places = np.unique(((tokens >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (tokens & LOW))
        held.append((name, places, len(places) - spare, bool(len(tokens) and tokens[0] & np.uint64(1))))
        size += len(places) + 1
        if size > BLOCK_ENTRIES:
            yield block(held, buckets)
            held, size = [], 0
    if held:
        yield block(held, buckets)


def block(held: list[tuple[int, np.ndarray, int, bool]], buckets: int) -> pa.RecordBatch:
    names = np.array([h[0] for h in held], dtype=np.int64)
    places = np.concatenate([h[1] for h in held])
    pairs = ((places & LOW) << np.uint64(32)) | (np.repeat(names.astype(np.uint64), [len(h[1]) for h in held]) & LOW)
    bucket = (places >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.int32)
    order = np.argsort(bucket, kind="stable")
    used, start = np.unique(bucket[order], return_index=True)
    rows = [part.tobytes() for part in np.split(pairs[order], start[1:])] if len(used) else []
    nulls = [None] * len(rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([*used.tolist(), int(names[0] % buckets)], pa.int32()),
            pa.array([*rows, b""], pa.binary()),
            pa.array([*nulls, names], pa.list_(pa.int64())),
            pa.array([*nulls, np.array([h[2] for h in held])], pa.list_(pa.int32())),
            pa.array([*nulls, [h[3] for h in held]], pa.list_(pa.bool_())),
        ],
        schema=pa.schema([("bucket", pa.int32()), ("pairs", pa.binary()), ("classes", pa.list_(pa.int64())), ("least", pa.list_(pa.int32())), ("subset", pa.list_(pa.bool_()))]),
    )


BLOCK = "bucket int, pairs binary, classes array<long>, least array<int>, subset array<boolean>"


def head_blocks(docs: DataFrame, shared, x: int, buckets: int) -> DataFrame:
    """The entries of all heads, in blocks. Frequent shingles are known to be in several lists and are not written."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, int]]:
        frequent, weight = shared.value
        for batch in batches:
            seen: set[int] = set()
            for s in shingle_sets(words.texts_of(batch.column("text"))):
                n = len(s)
                name = class_of(s) if n > K else 0
                if n <= K or name in seen:
                    continue
                seen.add(name)
                (light, light_rare), (heavy, heavy_rare), _ = head_of(s, frequent, weight, x)
                if n < x:
                    yield name, light[light_rare], len(light) - 1 if light_rare.all() else len(light)
                if 4 * n >= 3 * x:
                    yield name, heavy[heavy_rare], n - needed(n)

    return docs.select("text").mapInArrow(lambda batches: blocks(listed(batches), buckets), BLOCK)


def whole_blocks(sets: DataFrame, shared, buckets: int) -> DataFrame:
    """The entries of all shingles of the sets given, in blocks."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, int]]:
        frequent, _ = shared.value
        for batch in batches:
            for name, raw in zip(batch.column("class").to_pylist(), batch.column("shingles")):
                s = np.frombuffer(raw.as_buffer(), np.uint64)
                yield name, s[~is_frequent(s, frequent)] & ~np.uint64(1), len(s) - needed(len(s))

    return sets.mapInArrow(lambda batches: blocks(listed(batches), buckets), BLOCK)


def meetings(rows: pa.Table) -> pa.Table:
    """Of one bucket: (low, subset, met) for the classes, by their lower 32 bits, that meet another one in lists of the bucket, and
    (low, subset, class, least) for the classes that are named in it."""
    raw = [np.frombuffer(r.as_buffer(), np.uint64) for r in rows.column("pairs")]
    pairs = np.unique(np.concatenate(raw))
    same = pairs[1:] >> np.uint64(32) == pairs[:-1] >> np.uint64(32)
    several = np.zeros(len(pairs), dtype=bool)
    several[1:] |= same
    several[:-1] |= same
    found = pairs[several]
    key, met = np.unique((found & LOW) << np.uint64(1) | (found >> np.uint64(32) & np.uint64(1)), return_counts=True)
    classes = rows.column("classes").combine_chunks().flatten()
    named, none = classes.to_numpy(zero_copy_only=False).astype(np.int64), len(classes)
    subset = rows.column("subset").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(bool)
    return pa.table(
        {
            "low": np.concatenate(((key >> np.uint64(1)).astype(np.int64), named & int(LOW))),
            "subset": np.concatenate(((key & np.uint64(1)).astype(bool), subset)),
            "class": pa.concat_arrays([pa.nulls(len(key), pa.int64()), classes.cast(pa.int64())]),
            "least": pa.concat_arrays([pa.nulls(len(key), pa.int32()), rows.column("least").combine_chunks().flatten().cast(pa.int32())]),
            "met": np.concatenate((met.astype(np.int32), np.zeros(none, dtype=np.int32))),
        }
    )


def hopeful(entries: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``classes`` (class, n, ...) whose sets stand in enough lists to link at all, with ``met``, how many of their
    shingles may have partners.

    Of n shingles at most ``n - needed(n)`` are missing in a partner, so no more may stand in lists without another class. Classes that
    agree in their lower bits, which blocks tell them by, all stay.
    """
    found = entries.groupBy("bucket").applyInArrow(meetings, "low long, subset boolean, class long, least int, met int")
    one = found.groupBy("low", "subset").agg(F.sum("met").alias("met"), F.min("least").alias("least"), (F.min("class") != F.max("class")).alias("several"))
    good = one.filter("several OR met >= least").groupBy("low").agg(F.max(F.expr("IF(several, 2147483647, met - least)")).alias("spare"))
    named = classes.withColumn("low", F.col("class").bitwiseAND(F.lit(int(LOW)))).join(good, "low")
    return named.select(*classes.columns, F.expr("least(n, div(3 * n + 3, 4) + spare)").alias("met"))


def heads_of(sets: DataFrame, shared, x: int) -> DataFrame:
    """(class, q, tokens) of the sets given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, weight = shared.value
        for batch in batches:
            heads = [head_of(np.frombuffer(raw.as_buffer(), np.uint64), frequent, weight, x) for raw in batch.column("shingles")]
            tokens = [np.concatenate((light, heavy)).astype(np.int64) for (light, _), (heavy, _), _ in heads]
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array([h[2] for h in heads], pa.int32()), pa.array(tokens, pa.list_(pa.int64()))], ["class", "q", "tokens"])

    return sets.mapInArrow(run, "class long, q int, tokens array<long>")


def is_subset() -> Column:
    return F.col("token").bitwiseAND(F.lit(1)) == 1


def fetch_sets(docs: DataFrame, ids: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(class, shingles) of the classes that ``ids`` (doc_id, each once) stand for: only their texts are hashed once more."""
    texts = meet(docs.select("doc_id", "text"), ids, "doc_id", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = {class_of(s): s.tobytes() for s in shingle_sets(words.texts_of(batch.column("text")))}
            yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array(list(sets.values()), pa.binary())], ["class", "shingles"])

    found = keep(texts.mapInArrow(run, "class long, shingles binary"))
    # A row that is repeated gives its set again; only such sets are shuffled.
    again = found.groupBy("class").agg(F.count("*").alias("rows")).filter("rows > 1").select("class")
    if again.isEmpty():
        return found
    return keep(meet(found, again, "class", "left_anti").union(meet(found, again, "class", "left_semi").dropDuplicates(["class"])))


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * common >= 75 * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # The few pairs come to the sets, so only sets that are asked for are shuffled.
    left, right = meet(sets.toDF("a", "x"), pairs, "a"), meet(sets.toDF("b", "y"), pairs, "b")
    rows = left.join(right, ["a", "b"]).select("a", "b", "x", "y")
    return rows.mapInArrow(run, "a long, b long")


def sized(a: str, b: str):
    return F.expr(f"4 * {a} >= 3 * {b} AND 4 * {b} >= 3 * {a}")


def leader_pairs(heads: DataFrame, turn: int) -> DataFrame:
    """For each component the pair of classes that joins it with the leader of the lists it shares most, if these are a third of
    its prefix at least. Large sets use every fourth list here: what is not found so is left to ``cross_pairs``.

    First a list's leader is the class with the largest share of its shingles in lists: among edited copies of a text that is the
    text itself, or the least edited copy. In later turns it is one by hash, as what did not link with the first needs another.
    """
    weight = F.xxhash64("class", F.lit(turn)).cast("double") if turn else F.col("met") / F.col("n")
    lists = heads.withColumn("weight", weight).select("component", "class", "n", "weight", F.explode_outer("tokens").alias("token"))
    ranked = lists.filter(F.col("token").isNotNull() & ((F.col("n") < LARGE) | (F.col("token").bitwiseAND(F.lit(6)) == 0)))
    own = ranked.groupBy("token", "component").agg(F.max(F.struct("weight", "class", "n")).alias("it"))
    lead = own.groupBy("token").agg(F.max(F.struct("it.weight", "component", "it")).alias("lead"), F.count("*").alias("size")).filter("size > 1")
    pairs = own.join(lead, "token").filter("component <> lead.component").filter(sized("it.n", "lead.it.n"))
    votes = pairs.groupBy("component", F.col("it.class").alias("a"), F.col("it.n").alias("n"), F.col("lead.it.class").alias("b")).agg(F.count("*").alias("votes"))
    best = votes.groupBy("component").agg(F.max(F.struct("votes", "a", "b", "n")).alias("best"))
    return best.filter(F.expr(f"IF(best.n < {LARGE}, 12, 48) * best.votes >= best.n")).select("best.a", "best.b")


def cross_pairs(heads: DataFrame, x: int) -> DataFrame:
    """All pairs of classes of different components that may link, by size and by what their lists say of the overlap."""
    own = Window.partitionBy("token")
    lists = heads.select("component", "class", F.explode_outer("tokens").alias("token"))
    # Lists of several components, and the sides of the pairs, from one shuffle of the entries.
    ends = lists.withColumn("low", F.min("component").over(own)).withColumn("high", F.max("component").over(own)).filter("token IS NOT NULL AND low <> high")
    lists = meet(ends.select("token", "component", "class"), heads.select("class", "n", "q", "met"), "class")
    side = lambda x: lists.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("n", "q", "met", "component")), F.col("class").alias(x))
    pairs = side("a").join(side("b"), "token").filter("a < b AND component_a <> component_b").filter(sized("n_a", "n_b"))
    # What both have in lists, of all their shingles, can reach the overlap; and both write a subset, or one at least is heavy.
    pairs = pairs.filter(F.expr("7 * least(met_a, met_b) >= 3 * (n_a + n_b)")).filter(is_subset() | (F.greatest("n_a", "n_b") >= x))
    counted = pairs.groupBy(is_subset().alias("subset"), "a", "b", "n_a", "n_b", "q_a", "q_b").agg(F.count("*").alias("common"))
    # Beyond both prefixes lie at most n - p = needed(n) - 1 shingles of the one that ends first.
    reach = F.expr("common + least(n_a - q_a, n_b - q_b, div(3 * greatest(n_a, n_b) + 3, 4) - 1)")
    return counted.filter(F.col("subset") | (reach * 7 >= F.expr("3 * (n_a + n_b)"))).select("a", "b").distinct()


def join(docs: DataFrame, rounds: int = 2, keep: Callable[[DataFrame], DataFrame] = reliable_checkpoint) -> DataFrame:
    """(doc_id, n_shingles, class, component, component_id) of every row of ``docs`` (doc_id, text). ``component`` is the class that names
    the component, also where the same id has several texts."""
    spark = docs.sparkSession
    rows = keep(sets_of(docs))
    classes = keep(rows.filter("n > 0").groupBy("class", "n").agg(F.min("doc_id").alias("first_id")))
    total = classes.agg(F.count("*").alias("classes"), F.sum("n").alias("shingles")).first()
    often = rows.filter("tokens IS NOT NULL").select(F.explode(F.arrays_zip("tokens", "counts")).alias("t")).groupBy(F.col("t.tokens").alias("token")).agg(F.sum("t.counts").alias("count"))
    scan = (often.agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0) / max(1, total["shingles"] or 1)
    least = max(2 * BATCH_LEAST, total["classes"] // FREQUENT)
    frequent = sorted((r["token"] % (1 << 64), r["count"]) for r in often.filter(F.col("count") >= least).collect())
    sizes = Counter({r["size"]: r["count"] for r in classes.groupBy(F.least("n", F.lit(256)).alias("size")).count().collect()})
    x = boundary(sizes, scan)
    shared = spark.sparkContext.broadcast((np.array([f[0] for f in frequent], dtype=np.uint64), np.array([f[1] for f in frequent], dtype=np.int64)))
    buckets = 1 + (total["shingles"] or 0) // BUCKET_SHINGLES
    few = keep(hopeful(head_blocks(docs, shared, x, buckets), classes).drop("met"))
    # What is left is few sets. These are read whole: one that links has ``needed(n)`` of all its shingles in lists.
    sets = fetch_sets(docs, few.select(F.col("first_id").alias("doc_id")).distinct(), keep)
    buckets = 1 + (few.agg(F.sum("n")).first()[0] or 0) // BUCKET_SHINGLES
    fewer = keep(hopeful(whole_blocks(sets, shared, buckets), few).select("class", "n", "met"))
    heads = keep(meet(heads_of(sets, shared, x), fewer, "class"))

    labels, links = None, spark.createDataFrame([], "a long, b long")
    for turn in [*range(rounds), None]:
        named = heads.withColumn("component", F.col("class")) if labels is None else meet(heads, labels.toDF("class", "label"), "class", "left").withColumn("component", F.coalesce("label", "class"))
        pairs = keep(cross_pairs(named, x) if turn is None else leader_pairs(named, turn))
        links = keep(links.union(linked(pairs, sets)))
        labels = components(links)

    named = rows.select("doc_id", "n", "class").join(labels.toDF("class", "label"), "class", "left").withColumn("component", F.coalesce("label", "class"))
    firsts = named.filter("n > 0").groupBy("component").agg(F.min("doc_id").alias("first_id"))
    found = named.join(firsts, "component", "left")
    own = F.when(F.col("n") > 0, F.col("first_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "class", "component", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
