"""Importance resampling of documents towards a target text collection.

Features of a text are its runs of one to three words, hashed to ``BUCKETS`` buckets. Bucket counts of the corpus and of the target
give every bucket a gain, the scaled log ratio of its smoothed shares; a document's weight is the sum of gains over its features.
Adding Gumbel noise to the weights and keeping the highest scores draws documents without replacement in proportion to
their likelihood ratio.

Texts are read by Arrow kernels: ``ascii_lower``, ``split_pattern_regex`` and ``list_flatten`` give words, ``dictionary_encode`` their
indices, and shifted indices the pairs and triples, encoded again so that each distinct one is hashed once. The CRC of a run follows
from those of its words, since a CRC is linear: no run is ever written out. Gains are taken per distinct run and summed per segment.

Counting and weighing are one pass each, without shuffles of text; a task gives one row per bucket at most. Ranks come from a range
partition of (score, id) rows that lie in the shared folder. Nothing that grows with the corpus is broadcast or collected:
counts and gains have ``BUCKETS`` rows.

Null and empty texts have no words, no features and the weight 0. Repeated rows are weighed, and drawn, each. A row without an id has no
noise: its score is null, it is neither counted nor drawn. Equal scores go to the smaller id, then to fewer features. An
empty target or corpus counts as zeros in every bucket. Other columns pass through; those named as an output are replaced.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.llm.bpe import slices
from driftloom.llm.ordering import with_places
from driftloom.session import reliable_checkpoint

BUCKETS, LONGEST, LEAST_WORDS, SEED = 10_000, 3, 20, 42
#: What lies between words: every ASCII character that is no letter and no digit (capitals are gone by then).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text whose words share a dictionary.
PART = 4_000_000


@functools.lru_cache(maxsize=4096)
def zeros(n: int) -> np.ndarray:
    """What ``n`` zero bytes do to a CRC-32, as tables [byte of the CRC, its value]."""
    if n == 0:
        return (np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    if n == 1:
        # zlib takes a start value, and inverts the register before and after.
        one = [[zlib.crc32(b"\0", v << 8 * k ^ 0xFFFFFFFF) for v in range(256)] for k in range(4)]
        zero = np.uint32(zlib.crc32(b"\0", 0xFFFFFFFF))
        return np.array(one, dtype=np.uint32) ^ zero
    half = shifted(zeros(n // 2)[None], np.zeros(1024, dtype=np.int64), zeros(n - n // 2).ravel())
    return half.reshape(4, 256)


def shifted(tables: np.ndarray, which: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """Each CRC after as many zero bytes as its table (of ``tables``, by ``which``) stands for."""
    byte = np.uint32(255)
    out = tables[which, 0, crc & byte]
    for k in (1, 2, 3):
        out = out ^ tables[which, k, crc >> np.uint32(8 * k) & byte]
    return out


def runs(texts: pa.Array, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of 1, 2 .. ``longest`` words: the row of every run, which distinct run it is, and the CRC-32 of each distinct run."""
    parts = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), BETWEEN)
    found = pc.list_flatten(parts).dictionary_encode()
    row = pc.list_parent_indices(parts).to_numpy().astype(np.int64)
    at = found.indices.to_numpy().astype(np.int64)
    words = [w.encode() for w in found.dictionary.to_pylist()]
    keep = np.array([bool(w) for w in words], dtype=bool)[at] if words else np.zeros(0, dtype=bool)
    row, at = row[keep], at[keep]
    size = np.array([len(w) + 1 for w in words], dtype=np.int64)
    after = np.array([zlib.crc32(b" " + w) for w in words], dtype=np.uint32)
    lengths, which = np.unique(size, return_inverse=True)
    tables = np.stack([zeros(int(n)) for n in lengths]) if len(lengths) else np.zeros((0, 4, 256), dtype=np.uint32)
    crc = np.array([zlib.crc32(w) for w in words], dtype=np.uint32)
    yield row, at, crc
    before, starts = at, row
    for k in range(1, longest):
        same = starts[: max(0, len(starts) - 1)] == row[k:]
        starts, last = starts[: len(same)][same], at[k:]
        pair = pa.array(before[: len(same)] * max(1, len(words)) + last).filter(pa.array(same)).dictionary_encode()
        one, two = np.divmod(pair.dictionary.to_numpy().astype(np.int64), max(1, len(words)))
        crc = shifted(tables, which[two], crc[one]) ^ after[two]
        index = pair.indices.to_numpy().astype(np.int64)
        yield starts, index, crc
        # The next round extends each run by the word after it: runs and rows stay at the places of their first words.
        before = np.full(len(same), -1, dtype=np.int64)
        before[same] = index
        starts = np.where(same, row[: len(same)], -1)


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts lie in each bucket. Every task adds up its own; ``buckets`` rows reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, text, PART):
                for _, which, crc in runs(part.column(text)):
                    often = np.bincount(which, minlength=len(crc))
                    total += np.bincount(crc % buckets, weights=often, minlength=buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = df.select(text).mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(buckets, dtype=np.int64)
    for r in rows:
        total[r.bucket] = r.n
    return total


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Each bucket's gain, in thousandths of a natural logarithm, rounded down."""
    t, s, n = target.astype(float), corpus.astype(float), float(len(corpus))
    return np.floor(1000.0 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def with_weights(docs: DataFrame, gain: np.ndarray, text: str = "text", names: tuple[str, str, str] = ("n_words", "n_features", "weight")) -> DataFrame:
    """Add the numbers of words and of features, and the sum of their buckets' gains."""
    kept = [c for c in docs.columns if c not in names]
    fields = [docs.schema[c] for c in kept] + [T.StructField(n, T.LongType()) for n in names]
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, text, PART):
                counts, weight = [], np.zeros(part.num_rows, dtype=np.int64)
                for row, which, crc in runs(part.column(text)):
                    ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                    total = np.concatenate(([0], np.cumsum(pc.take(pa.array(own[crc % len(own)]), pa.array(which)).to_numpy())))
                    weight += total[ends[1:]] - total[ends[:-1]]
                    counts.append(np.diff(ends))
                out = [part.column(c) for c in kept] + [pa.array(x) for x in (counts[0], sum(counts), weight)]
                yield pa.RecordBatch.from_arrays(out, [f.name for f in fields])

    return docs.mapInArrow(add, T.StructType(fields))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, fixed by the id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; ``rank`` from 1 where it is drawn, else null.

    Drawn are the highest ``percent`` per hundred of all documents with ``least_words`` or more.
    """
    gain = gains(bucket_counts(target), bucket_counts(docs))
    weighed = with_weights(docs.select("doc_id", "text"), gain).drop("text")
    scored = reliable_checkpoint(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    open_ = F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)
    placed = with_places(scored.filter(open_).withColumn("_falling", -F.col("score")), ["_falling", "doc_id", "n_features"])
    drawn = F.when(F.col("place") < F.floor(F.col("total") * percent / 100), F.col("place") + 1).cast("long")
    ranked = placed.withColumn("rank", drawn).select(*scored.columns, "rank")
    return ranked.unionByName(scored.filter(~open_).withColumn("rank", F.lit(None).cast("long")))


def oracle_sql() -> str:
    """The query as DuckDB SQL; CRC-32 is folded over the bytes of each distinct run."""
    words = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
    return f"""
WITH bytes AS MATERIALIZED (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS step),
texts AS MATERIALIZED (
  SELECT 1 AS side, doc_id AS id, {words} AS w FROM documents UNION ALL SELECT 2, item_id, {words} FROM benchmark),
found AS MATERIALIZED (
  SELECT side, id, unnest(flatten([list_transform(range(1, len(w) + 2 - k), lambda i: array_to_string(w[i:i + k - 1], ' ')) for k in [1, 2, 3]])) AS run FROM texts),
counted AS MATERIALIZED (SELECT side, id, run, count(*) AS n FROM found GROUP BY ALL),
hashed AS MATERIALIZED (
  SELECT run, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(octet_length(encode(run))),
    lambda i: ('0x' || substr(hex(encode(run)), 2 * i + 1, 2))::BIGINT)), lambda x, b: xor(x >> 8, step[1 + (xor(x, b) & 255)])), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT run FROM counted), bytes),
rows AS MATERIALIZED (SELECT side, id, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (run) GROUP BY ALL),
sides AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 2), 0)::DOUBLE AS t FROM rows GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sides) + {BUCKETS}) / ((s + 1) * ((SELECT sum(t) FROM sides) + {BUCKETS}))))::BIGINT AS gain FROM sides),
weights AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM rows JOIN gains USING (bucket) WHERE side = 1 GROUP BY id),
scored AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (id) WHERE side = 1),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS total FROM scored WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * total // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)"""
