"""Token-bucket admission over a request log."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.operators.bucket import Bucket, Transfer
from driftloom.session import reliable_checkpoint

# Fixed defaults: burst, and tokens per second.
CAPACITY, RATE = 10.0, 1.0

VERDICT = (("allowed", "boolean"), ("tokens_left", "double"), ("wait_seconds", "double"))
_TERMS = ["_at", "_capacity", "_rate", "_asked"]


def with_terms(requests: DataFrame, rates: DataFrame | None, manifests: DataFrame | None, ts: str, capacity: float = CAPACITY, rate: float = RATE) -> DataFrame:
    """Add what is in force at a request's time: ``_capacity``, ``_rate``, ``_asked`` and ``_expired``; works on streams, the tables being static.

    ``rates``: domain, capacity, rate (tokens per second) and, if they change, ``valid_from``; the newest one that is not later than the
    request holds. ``manifests``: domain, expires_at. Each may leave a domain out.
    """
    rows = requests.withColumn("_asked", F.col("tokens").cast("double") if "tokens" in requests.columns else F.lit(1.0))
    if rates is not None:
        since = F.col("valid_from") if "valid_from" in rates.columns else F.lit(None).cast("timestamp")
        log = rates.select(F.col("domain").alias("_domain"), F.col("capacity").alias("_c"), F.col("rate").alias("_r"), since.alias("_since"))
        # A log of configuration: one row per change and domain.
        log = log.withColumn("_until", F.lead("_since").over(W.partitionBy("_domain").orderBy(F.col("_since").asc_nulls_first())))
        begun, ended = F.col("_since").isNull() | (F.col("_since") <= F.col(ts)), F.col("_until") <= F.col(ts)
        rows = rows.join(log, (F.col("domain") == F.col("_domain")) & begun & ~F.coalesce(ended, F.lit(False)), "left")
        rows = rows.withColumns({"_capacity": F.coalesce("_c", F.lit(capacity)), "_rate": F.coalesce("_r", F.lit(rate))}).drop("_domain", "_c", "_r", "_since", "_until")
    else:
        rows = rows.withColumns({"_capacity": F.lit(capacity), "_rate": F.lit(rate)})
    if manifests is None:
        return rows.withColumn("_expired", F.lit(False))
    until = manifests.groupBy(F.col("domain").alias("_domain")).agg(F.max("expires_at").alias("_until"))
    rows = rows.join(until, F.col("domain") == F.col("_domain"), "left")
    return rows.withColumn("_expired", F.coalesce(F.col(ts) > F.col("_until"), F.lit(False))).drop("_domain", "_until")


def admit(
    requests: DataFrame,
    rates: DataFrame | None = None,
    manifests: DataFrame | None = None,
    ts: str = "ts",
    row_id: str = "id",
    partitions: int | None = None,
) -> DataFrame:
    """Adds allowed, tokens_left and wait_seconds to requests (domain, ts, id, optional tokens).

    Terms are those of ``with_terms``; a request after its manifest's expiry is refused with wait -1 and leaves the bucket alone.

    Every verdict depends on the ones before it. Requests are range-partitioned by domain and time, so that a domain which never
    pauses is spread over as many partitions as its requests fill. A partition that one domain fills from end to end reports what it does
    to *every* level it may start with (``bucket.Transfer``, a few pieces); the driver runs the levels through these reports, one short row per
    partition, and each partition is then judged once from its true level. Levels are exact, so the answer is the one pass's, for any
    number of partitions. Rows pass through Arrow batches with the bucket carried along; no group is held in memory.
    """
    rows = with_terms(requests, rates, manifests, ts)
    refused = rows.where("_expired").select(*requests.columns, F.lit(False).alias("allowed"), F.lit(0.0).alias("tokens_left"), F.lit(-1.0).alias("wait_seconds"))
    open_ = rows.where("not _expired").withColumn("_at", F.unix_micros(F.col(ts))).drop("_expired")
    order = ["domain", ts, row_id]
    spread = open_.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    held = reliable_checkpoint(spread.withColumn("_part", F.spark_partition_id()))
    entries = carried(sorted(reported(held).collect(), key=lambda r: r["part"]))
    judged = verdicts(held, requests.columns, T.StructType(list(requests.schema)), entries)
    return judged.unionByName(refused) if manifests is not None else judged


def _runs(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(batch.column("domain").to_pylist(), *(batch.column(c).to_pylist() for c in _TERMS))


def reported(held: DataFrame) -> DataFrame:
    """Of each partition its first and last domain, and either the last domain's bucket (if it begins there) or, where one domain fills
    the partition, its transfer and the terms of its first request."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, domain, start, bucket, transfer = None, None, None, None, Bucket(), Transfer()
        for batch in batches:
            for name, now, capacity, rate, asked in _runs(batch):
                if part is None:
                    part, first, domain, start = batch.column("_part")[0].as_py(), name, name, (capacity, rate)
                elif name != domain:
                    domain, bucket, transfer = name, Bucket(), None
                bucket.take(now, capacity, rate, asked)
                if transfer is not None:
                    transfer.step(now, capacity, rate, asked)
        if part is not None:
            whole = None if transfer is None else json.dumps([asdict(transfer), *start])
            row = [part, first, domain, f"{bucket.level}/{bucket.unit}", bucket.last, whole]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["part", "first", "last", "level", "at", "transfer"])

    return held.select("domain", *_TERMS, "_part").mapInArrow(run, "part long, first string, last string, level string, at long, transfer string")


def carried(reports: list) -> dict[int, tuple[str, int]]:
    """Level (in tokens) and time of the bucket that each partition's first domain brings from the partition before."""
    out, before, state = {}, None, None
    for r in reports:
        goes_on = state is not None and r["first"] == before
        if goes_on:
            out[r["part"]] = (str(state[0]), state[1])
        if goes_on and r["transfer"] is not None:
            own, capacity, rate = json.loads(r["transfer"])
            own = Transfer(**own)
            state = own.after(*state, capacity, rate), max(state[1], own.last)
        else:
            level, unit = map(int, r["level"].split("/"))
            state = Fraction(level, unit), r["at"]
        before = r["last"]
    return out


def verdicts(held: DataFrame, columns: list[str], schema: T.StructType, entries: dict[int, tuple[str, int]]) -> DataFrame:
    shared = held.sparkSession.sparkContext.broadcast(entries)
    for name, kind in VERDICT:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        domain, bucket, begun = None, Bucket(), False
        for batch in batches:
            out = []
            for name, now, capacity, rate, asked in _runs(batch):
                if not begun:
                    entry = shared.value.get(batch.column("_part")[0].as_py())
                    begun, domain, bucket = True, name, Bucket.at(*entry) if entry else Bucket()
                elif name != domain:
                    domain, bucket = name, Bucket()
                out.append(bucket.take(now, capacity, rate, asked))
            found = zip(*out) if out else ([], [], [])
            added = [pa.array(list(v), k) for v, k in zip(found, (pa.bool_(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *added], schema.names)

    return held.mapInArrow(run, schema)


def bucket_state(judged: DataFrame, ts: str = "ts", row_id: str = "id") -> DataFrame:
    """(domain, tokens, last) after a judged log: what a stream goes on from. Requests that were refused for their manifest are no part of it."""
    return judged.where("wait_seconds >= 0").groupBy("domain").agg(
        F.max_by("tokens_left", F.struct(ts, row_id)).alias("tokens"), F.max(F.unix_micros(F.col(ts))).alias("last")
    )
