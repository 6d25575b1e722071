"""Keyed state machines over event streams.

Each operator judges a key's rows of a micro-batch in time order and carries the key's state to
the next one. Group sizes are bounded by the admission limit of the source
(``maxFilesPerTrigger``); whole histories are the business of the batch operators.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from driftloom.operators import drift, gate, ratelimit
from driftloom.operators.bucket import Bucket


def _schema(df: DataFrame, **extra: str) -> T.StructType:
    out = T.StructType(list(df.schema))
    for name, kind in extra.items():
        out = out.add(name, kind)
    return out


def _stateful(df: DataFrame, keys: list[str], output: T.StructType, state: str, step: Callable, timeout=None) -> DataFrame:
    return df.groupBy(*keys).applyInPandasWithState(
        step, output, state, "append", timeout or GroupStateTimeout.NoTimeout
    )


def _batch(pdfs: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(pdfs), ignore_index=True).sort_values(order, ignore_index=True)


def _seconds(ts: pd.Series) -> list[float]:
    return [t.timestamp() for t in ts]


class Admission(StatefulProcessor):
    """One domain's bucket: its exact level, the time it stands for, and a timer that forgets it when it would be full again."""

    def __init__(self, columns: list[str], schema: T.StructType, ts: str, row_id: str) -> None:
        # Names are given by place: rows come as named tuples, which know no names that start with a line.
        self.columns, self.schema, self.ts, self.row_id = columns, schema, ts, row_id

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Levels are whole numbers of any size, so they are kept as text.
        self.bucket = handle.getValueState("bucket", "level string, unit string, last bigint")
        self.idle = handle.getValueState("idle", "until bigint")

    def _read(self) -> Bucket:
        if not self.bucket.exists():
            return Bucket()
        level, unit, last = self.bucket.get()
        return Bucket(int(level), int(unit), last)

    def _write(self, bucket: Bucket) -> None:
        self.bucket.update((str(bucket.level), str(bucket.unit), bucket.last))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        bucket, until = self._read(), 0
        # The rows of one domain in one micro-batch, which the source's trigger bounds.
        pdf = pd.concat(list(rows), ignore_index=True).set_axis(self.columns, axis=1).sort_values([self.ts, self.row_id], ignore_index=True)
        out = []
        for ts, capacity, rate, asked, expired in zip(pdf[self.ts], pdf["_capacity"], pdf["_rate"], pdf["_asked"], pdf["_expired"]):
            if expired:
                out.append((False, 0.0, -1.0))
                continue
            out.append(bucket.take(ts.value // 1000, capacity, rate, asked))
            if rate > 0:
                until = max(until, bucket.last // 1000 + math.ceil(capacity / rate * 1000) + 60_000)
        if bucket.unit:
            self._write(bucket)
        if until:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.idle.update((until,))
            self.handle.registerTimer(max(until, timerValues.getCurrentWatermarkInMs() + 1))
        verdict = pd.DataFrame(out, columns=[n for n, _ in ratelimit.VERDICT])
        yield pd.concat([pdf, verdict], axis=1)[self.schema.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.bucket.clear()
        self.idle.clear()
        return iter([])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for tokens, last in zip(initialState["tokens"], initialState["last"]):
            self._write(Bucket.at(tokens, int(last)))


def admit_stream(
    requests: DataFrame,
    ts: str = "ts",
    row_id: str = "id",
    capacity: float = ratelimit.CAPACITY,
    rate: float = ratelimit.RATE,
    rates: DataFrame | None = None,
    manifests: DataFrame | None = None,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Token bucket per domain: the verdicts of ``ratelimit.admit`` on requests as they arrive. Needs a watermark on ``ts``, and the
    state store that keeps several variables and timers per key (``use_state_variables``).

    ``rates`` and ``manifests`` are the batch operator's tables, joined to the stream; ``initial`` is ``ratelimit.bucket_state`` of a log
    that was judged before. An idle bucket is forgotten when it would be full again, and a minute more; time never runs backwards
    inside a bucket.
    """
    rows = ratelimit.with_terms(requests, rates, manifests, ts, capacity, rate)
    output = _schema(requests, **dict(ratelimit.VERDICT))
    states = None if initial is None else initial.select("domain", "tokens", "last").groupBy("domain")
    return rows.groupBy("domain").transformWithStateInPandas(Admission(rows.columns, output, ts, row_id), output, "append", "EventTime", states)


def use_state_variables(spark: SparkSession) -> None:
    """Choose the state store that ``admit_stream`` needs, before its query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def thrash_stream(
    log: DataFrame,
    ts: str = "ts",
    row_id: str = "id",
    limit: int = drift.THRASH_LIMIT,
    window_hours: int = drift.THRASH_WINDOW_HOURS,
) -> DataFrame:
    """Sticky thrash lock per field; the state holds the repair times of one window and the lock."""
    output = _schema(log, repairs="long", locked="boolean")
    window = window_hours * 3600.0

    def step(key, pdfs, state):
        times, locked = state.get if state.exists else ([], False)
        times, out = list(times), []
        pdf = _batch(pdfs, [ts, row_id])
        for now, reset in zip(_seconds(pdf[ts]), pdf["is_reset"]):
            times = [t for t in times if t >= now - window]
            if reset:
                locked = False
            else:
                times.append(now)
                locked = locked or len(times) >= limit
            out.append((len(times), locked))
        state.update((times, locked))
        yield pdf.assign(repairs=[o[0] for o in out], locked=[o[1] for o in out])

    return _stateful(log, ["domain", "field_name"], output, "times array<double>, locked boolean", step)


def anomaly_stream(values: DataFrame, keys: list[str], sigma: float, ts: str = "ts", row_id: str = "id", value: str = "value") -> DataFrame:
    """Gated anomaly verdicts: only passing values enter the running totals, which are the exact ones of the batch operator."""
    output = _schema(values, prior_n="long", zscore="double", valid="boolean")

    def step(key, pdfs, state):
        totals = {int(at): n for at, n in json.loads(state.get[0]).items()} if state.exists else {}
        pdf = _batch(pdfs, [ts, row_id])
        x = pdf[value].to_numpy(dtype=float)
        n, z, valid, totals = gate.judge(x, np.full(len(x), sigma), np.zeros(len(x), dtype=bool), totals)
        state.update((json.dumps(totals),))
        yield pdf.assign(prior_n=n, zscore=pd.Series(z, index=pdf.index).astype(object).where(~np.isnan(z), None), valid=valid)

    return _stateful(values, keys, output, "totals string", step)


def debounce_stream(verdicts: DataFrame, ts: str = "ts", row_id: str = "id", retries: int = drift.DEBOUNCE_RETRIES) -> DataFrame:
    """Domain breaker: closed until ``retries`` global verdicts since the last reset, then open."""
    output = _schema(verdicts, global_failures="long", state="string")

    def step(key, pdfs, state):
        failures = state.get[0] if state.exists else 0
        pdf = _batch(pdfs, [ts, row_id])
        out = []
        for kind, reset in zip(pdf["drift_type"], pdf["is_reset"]):
            failures = 0 if reset else failures + (kind == "global")
            out.append(failures)
        state.update((failures,))
        yield pdf.assign(global_failures=out, state=["open" if f >= retries else "closed" for f in out])

    return _stateful(verdicts, ["domain"], output, "failures bigint", step)


def retention_stream(records: DataFrame) -> DataFrame:
    """``snapshot_id, expired_at`` once the watermark passes a record's retention.

    ``records``: snapshot_id, quarantined_at (watermarked), retention_expires_at. Quarantining a
    record again moves its expiry.
    """
    output = T.StructType().add("snapshot_id", "string").add("expired_at", "timestamp")

    def step(key, pdfs, state):
        if state.hasTimedOut:
            expires = state.get[0]
            state.remove()
            yield pd.DataFrame({"snapshot_id": [key[0]], "expired_at": [pd.Timestamp(expires, unit="us")]})
            return
        newest = max(max(t.value // 1000 for t in pdf["retention_expires_at"]) for pdf in pdfs)
        if state.exists:
            newest = max(newest, state.get[0])
        state.update((newest,))
        state.setTimeoutTimestamp(max(newest // 1000, state.getCurrentWatermarkMs() + 1))

    return _stateful(records, ["snapshot_id"], output, "expires bigint", step, GroupStateTimeout.EventTimeTimeout)
