"""The gate of ``stats.gated_zscore`` inside Arrow batches: which values of a run pass, given what passed before.

All rows of a batch are judged together: assume that all pass, sum up exactly what lies before each row, judge, and repeat with what
passed until nothing changes. Each round makes at least one more row right, usually all, and the result is that of a loop over the rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from driftloom.functions import exact

MIN_SPREAD = 1e-6

#: bucket -> number of values and their parts.
State = dict[int, list[int]]


def added(a: State, b: State) -> State:
    return {at: [x + y for x, y in zip(a.get(at, [0] * 9), b.get(at, [0] * 9))] for at in a.keys() | b.keys()}


@dataclass
class Report:
    """A partition's first and last key, whether it holds one key alone, and what its last key accepted in it."""

    first: str
    last: str
    single: bool
    total: State

    @classmethod
    def read(cls, row) -> Report:
        return cls(row["first"], row["last"], row["single"], {int(at): n for at, n in json.loads(row["total"]).items()})


def carried(reports: dict[int, Report]) -> dict[int, State]:
    """What the first key of each partition has accepted in the partitions before it."""
    out, before, total = {}, None, {}
    for part in sorted(reports):
        own = reports[part]
        out[part] = total if own.first == before else {}
        total = added(out[part], own.total) if own.single else own.total
        before = own.last
    return out


def _starts(batch: pa.RecordBatch, keys: list[str], last: list | None) -> np.ndarray:
    """Whether each row begins a key."""
    new = np.zeros(batch.num_rows, dtype=bool)
    for at, key in enumerate(keys):
        column = batch.column(key)
        if batch.num_rows > 1:
            differs = pc.fill_null(pc.not_equal(column[1:], column[:-1]), False)
            null = pc.is_null(column)
            new[1:] |= np.array(differs) | (np.array(null[1:]) != np.array(null[:-1]))
        new[0] |= last is None or column[0].as_py() != last[at]
    return new


def judge(x: np.ndarray, sigma: np.ndarray, starts: np.ndarray, entry: State, gated: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, State]:
    """How many values passed before each, its zscore (NaN for none), whether it passes, and the state after the last row. ``entry``: state
    before the first row, unless it starts a key. ``gated`` False: all enter the history."""
    good = np.abs(x) < 2.0**480
    at, parts = exact.split(np.where(good, x, 0.0))
    parts = np.concatenate((np.ones((len(x), 1), dtype=np.int64), parts), axis=1)
    segment = np.cumsum(starts)
    begin = np.concatenate((np.flatnonzero(starts), [len(x)])) if starts[0] else np.concatenate(([0], np.flatnonzero(starts), [len(x)]))
    of = segment - segment[0]
    own = [] if starts[0] else entry
    buckets = sorted(set(np.unique(at[good]).tolist()) | set(own))
    passed = good.copy()

    def before(accepted: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for b in buckets:
            add = np.where((accepted & (at == b))[:, None], parts, 0)
            total = np.concatenate((np.zeros((1, 9), dtype=np.int64), np.cumsum(add, axis=0)))
            run = total - total[begin[np.append(of, of[-1])]]
            if b in own:
                run[: begin[1]] += np.array(own[b])
                if len(begin) == 2:
                    run[-1] += np.array(own[b])
            yield b, run

    while True:
        n, s, ss = np.zeros(len(x), dtype=np.int64), np.zeros(len(x)), np.zeros(len(x))
        state: State = {}
        for b, run in before(passed):
            value, square = exact.read_parts(b, run[:-1, 1:])
            n, s, ss = n + run[:-1, 0], s + value, ss + square
            if run[-1].any():
                state[b] = run[-1].tolist()
        with np.errstate(all="ignore"):
            variance = np.maximum((ss - s * s / n) / (n - 1), 0.0)
            z = np.where(good & (n >= 2), np.abs(x - s / n) / np.maximum(np.sqrt(variance), MIN_SPREAD), np.nan)
        valid = ~(z > sigma)
        accepts = good & (valid if gated else True)
        if np.array_equal(accepts, passed):
            return n, z, valid, state
        passed = accepts


def _walk(batches: Iterator[pa.RecordBatch], keys: list[str], value: str, entries: dict[int, State], gated: bool) -> Iterator[tuple]:
    """Each batch of a partition with its verdicts, and the state, start marks and keys seen so far."""
    last, state = None, {}
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("_part")[0].as_py()
        starts = _starts(batch, keys, last)
        if last is None and part in entries:
            starts[0], state = False, entries[part]
        x = batch.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False)
        n, z, valid, state = judge(x, batch.column("_sigma").to_numpy(zero_copy_only=False), starts, state, gated)
        last = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
        yield part, batch, n, z, valid, state, starts, last


def reported(held: DataFrame, keys: list[str], value: str, entries: dict[int, State]) -> DataFrame:
    """(part, first, last, single, total) of every partition. One that starts without an entry and holds one key reports ungated totals."""
    shared = held.sparkSession.sparkContext.broadcast(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first, changes, out = shared.value, None, 0, None
        ungated: State = {}
        for part, batch, _, _, _, state, starts, last in _walk(batches, keys, value, own, True):
            if first is None:
                first = json.dumps([batch.column(k)[0].as_py() for k in keys], default=str)
                entry = own.get(part, {})
            else:
                changes += int(starts[0])
            changes += int(starts[1:].sum())
            if part not in own and not changes:
                x = batch.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False)
                ungated = judge(x, np.full(len(x), np.inf), np.zeros(len(x), dtype=bool), ungated, False)[3]
            out = part, json.dumps(last, default=str), state
        if out:
            part, last_key, state = out
            single = changes == 0
            total = state if not single else ungated if part not in own else added(state, {at: [-v for v in n] for at, n in entry.items()})
            total = {at: n for at, n in total.items() if any(n)}
            yield pa.RecordBatch.from_pylist([{"part": part, "first": first, "last": last_key, "single": single, "total": json.dumps(total)}])

    return held.mapInArrow(run, "part long, first string, last string, single boolean, total string")


def verdicts(held: DataFrame, columns: list[str], keys: list[str], value: str, entries: dict[int, State]) -> DataFrame:
    """``columns`` with prior_n, zscore and valid."""
    shared = held.sparkSession.sparkContext.broadcast(entries)
    schema = held.select(*columns).schema.add("prior_n", "long").add("zscore", "double").add("valid", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, batch, n, z, valid, *_ in _walk(batches, keys, value, shared.value, True):
            out = [*(batch.column(c) for c in columns), pa.array(n), pa.array(z, mask=np.isnan(z)), pa.array(valid)]
            yield pa.RecordBatch.from_arrays(out, schema.names)

    return held.mapInArrow(run, schema)
