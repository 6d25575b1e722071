"""The token bucket inside Arrow batches, in whole numbers: one bucket, and what a run of requests does to every level at once.

A level is counted in units so small that a microsecond's refill, the capacity and what is asked are whole numbers of them; no sum is
rounded, so levels do not depend on where a run is cut.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass, field
from fractions import Fraction


@functools.lru_cache(maxsize=100_000)
def fraction(x: float) -> Fraction:
    """The simple fraction that a double stands for: 1 / 3600.0 is a 3600th."""
    return Fraction(x).limit_denominator(10**9)


@functools.lru_cache(maxsize=100_000)
def terms(capacity: float, rate: float, asked: float, unit: int) -> tuple[int, int, int, int]:
    """Units per token (a multiple of ``unit``), capacity, refill per microsecond and what is asked."""
    c, r, a = fraction(capacity), fraction(rate) / 1_000_000, fraction(asked)
    size = math.lcm(unit, c.denominator, r.denominator, a.denominator)
    return size, int(c * size), int(r * size), int(a * size)


@dataclass
class Bucket:
    """A level in units, how many units a token has, and the time it stands for. A new bucket is full."""

    level: int = 0
    unit: int = 0
    last: int = 0

    @classmethod
    def at(cls, tokens: str | float, last: int) -> Bucket:
        """A bucket with a level in tokens, at a time."""
        level = Fraction(tokens)
        return cls(level.numerator, level.denominator, last)

    def take(self, now: int, capacity: float, rate: float, asked: float) -> tuple[bool, float, float]:
        """(allowed, tokens left, seconds to wait) at ``now`` microseconds; only an allowed request takes tokens. Time does not run back."""
        unit, full, refill, want = terms(capacity, rate, asked, max(self.unit, 1))
        if not self.unit:
            self.level, self.last = full, now
        elif unit != self.unit:
            self.level *= unit // self.unit
        self.unit = unit
        self.level = min(full, self.level + max(0, now - self.last) * refill)
        self.last = max(self.last, now)
        if self.level >= want:
            self.level -= want
            return True, self.level / unit, 0.0
        return False, self.level / unit, (want - self.level) / (refill * 1_000_000) if refill else math.inf


@dataclass
class Transfer:
    """The level after a run of requests as a function of the level before it: pieces [start, next start), each either raised or lowered
    by a constant or set to one, in units. Equal neighbours are one piece, so there are about as many as requests fit in a full
    bucket, however long the run. The refill before the first request is left to ``after``."""

    starts: list[int] = field(default_factory=lambda: [0])
    values: list[int] = field(default_factory=lambda: [0])  # at the piece's start
    moves: list[bool] = field(default_factory=lambda: [True])  # whether the level moves with the start level
    unit: int = 1
    first: int | None = None
    last: int = 0

    def step(self, now: int, capacity: float, rate: float, asked: float) -> None:
        """One more request."""
        unit, full, refill, want = terms(capacity, rate, asked, self.unit)
        if unit != self.unit:
            by = unit // self.unit
            self.starts, self.values, self.unit = [s * by for s in self.starts], [v * by for v in self.values], unit
        if self.first is None:
            self.first = self.last = now
        self._map(max(0, now - self.last) * refill, full, want)
        self.last = max(self.last, now)

    def _map(self, refill: int, full: int, asked: int) -> None:
        starts, values, moves = [], [], []

        def add(start: int, value: int, move: bool) -> None:
            if starts and moves[-1] == move and values[-1] + (start - starts[-1] if move else 0) == value:
                return
            starts.append(start)
            values.append(value)
            moves.append(move)

        for k, start in enumerate(self.starts):
            stop = self.starts[k + 1] if k + 1 < len(self.starts) else None
            value, move = self.values[k] + refill, self.moves[k]
            # Where the level reaches the top, and where it reaches what is asked.
            parts = [(start, value, move)]
            if not move or value >= full:
                parts = [(start, min(value, full), move and value < full)]
            elif stop is None or start + (full - value) < stop:
                parts.append((start + (full - value), full, False))
            for n, (s, v, m) in enumerate(parts):
                e = parts[n + 1][0] if n + 1 < len(parts) else stop
                if v >= asked:
                    add(s, v - asked, m)
                elif m and (e is None or s + (asked - v) < e):
                    add(s, v, True)
                    add(s + (asked - v), 0, True)
                else:
                    add(s, v, m)
        self.starts, self.values, self.moves = starts, values, moves

    def after(self, level: Fraction, last: int, capacity: float, rate: float) -> Fraction:
        """The level (in tokens) after the run, from that at ``last``; ``capacity`` and ``rate`` are those of the run's first request."""
        x = min(fraction(capacity), level + max(0, self.first - last) * fraction(rate) / 1_000_000) * self.unit
        k = max(i for i, s in enumerate(self.starts) if s <= x)
        return (self.values[k] + (x - self.starts[k] if self.moves[k] else 0)) / Fraction(self.unit)
