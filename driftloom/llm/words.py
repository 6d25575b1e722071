"""Words of many texts as arrays of 64-bit hashes, for the operators that count or compare them inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: White space that separates words: U+0020 and U+0009 to U+000D.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: The same and every other ASCII character that is no letter and no digit.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

#: Odd constants; any would do.
_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one-to-one."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def chain(seen: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a sequence and one more word; order counts."""
    return mix(seen * _M3 + word)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 20)
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            row = np.full(n, base, dtype=np.uint64)
            row[0] = 1
            _powers.append(np.multiply.accumulate(row))
    return _powers[0], _powers[1]


def hash_words(texts: list[str], between: np.ndarray = SPACES, lower: bool = True, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hashes of all words in order, and for each text where its words end; for each of ``stems`` then those of the words' first
    so many bytes, 0 for words that are not longer. ``between``: the bytes that separate words."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    gap = between[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap))))
    start, end = edge[::2], edge[1::2]
    power, inverse = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[data] if lower else data).astype(np.uint64) * power[: len(data)], out=total[1:])
    value = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw)))
    out = [value, np.searchsorted(start, ends)]
    for size in stems:
        short = end - start <= size
        cut = np.where(short, end, start + size)
        out.append(np.where(short, np.uint64(0), mix((total[cut] - total[start]) * inverse[start] + np.uint64(size + 1000))))
    return tuple(out)


def word_shapes(texts: list[str], shape: np.ndarray, between: np.ndarray = SPACES) -> np.ndarray:
    """Hashes of the words with each byte written as its ``shape``, and runs of one shape as one."""
    data = np.frombuffer(b" ".join(t.encode("utf-8", "replace") for t in texts) + b" ", dtype=np.uint8)
    gap = between[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap))))
    start, end = edge[::2], edge[1::2]
    kind = shape[data]
    first = np.concatenate(([True], (kind[1:] != kind[:-1]) | gap[1:] | gap[:-1]))
    place = np.cumsum(first) - first  # runs before each byte
    power, inverse = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(np.where(first, kind.astype(np.uint64) * power[place], np.uint64(0)), out=total[1:])
    runs = np.append(place, place[-1] + 1)
    return mix((total[end] - total[start]) * inverse[place[start]] + (runs[end] - runs[start]).astype(np.uint64) + np.uint64(99))


def texts_of(column, rows: int = 256) -> Iterator[str | None]:
    """The values of an Arrow column; only a few are Python objects at a time."""
    for start in range(0, len(column), rows):
        yield from column.slice(start, rows).to_pylist()


def parts(texts: Iterable[str | None], size: int = 250_000) -> Iterator[list[str]]:
    """Runs of texts of about ``size`` characters together, nulls as empty, so that a batch's arrays stay small."""
    held: list[str] = []
    chars = 0
    for t in texts:
        held.append(t or "")
        chars += len(held[-1]) + 1
        if chars >= size:
            yield held
            held, chars = [], 0
    if held:
        yield held


def distinct(values: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """One of each value, in no set order. ``scratch``: an integer array with a place for each possible value."""
    place = np.arange(len(values), dtype=scratch.dtype)
    scratch[values] = place
    return values[scratch[values] == place]


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = max(0, len(words) - size + 1)
    out = words[:n]
    for k in range(1, size):
        out = chain(out, words[k : k + n])
    return out
