"""Exact sums of doubles and of their squares.

Adding doubles rounds at every step, so a total depends on the order and on how rows are cut into tasks. Here a value falls into a
bucket by its size (14 binary places each) and is written there as whole numbers of 28 binary places, its square likewise. Whole numbers
are summed by bucket, which is exact in every order; the double that a total is read as is computed from these sums alone, bucket by
bucket. Equal values therefore give equal totals, bit for bit, however they were partitioned, chunked or merged.

A total holds 2**35 values per bucket. Values that are no finite number, or of a size of ``2**480`` and more, have no parts; binary
places below ``2**-546`` of a value are cut.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Binary places of a bucket, and of a part.
STEP, PLACES = 14, 28
PARTS = ("x0", "x1", "x2", "q0", "q1", "q2", "q3", "q4")

_UNIT, _SPLIT, _LIMIT, _LOWEST = float(1 << PLACES), 134217729.0, 480, -35


def summable(x: Column) -> Column:
    return F.coalesce((F.abs(x) < 2.0**_LIMIT) & ~F.isnan(x), F.lit(False))


def with_parts(df: DataFrame, x: Column) -> DataFrame:
    """Add the bucket ``at`` and the parts of a summable value and of its square."""
    # Where the logarithm rounds does not matter: the parts hold a value beside a bound in both buckets.
    at = F.when(x == 0, _LOWEST).otherwise(F.greatest(F.floor(F.log2(F.abs(x)) / STEP).cast("int"), F.lit(_LOWEST)))
    staged = df.withColumn("at", at)
    half = F.pow(F.lit(2.0), PLACES // 2 - F.col("at") * (STEP // 2))
    staged = staged.withColumn("_y", x * half * half)
    y = F.col("_y")
    # Dekker's product: the square is its rounded value plus the error.
    high = y * _SPLIT - (y * _SPLIT - y)
    staged = staged.withColumns({"_p": y * y, "_high": high, "_low": y - high})
    error = ((F.col("_high") * F.col("_high") - F.col("_p")) + F.col("_high") * F.col("_low") * 2.0) + F.col("_low") * F.col("_low")
    staged = staged.withColumn("_e", error)

    def cut(value: Column, place: int) -> Column:
        """The whole number of ``value`` at one of the places of 28 bits, without what lies above and below."""
        scaled = value / _UNIT**place
        return (scaled if place == 2 else scaled % _UNIT).cast("bigint")

    out = {"x0": (y / _UNIT).cast("bigint"), "x1": cut(y, 0), "x2": cut(y, -1)}
    out |= {f"q{k}": cut(F.col("_p"), 2 - k) + cut(F.col("_e"), 2 - k) for k in range(5)}
    return staged.withColumns(out).drop("_y", "_p", "_e", "_high", "_low")


def totals(df: DataFrame, keys: list[str], last: dict[str, Column]) -> DataFrame:
    """Per key: ``n``, ``totals`` (bucket, number and parts, one entry per bucket) and the columns ``last``, aggregated by both steps.

    ``df`` has one row per value (``n`` = 1) or per earlier bucket. Rows are combined before both shuffles; the second moves one row per
    key and bucket, and a key has some 70 buckets at most, usually one to three.
    """
    sums = [F.sum(c).alias(c) for c in ("n", *PARTS)]
    inner = df.groupBy(*keys, "at").agg(*sums, *[c.alias(name) for name, c in last.items()])
    entry = F.struct("at", "n", *PARTS)
    return inner.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list(entry)).alias("totals"), *[c.alias(name) for name, c in last.items()]
    )


def read(entries: Column, square: bool = False) -> Column:
    """The double of a total of values, or of squares. Entries are in the order of buckets."""

    def add(total: Column, t: Column) -> Column:
        if square:
            inner = t["q0"] * _UNIT + t["q1"] + t["q2"] / _UNIT + (t["q3"] + t["q4"] / _UNIT) / _UNIT / _UNIT
            half = F.pow(F.lit(2.0), t["at"] * STEP - PLACES // 2)
        else:
            inner = t["x0"] * _UNIT + t["x1"] + t["x2"] / _UNIT
            half = F.pow(F.lit(2.0), t["at"] * (STEP // 2) - PLACES // 2)
        return total + inner * half * half

    return F.aggregate(entries, F.lit(0.0), add)


def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each value, and its parts as rows of whole numbers; all values are summable."""
    at = np.maximum(np.where(x == 0, _LOWEST * STEP, np.frexp(x)[1] - 1) // STEP, _LOWEST)
    y = np.ldexp(x, PLACES - STEP * at)
    p = y * y
    high = y * _SPLIT - (y * _SPLIT - y)
    low = y - high
    e = ((high * high - p) + high * low * 2.0) + low * low

    def cut(value: np.ndarray, place: int) -> np.ndarray:
        scaled = value / _UNIT**place
        return (scaled if place == 2 else np.fmod(scaled, _UNIT)).astype(np.int64)

    columns = [(y / _UNIT).astype(np.int64), cut(y, 0), cut(y, -1), *(cut(p, 2 - k) + cut(e, 2 - k) for k in range(5))]
    return at, np.stack(columns, axis=1)


def read_parts(at: int, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What rows of parts of one bucket add to a total of values and to one of squares; the same steps as ``read``."""
    t = parts.astype(float)
    value = t[:, 0] * _UNIT + t[:, 1] + t[:, 2] / _UNIT
    square = t[:, 3] * _UNIT + t[:, 4] + t[:, 5] / _UNIT + (t[:, 6] + t[:, 7] / _UNIT) / _UNIT / _UNIT
    half, whole = 2.0 ** (at * (STEP // 2) - PLACES // 2), 2.0 ** (at * STEP - PLACES // 2)
    return value * half * half, square * whole * whole
