"""Running and sliding aggregates whose keys may be arbitrarily hot.

A plain window puts all rows of a key into one task. Here every key is cut into time chunks:
the chunk totals are combined per key (one small row per chunk), and the rows only ever meet
the other rows of their own chunk. The rows are shuffled once, on ``keys + chunk``, and both
the join with the carried totals and the window inside the chunk use that partitioning.

Keys must not be null. ``order`` must be a total order that starts with the time column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK_SECONDS = 3600


def with_chunk(df: DataFrame, ts: str, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.unix_seconds(F.col(ts)) / chunk_seconds).cast("bigint"))


def running(
    df: DataFrame,
    keys: list[str],
    ts: str,
    order: list[str],
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    include_current: bool = True,
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Add running sums (0 before the first value) and running maxima (null before it)."""
    sums, maxes = sums or {}, maxes or {}
    fold = {**{n: F.sum for n in sums}, **{n: F.max for n in maxes}}
    rows = with_chunk(df, ts, chunk_seconds).withColumns(
        {f"_in_{n}": c for n, c in {**sums, **maxes}.items()}
    )
    totals = rows.groupBy(*keys, "_chunk").agg(*[f(f"_in_{n}").alias(f"_in_{n}") for n, f in fold.items()])
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        *keys, "_chunk", *[f(f"_in_{n}").over(before).alias(f"_carry_{n}") for n, f in fold.items()]
    )
    inside = (
        W.partitionBy(*keys, "_chunk")
        .orderBy(*order)
        .rowsBetween(W.unboundedPreceding, 0 if include_current else -1)
    )
    merged = rows.join(carry, [*keys, "_chunk"], "left")
    out = {}
    for n, f in fold.items():
        own = f(f"_in_{n}").over(inside)
        if n in sums:
            zero = F.lit(0)
            out[n] = F.coalesce(F.col(f"_carry_{n}"), zero) + F.coalesce(own, zero)
        else:
            out[n] = F.greatest(F.col(f"_carry_{n}"), own)
    return merged.withColumns(out).drop("_chunk", *[f"_in_{n}" for n in fold], *[f"_carry_{n}" for n in fold])


def sliding_count(
    df: DataFrame,
    keys: list[str],
    ts: str,
    window_seconds: int,
    name: str,
    counted: Column | None = None,
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Add the number of counted rows of the key in ``[ts - window, ts]``, peers included.

    count = own chunk up to ts + whole chunks in between - rows of the oldest chunk that have
    already left. The leaving rows are sent ``window`` ahead so they meet the chunk they leave
    in; chunk size is independent of the window, so a hot key is spread as finely as needed.
    """
    if window_seconds % chunk_seconds:
        raise ValueError("window_seconds must be a multiple of chunk_seconds")
    steps = window_seconds // chunk_seconds
    weight = F.lit(1) if counted is None else F.when(counted, 1).otherwise(0)
    columns = df.columns
    rows = with_chunk(df, ts, chunk_seconds).withColumns(
        {"_at": F.unix_micros(F.col(ts)), "_w": weight.cast("bigint")}
    )
    own = rows.select(*keys, "_chunk", "_at", "_w", F.struct(*columns).alias("_row"))
    leaving = rows.where("_w > 0").select(
        *keys,
        (F.col("_chunk") + steps).alias("_chunk"),
        (F.col("_at") + window_seconds * 1_000_000).alias("_at"),
        "_w",
        F.lit(None).cast(own.schema["_row"].dataType).alias("_row"),
    )
    totals = rows.groupBy(*keys, "_chunk").agg(F.sum("_w").alias("_total"))
    span = W.partitionBy(*keys).orderBy("_chunk").rangeBetween(-steps, -1)
    carry = totals.select(*keys, "_chunk", F.coalesce(F.sum("_total").over(span), F.lit(0)).alias("_carry"))
    inside = W.partitionBy(*keys, "_chunk").orderBy("_at")
    is_own = F.col("_row").isNotNull()
    arrived = F.sum(F.when(is_own, F.col("_w"))).over(inside.rangeBetween(W.unboundedPreceding, 0))
    left = F.sum(F.when(~is_own, F.col("_w"))).over(inside.rangeBetween(W.unboundedPreceding, -1))
    counts = own.unionByName(leaving).withColumns({"_arrived": arrived, "_left": left}).where(is_own)
    total = F.col("_carry") + F.coalesce("_arrived", F.lit(0)) - F.coalesce("_left", F.lit(0))
    return counts.join(carry, [*keys, "_chunk"], "left").select("_row.*", total.alias(name))
