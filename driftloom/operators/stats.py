"""Mergeable numeric statistics per field and item, and the anomaly verdicts drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.functions import exact
from driftloom.operators import gate
from driftloom.operators.chunks import CHUNK_SECONDS, running
from driftloom.session import reliable_checkpoint

KEYS = ["domain", "field_name", "item_key"]
MIN_SPREAD = gate.MIN_SPREAD


def field_stats(values: DataFrame, keys: list[str] = KEYS, value: str = "value", order: list[str] = ("ts", "id")) -> DataFrame:
    """count, sum, sum of squares and last value per key, and ``totals``, their exact form that ``merge_stats`` adds up.

    The sums do not depend on order or partitions. Values that are no finite number have no statistics.
    """
    x = F.col(value).cast("double")
    columns = F.struct(*keys).alias("key"), x.alias("x"), F.struct(*order).alias("when"), F.lit(1).cast("bigint").alias("n")
    rows = exact.with_parts(values.where(exact.summable(x)).select(*columns), F.col("x"))
    found = exact.totals(rows, ["key"], {"x": F.max_by("x", "when"), "when": F.max("when")})
    return _stats(found, F.col("when")[order[0]])


def merge_stats(stored: DataFrame, fresh: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Stored totals plus those of a new batch: what ``field_stats`` gives over the rows of both, bit for bit."""
    return fold_stats(stored.select(fresh.columns).unionByName(fresh), keys)


def fold_stats(both: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row per key from the statistics of several batches."""
    entries = both.select(F.struct(*keys).alias("key"), F.col("last_value").alias("x"), F.col("updated_at").alias("when"), F.inline("totals"))
    return _stats(exact.totals(entries, ["key"], {"x": F.max_by("x", "when"), "when": F.max("when")}), F.col("when"))


def _stats(found: DataFrame, updated_at: Column) -> DataFrame:
    return found.select(
        "key.*",
        F.col("n").alias("value_count"),
        exact.read(F.col("totals")).alias("value_sum"),
        exact.read(F.col("totals"), square=True).alias("value_sum_sq"),
        F.col("x").alias("last_value"),
        updated_at.alias("updated_at"),
        "totals",
    )


def mean(n: Column, s: Column) -> Column:
    return F.when(n > 0, s / n).otherwise(F.lit(0.0))


def stddev(n: Column, s: Column, ss: Column) -> Column:
    """Sample deviation from totals, the variance clamped at zero; 0 below two values."""
    variance = (ss - s * s / n) / (n - 1)
    return F.when(n > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).otherwise(F.lit(0.0))


def zscore(x: Column, n: Column, s: Column, ss: Column) -> Column:
    """Distance from the mean in deviations; null while fewer than two values are known."""
    spread = F.greatest(stddev(n, s, ss), F.lit(MIN_SPREAD))
    return F.when(n >= 2, F.abs(x - mean(n, s)) / spread)


def rolling_zscore(
    values: DataFrame,
    keys: list[str],
    sigma: Column,
    ts: str = "ts",
    order: list[str] = ("ts", "id"),
    value: str = "value",
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Each value against all earlier values of its key: adds prior_n, zscore and valid."""
    x = F.col(value)
    sums = {"prior_n": F.when(x.isNotNull(), 1).otherwise(0), "_s": x, "_ss": x * x}
    out = running(values, keys, ts, list(order), sums=sums, include_current=False, chunk_seconds=chunk_seconds)
    z = zscore(x, F.col("prior_n"), F.col("_s"), F.col("_ss"))
    return (
        out.withColumn("zscore", z)
        .withColumn("valid", F.coalesce(F.col("zscore") <= sigma, F.lit(True)))
        .drop("_s", "_ss")
    )


def gate_step(n: float, s: float, ss: float, x: float, sigma: float) -> tuple[float | None, bool]:
    """Verdict on one value given the totals of the values accepted before it."""
    if n < 2:
        return None, True
    variance = max((ss - s * s / n) / (n - 1), 0.0)
    z = abs(x - s / n) / max(variance**0.5, MIN_SPREAD)
    return z, z <= sigma


def gated_zscore(
    values: DataFrame,
    keys: list[str],
    sigma: Column,
    ts: str = "ts",
    row_id: str = "id",
    value: str = "value",
    partitions: int | None = None,
) -> DataFrame:
    """Like ``rolling_zscore``, but only values that passed enter the history.

    Each verdict depends on the ones before it. Rows are range-partitioned by key and order, so a hot key is spread over as many
    partitions as its rows fill. What a partition must know of the ones before it is the total that its first key has accepted so
    far; totals are exact (``functions.exact``), so they add up in any grouping. Partitions that a key fills from end to end start
    from ungated totals; each reports what it accepted, the totals are carried on, and only partitions whose entry changed are judged again. A
    state without changes is the sequential answer, bit for bit, for any number of partitions. The driver holds one total per partition.

    A value that is no finite number is not judged (no zscore, valid) and not counted, a null sigma rejects nothing.
    """
    x = F.col(value).cast("double")
    rows = values.where(x.isNotNull()).select(*keys, ts, row_id, value, F.coalesce(sigma.cast("double"), F.lit(float("inf"))).alias("_sigma"))
    order = [*keys, ts, row_id]
    spread = rows.repartitionByRange(*([partitions] if partitions else []), *order)
    held = reliable_checkpoint(spread.sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    reports = {r["part"]: gate.Report.read(r) for r in gate.reported(held, keys, value, {}).collect()}
    entries = gate.carried(reports)
    judged: dict = {}
    while True:
        # Only what one key fills wholly depends on its entry; in other partitions the last key starts from nothing.
        changed = [p for p, e in entries.items() if reports[p].single and judged.get(p) != e]
        if not changed:
            break
        judged |= {p: entries[p] for p in changed}
        again = held.where(F.col("_part").isin(changed))
        reports |= {r["part"]: gate.Report.read(r) for r in gate.reported(again, keys, value, judged).collect()}
        entries = gate.carried(reports)
    return gate.verdicts(held, [*keys, ts, row_id, value], keys, value, entries)
