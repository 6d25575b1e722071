"""Layout drift of a domain's run, and the two breakers fed by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.operators.chunks import CHUNK_SECONDS, running, sliding_count

# Fixed thresholds.
GLOBAL_DRIFT_RATIO = 0.4
DEBOUNCE_RETRIES = 3
THRASH_LIMIT = 3
THRASH_WINDOW_HOURS = 48


def drift_type(failed: Column, total: Column, threshold: float = GLOBAL_DRIFT_RATIO) -> Column:
    return F.when((total > 0) & (failed / total > threshold), F.lit("global")).otherwise(F.lit("local"))


def spatial_drift(extractions: DataFrame, by: list[str], success: str = "success") -> DataFrame:
    """Failed and total per group with the drift verdict; ``by`` is domain, or domain and run."""
    counted = extractions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col(success)).alias("failed")
    )
    return counted.withColumn("ratio", F.col("failed") / F.col("total")).withColumn(
        "drift_type", drift_type(F.col("failed"), F.col("total"))
    )


def listing_drift(fields: DataFrame, success: DataFrame, by: list[str]) -> DataFrame:
    """Drift of listing pages: every configured field counts, fields without any item failed.

    A group with no item at all has no row in ``success`` and drifts globally at ratio 1.
    """
    found = success.select(*by, F.col("name"), F.col("success"))
    rows = fields.join(found, [*by, "name"], "left").withColumn("success", F.coalesce("success", F.lit(False)))
    return spatial_drift(rows, by)


def classify_drift(extractions: DataFrame) -> DataFrame:
    """Per domain and page: the verdict and the names of the failed fields, in name order."""
    verdict = extractions.groupBy("domain", "page_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("success")).alias("failed"),
        F.array_sort(F.collect_list(F.when(~F.col("success"), F.col("field_name")))).alias("failed_fields"),
    )
    return verdict.withColumn("ratio", F.col("failed") / F.col("total")).withColumn(
        "drift_type", drift_type(F.col("failed"), F.col("total"))
    )


def debounce_state(
    verdicts: DataFrame,
    ts: str = "ts",
    order: list[str] = ("ts", "id"),
    retries: int = DEBOUNCE_RETRIES,
    consecutive: bool = False,
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Global verdicts since the last reset, and whether the domain's breaker is open.

    Input: domain, ts, drift_type, is_reset. The count is cumulative; with ``consecutive`` a
    local verdict clears it as a reset does.
    """
    is_global = (F.col("drift_type") == "global") & ~F.col("is_reset")
    clears = F.col("is_reset") | (F.lit(consecutive) & ~is_global)
    summed = running(
        verdicts, ["domain"], ts, list(order), sums={"_globals": is_global.cast("int")}, chunk_seconds=chunk_seconds
    )
    based = running(
        summed, ["domain"], ts, list(order), maxes={"_base": F.when(clears, F.col("_globals"))}, chunk_seconds=chunk_seconds
    )
    failures = F.col("_globals") - F.coalesce("_base", F.lit(0))
    return (
        based.withColumn("global_failures", failures)
        .withColumn("state", F.when(F.col("global_failures") >= retries, F.lit("open")).otherwise(F.lit("closed")))
        .drop("_globals", "_base")
    )


def repair_count(
    repairs: DataFrame,
    window_hours: int = THRASH_WINDOW_HOURS,
    ts: str = "ts",
    keys: list[str] = ("domain", "field_name"),
    counted: Column | None = None,
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Repairs of the field in the last ``window_hours``, the current moment included."""
    return sliding_count(repairs, list(keys), ts, window_hours * 3600, "repairs", counted, chunk_seconds)


def thrash_lock(
    log: DataFrame,
    ts: str = "ts",
    order: list[str] = ("ts", "id"),
    keys: list[str] = ("domain", "field_name"),
    limit: int = THRASH_LIMIT,
    window_hours: int = THRASH_WINDOW_HOURS,
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Sticky lock of thrashing fields over a log of repairs and operator resets (``is_reset``).

    A field locks when a repair finds ``limit`` repairs in the window, and stays locked until a
    reset. Resets keep the history, so the next repair may lock the field again: the lock holds
    while the newest trigger is younger than the newest reset.
    """
    counted = repair_count(log, window_hours, ts, keys, ~F.col("is_reset"), chunk_seconds)
    at = F.struct(*order)
    marks = running(
        counted,
        list(keys),
        ts,
        list(order),
        maxes={
            "_trigger": F.when(~F.col("is_reset") & (F.col("repairs") >= limit), at),
            "_reset": F.when(F.col("is_reset"), at),
        },
        chunk_seconds=chunk_seconds,
    )
    locked = F.col("_trigger").isNotNull() & (F.col("_reset").isNull() | (F.col("_trigger") > F.col("_reset")))
    return (
        marks.withColumn("locked", locked)
        .withColumn("state", F.when(F.col("locked"), F.lit("requires_human_intervention")).otherwise(F.lit("closed")))
        .drop("_trigger", "_reset")
    )
