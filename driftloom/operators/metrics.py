"""Operational metrics as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed metric names and their labels.
COUNTERS = {
    "scraper_extraction_total": ("domain", "status"),
    "scraper_drift_events_total": ("domain", "field", "drift_type"),
    "scraper_healing_attempts_total": ("domain", "field", "outcome"),
    "scraper_quarantine_total": ("domain", "field"),
    "scraper_false_positive_repairs_total": ("domain", "field"),
    "scraper_validation_failures_total": ("domain", "field", "check_type"),
}
BREAKER_VALUES = {"closed": 0, "open": 1, "half_open": 2, "requires_human_intervention": 3}
# Fixed default bucket bounds of the histogram type.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def event_counters(events: DataFrame) -> DataFrame:
    """``events``: metric, domain, field, detail. Counted map-side, one shuffle of the totals."""
    return events.groupBy("metric", "domain", "field", "detail").agg(F.count(F.lit(1)).alias("value"))


def counters_rollup(events: DataFrame) -> DataFrame:
    """Totals per field, per domain and overall, rolled up from the counters, not the events."""
    counted = event_counters(events)
    return (
        counted.rollup("metric", "domain", "field")
        .agg(F.sum("value").alias("value"), F.grouping_id().alias("level"))
        .where("metric is not null")
    )


def histogram(values: DataFrame, by: list[str], value: str, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Cumulative buckets with sum and count: one conditional count per bound in a single pass."""
    x = F.col(value)
    aggs = [F.count_if(x <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    totals = values.where(x.isNotNull()).groupBy(*by).agg(
        *aggs, F.count(x).alias("count"), F.sum(x).alias("sum")
    )
    rows = F.array(
        *[F.struct(F.lit(str(b)).alias("le"), F.col(f"_b{i}").alias("bucket")) for i, b in enumerate(bounds)],
        F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("bucket")),
    )
    return totals.select(*by, "sum", "count", F.inline(rows))


def breaker_gauge(states: DataFrame, order: list[str] = ("ts", "id")) -> DataFrame:
    """Latest state per domain and breaker as a number; an unknown state reads as closed."""
    newest = states.groupBy("domain", "breaker_type").agg(F.max_by("state", F.struct(*order)).alias("state"))
    value = F.lit(0)
    for name, number in BREAKER_VALUES.items():
        value = F.when(F.col("state") == name, number).otherwise(value)
    return newest.withColumn("value", value)


def calibrate_threshold(scored: DataFrame, target_precision: float, step: float = 0.01) -> DataFrame:
    """Precision and recall at every threshold of a grid, and the lowest that meets the target.

    ``scored``: confidence in 0..1, correct boolean. Scores are first counted per grid cell, so
    the running totals go over at most ``1/step + 1`` rows however many scores there are.
    """
    cells = round(1 / step)
    cell = F.floor(F.round(F.col("confidence") * cells, 9)).cast("int")
    counts = scored.groupBy(cell.alias("_cell")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("correct").alias("_tp")
    )
    down = W.orderBy(F.desc("_cell")).rowsBetween(W.unboundedPreceding, 0)
    everything = W.orderBy(F.desc("_cell")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    table = counts.select(
        (F.col("_cell") / cells).alias("threshold"),
        F.sum("_n").over(down).alias("selected"),
        F.sum("_tp").over(down).alias("true_positives"),
        F.sum("_tp").over(everything).alias("_all"),
    )
    table = table.withColumns(
        {"precision": F.col("true_positives") / F.col("selected"), "recall": F.try_divide("true_positives", "_all")}
    ).drop("_all")
    meets = F.when(F.col("precision") >= target_precision, F.col("threshold"))
    return table.withColumn("chosen", F.coalesce(F.col("threshold") == F.min(meets).over(W.partitionBy()), F.lit(False)))


def pii_profile(scanned: DataFrame, by: list[str] = ()) -> DataFrame:
    """``scanned``: rows with a ``type`` per hit."""
    return scanned.groupBy(*by, "type").agg(F.count(F.lit(1)).alias("hits"))


def metric_events(name: str, df: DataFrame, domain: Column, field: Column | None = None, detail: Column | None = None) -> DataFrame:
    """Rows of one counter in the common shape."""
    none = F.lit(None).cast("string")
    return df.select(
        F.lit(name).alias("metric"),
        domain.alias("domain"),
        (none if field is None else field).alias("field"),
        (none if detail is None else detail).alias("detail"),
    )
