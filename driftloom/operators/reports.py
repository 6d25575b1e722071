"""Summaries handed to people and downstream stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def catalogue_summary(items: DataFrame, by: list[str] = ("domain",)) -> DataFrame:
    """Items with any title or name, and with any price. ``items.values``: array of name/value."""

    def has(*parts: str) -> Column:
        def named(f: Column) -> Column:
            test = F.lit(False)
            for p in parts:
                test = test | F.contains(f["name"], F.lit(p))
            return test & F.coalesce(f["value"] != "", F.lit(False))

        return F.exists("values", named)

    return items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(has("title", "name")).alias("with_title"),
        F.count_if(has("price")).alias("with_price"),
    )


def domain_summary(domains: DataFrame) -> DataFrame:
    """Rate, comma-joined field names in order and number of hold-outs; row-wise."""
    names = F.transform("fields", lambda f: f["name"])
    return domains.select(
        "domain",
        F.coalesce("rate_limit_rpm", F.lit(30)).alias("rate_limit_rpm"),
        F.array_join(names, ", ").alias("fields"),
        F.coalesce(F.size("holdout_urls"), F.lit(0)).alias("holdouts"),
    )


def assemble_response(values: DataFrame, keys: list[str]) -> DataFrame:
    """One row per request from its field rows (field_name, value, quarantined).

    A request has one row per configured field, so the collected group is bounded by the config.
    """
    pairs = F.array_sort(F.collect_list(F.struct("field_name", "value")))
    held = F.array_sort(F.collect_list(F.when(F.col("quarantined"), F.col("field_name"))))
    return values.groupBy(*keys).agg(
        F.map_from_entries(pairs).alias("fields"),
        held.alias("quarantined_fields"),
        F.count(F.lit(1)).alias("field_count"),
    )


def field_status(values: DataFrame) -> DataFrame:
    """Shown status of one field: held or empty values wait for review."""
    waiting = F.col("quarantined") | F.col("value").isNull()
    return values.withColumn("status", F.when(waiting, F.lit("QUARANTINED")).otherwise(F.lit("SUCCESS")))


def drift_report(drift_events: DataFrame) -> DataFrame:
    """Per field of a domain: attempts, outcomes, mean time to heal and the newest selector.

    ``drift_events``: domain, field_name, outcome, auto_healed, seconds, new_selector, ts, id.
    """
    outcomes = ("auto_approved", "quarantined", "rejected_overfit", "rejected_breaker", "failed")
    chosen = F.col("new_selector").isNotNull()
    return drift_events.groupBy("domain", "field_name").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if("auto_healed").alias("healed"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in outcomes],
        F.avg("seconds").alias("mean_seconds"),
        F.max_by(F.when(chosen, F.col("new_selector")), F.when(chosen, F.struct("ts", "id"))).alias("last_selector"),
    )
