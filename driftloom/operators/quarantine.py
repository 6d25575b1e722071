"""Doubtful records: store, list, expire, resolve, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions import ids, page, pii
from driftloom.operators.latest import latest
from driftloom.operators.sized import MAX_BROADCAST_IDS, join_small

COLUMNS = [
    "snapshot_id", "domain", "field_name", "page_url", "broken_selector", "proposed_selector",
    "confidence_score", "quarantined_at", "retention_expires_at", "resolved", "resolved_by", "resolved_at",
]


def quarantine(decisions: DataFrame, pages: DataFrame, now: Column, pii_order: str = "reference") -> DataFrame:
    """Quarantine rows with the cleaned and redacted outline of their page as ``content``."""
    held = decisions.where("outcome = 'quarantined'")
    wide = pages.select("page_id", "html")
    outlines = join_small(wide, held.select("page_id").distinct(), ["page_id"], "left_semi", MAX_BROADCAST_IDS).select(
        "page_id", pii.redact(page.sanitize(page.page_outline(F.col("html"))), pii_order).alias("content")
    )
    key = ids.snapshot_id(F.col("domain"), F.col("field_name"), F.col("page_url"), F.col("old_selector"))
    return held.join(outlines, "page_id", "left").select(
        key.alias("snapshot_id"),
        "domain",
        "field_name",
        "page_url",
        F.col("old_selector").alias("broken_selector"),
        "proposed_selector",
        F.col("confidence").alias("confidence_score"),
        now.alias("quarantined_at"),
        ids.retention_expires_at(now).alias("retention_expires_at"),
        F.lit(False).alias("resolved"),
        F.lit(None).cast("string").alias("resolved_by"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
        "content",
    )


def replace_records(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """Insert or replace by id; a record quarantined again is pending again."""
    return latest(current.unionByName(fresh), ["snapshot_id"], ["quarantined_at"])


def pending(records: DataFrame, domain: str | None = None) -> DataFrame:
    rows = records.where(~F.col("resolved"))
    return rows.where(F.col("domain") == domain) if domain else rows


def lookup(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records whose ids are listed in ``wanted.snapshot_id``."""
    return records.join(wanted.select("snapshot_id"), "snapshot_id", "left_semi")


def expired(records: DataFrame, now: Column) -> DataFrame:
    return records.where(F.col("retention_expires_at") < now)


def unexpired(records: DataFrame, now: Column) -> DataFrame:
    return records.where(~F.coalesce(F.col("retention_expires_at") < now, F.lit(False)))


def stale_snapshots(snapshots: DataFrame, now: Column, max_age_days: int = ids.RETENTION_DAYS, at: str = "quarantined_at") -> DataFrame:
    """Second retention rule, on the age of the stored content itself."""
    return snapshots.where(now - F.expr(f"INTERVAL {max_age_days} DAYS") > F.col(at))


def resolve(records: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Mark records resolved. ``resolutions``: snapshot_id, resolved_by, resolved_at; newest wins."""
    newest = latest(resolutions.select("snapshot_id", "resolved_by", "resolved_at"), ["snapshot_id"], ["resolved_at", "resolved_by"])
    marks = newest.select("snapshot_id", F.col("resolved_by").alias("_by"), F.col("resolved_at").alias("_at"))
    return records.join(marks, "snapshot_id", "left").select(
        *[
            F.when(F.col("_at").isNotNull(), new).otherwise(F.col(c)).alias(c) if new is not None else F.col(c)
            for c, new in (
                (c, {"resolved": F.lit(True), "resolved_by": F.col("_by"), "resolved_at": F.col("_at")}.get(c))
                for c in records.columns
            )
        ]
    )


def replay(records: DataFrame, extractions: DataFrame, now: Column, by: str = "replay") -> DataFrame:
    """Resolution rows for pending records whose field now extracts; running it again adds none."""
    found = extractions.where("success").select("domain", "field_name", "page_url").distinct()
    return (
        pending(records)
        .join(found, ["domain", "field_name", "page_url"], "left_semi")
        .select("snapshot_id", F.lit(by).alias("resolved_by"), now.alias("resolved_at"))
        .dropDuplicates(["snapshot_id"])
    )


def null_quarantined(values: DataFrame, flag: str = "quarantined") -> DataFrame:
    return values.withColumn("value", F.when(~F.col(flag), F.col("value")))


def with_content(records: DataFrame, snapshots: DataFrame) -> DataFrame:
    return records.join(snapshots.select("snapshot_id", "content"), "snapshot_id", "left")
