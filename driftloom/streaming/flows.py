"""Stateless and windowed streams, and the sinks that make a replayed batch harmless."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftloom.operators import extract, metrics, validate
from driftloom.operators.latest import LKG_KEYS, LKG_SIZE, lkg_window, newest_n
from driftloom.sources import tables
from driftloom.sources.statelog import StateLog


def dedup_requests(requests: DataFrame, key: str = "request_id", ts: str = "requested_at", late: str = "1 hour") -> DataFrame:
    """Each request once, however often it is redelivered within the watermark."""
    return requests.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def metrics_stream(events: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """The counters per time window. ``events``: metric, domain, field, detail, ts."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, window), "metric", "domain", "field", "detail")
        .agg(F.count(F.lit(1)).alias("value"))
        .select(F.col("window.start").alias("window_start"), "metric", "domain", "field", "detail", "value")
    )


def histogram_stream(values: DataFrame, by: list[str], value: str, ts: str = "ts", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Cumulative buckets per time window, one row per window and group."""
    x = F.col(value)
    return (
        values.where(x.isNotNull())
        .withWatermark(ts, late)
        .groupBy(F.window(ts, window), *by)
        .agg(
            F.count(x).alias("count"),
            F.sum(x).alias("sum"),
            *[F.count_if(x <= b).alias(f"le_{str(b).replace('.', '_')}") for b in metrics.BUCKETS],
        )
    )


def _batch_path(path: str, batch_id: int) -> str:
    """A folder per micro-batch: a batch that runs again overwrites itself."""
    return f"{path}/batch_id={batch_id}"


def lkg_log(spark: SparkSession, path: str, every: int = 20) -> StateLog:
    return StateLog(spark, path, lkg_window, every)


def lkg_stream(snapshots: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, every: int = 20) -> StreamingQuery:
    """Keep the newest samples per field: each batch adds at most ``LKG_SIZE`` rows per key, and every ``every`` batches the log is
    folded to that many altogether. A batch that is replayed after a crash is known by its id and adds nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = newest_n(batch, LKG_KEYS, ["snapshot_at", "snapshot_id"], LKG_SIZE)
        lkg_log(batch.sparkSession, path, every).append(rows, f"{checkpoint}#{batch_id}")

    writer = snapshots.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_lkg(spark: SparkSession, path: str) -> DataFrame:
    return lkg_log(spark, path).read()


def page_stream(
    pages: DataFrame, fields: DataFrame, rules: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Extraction and validation of arriving pages; both tables are written per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        found = extract.extract_fields(tables.with_domain(batch), fields).persist()
        found.write.mode("overwrite").parquet(_batch_path(f"{path}/extractions", batch_id))
        context = found.withColumn("context", F.lit(None).cast("map<string,string>"))
        checked = validate.check_values(context, rules)
        validate.explode_checks(checked, ["page_id", "domain", "field_name"]).write.mode("overwrite").parquet(
            _batch_path(f"{path}/validations", batch_id)
        )
        found.unpersist()

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
