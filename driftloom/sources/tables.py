"""Page, provider, response and state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions import urls
from driftloom.functions.ids import RETENTION_DAYS
from driftloom.operators.latest import latest
from driftloom.session import reliable_checkpoint

RECORD = "struct<url:string,title:string,price:string,stock_status:string,category:string,upc:string,review_count:int>"
REQUEST = "request_id string, url string, domain string, priority int, requested_at timestamp"
RESPONSE = (
    "request_id string, domain string, url string, timestamp timestamp, status string, "
    "extracted_data struct<title:string,price:double,currency:string,availability:string,rating:string,description:string>, "
    "validation struct<type_checks_passed:boolean,business_rules_passed:boolean,"
    "statistical_anomaly_detected:boolean,z_score:double>, drift_detected boolean, quarantined boolean"
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages with their domain."""
    return with_domain(spark.read.parquet(path))


def with_domain(pages: DataFrame) -> DataFrame:
    return pages.withColumn("domain", urls.domain_of(F.col("url")))


def read_provider_batches(spark: SparkSession, path: str, record: str = RECORD) -> DataFrame:
    """One row per record of the ready batches.

    A file is an envelope with a ``data`` array, a bare record or a bare list; a bare record has
    no status and counts as ready.
    """
    members = record[len("struct<") : -1]
    schema = f"struct<collection_id:string,status:string,total_records:bigint,data:array<{record}>,{members}>"
    flat = T_fields(members)
    raw = spark.read.schema(_ddl(schema)).option("multiLine", True).json(path)
    bare = F.when(F.col("data").isNull() & F.col("status").isNull(), F.array(F.struct(*flat)))
    ready = raw.where(F.col("status").isNull() | (F.col("status") == "ready"))
    return ready.select("collection_id", F.inline(F.coalesce("data", bare)))


def T_fields(members: str) -> list[str]:
    return [m.split(":", 1)[0] for m in members.split(",")]


def _ddl(struct: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(struct)


def provider_extractions(records: DataFrame, fields: list[str]) -> DataFrame:
    """Provider records melted to extraction rows; the literal ``N/A`` is a missing value."""
    cells = F.array(
        *[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields]
    )
    value = F.nullif("value", F.lit("N/A"))
    return records.select("url", F.inline_outer(cells)).select(
        F.col("url").alias("page_url"),
        urls.domain_of(F.col("url")).alias("domain"),
        "field_name",
        value.alias("value"),
        value.isNotNull().alias("success"),
    )


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response documents with their nested parts flattened."""
    return spark.read.schema(RESPONSE).option("multiLine", True).json(path).select(
        "request_id", "domain", "url", "timestamp", "status", "extracted_data.*", "validation.*", "drift_detected", "quarantined"
    )


def dataset_documents(items: DataFrame, drift_events: DataFrame | None = None) -> DataFrame:
    """One document per page: total_items, items in page order, drift events.

    Items of one page are bounded by the page; drift events by its configured fields.
    """
    ordered = F.array_sort(F.collect_list(F.struct("pos", "values")))
    docs = items.groupBy("page_id", "url", "domain").agg(
        F.count(F.lit(1)).alias("total_items"),
        F.transform(ordered, lambda i: F.map_from_entries(
            F.transform(i["values"], lambda f: F.struct(f["name"], f["value"]))
        )).alias("items"),
    )
    if drift_events is None:
        return docs.withColumn("drift_events", F.array().cast("array<struct<field_name:string,outcome:string>>"))
    events = drift_events.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("field_name", "outcome"))).alias("drift_events")
    )
    return docs.join(events, "page_id", "left")


def write_dataset(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").json(path)


def write_snapshots(records: DataFrame, path: str) -> None:
    """Snapshot contents keyed by id, in one folder per quarantine day so that days expire whole."""
    (
        records.select("snapshot_id", "content", "quarantined_at", F.to_date("quarantined_at").alias("quarantined_date"))
        .write.mode("append")
        .partitionBy("quarantined_date")
        .json(path)
    )


def read_snapshots(spark: SparkSession, path: str, since: Column | None = None) -> DataFrame:
    """``since`` prunes whole days."""
    schema = "snapshot_id string, content string, quarantined_at timestamp, quarantined_date date"
    rows = spark.read.schema(schema).json(path)
    return rows if since is None else rows.where(F.col("quarantined_date") >= since)


def drop_expired(rows: DataFrame, path: str, expired: Column, day: str, form: str = "json") -> int:
    """Take expired rows out of a store that is partitioned by ``day``; their number.

    ``rows`` is the store as read. Days without an expired row keep their files. A day whose rows are all expired is emptied; of
    others the rest is written first and then replaces the day, so a run that breaks off loses nothing and may come again. A row for
    which ``expired`` is null stays.
    """
    gone = F.coalesce(expired, F.lit(False))
    counts = rows.groupBy(F.col(day).cast("string").alias("day")).agg(F.count_if(gone).alias("gone"), F.count_if(~gone).alias("left"))
    days = [r for r in counts.where("gone > 0").collect()]  # a row per day
    partly = [r["day"] for r in days if r["left"]]
    if partly:
        kept = reliable_checkpoint(rows.where(F.col(day).cast("string").isin(partly) & ~gone))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).format(form).save(path)
    for whole in (r["day"] for r in days if not r["left"]):
        rows.limit(0).drop(day).write.mode("overwrite").format(form).save(f"{path}/{day}={whole}")
    return sum(r["gone"] for r in days)


def expire_snapshots(spark: SparkSession, path: str, now: Column, days: int = RETENTION_DAYS) -> int:
    """Remove the contents that are older than the retention from the snapshot store; their number."""
    old = now - F.expr(f"INTERVAL {days} DAYS") > F.col("quarantined_at")
    return drop_expired(read_snapshots(spark, path), path, old, "quarantined_date")


def append_state(rows: DataFrame, path: str, partition_by: list[str] | None = None, run: str | None = None) -> None:
    """State tables are append-only logs; "current" is the latest row per key.

    With a ``run`` the rows lie in a folder of that id, which a rerun replaces, so that they count once. Logs that are compacted, and
    runs that must be invisible until they are whole, are ``statelog.StateLog``'s.
    """
    if run is not None:
        rows = rows.withColumn("run", F.lit(run))
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("run", *(partition_by or [])).parquet(path)
        return
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_state(spark: SparkSession, path: str, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    log = spark.read.parquet(path)
    return latest(log, keys, order) if keys else log


def compact_state(spark: SparkSession, path: str, target: str, keys: list[str], order: list[str]) -> None:
    """Rewrite a log as its current rows, into a new folder."""
    read_state(spark, path, keys, order).write.mode("overwrite").parquet(target)


def read_requests_stream(spark: SparkSession, path: str, max_files: int = 64) -> DataFrame:
    """Requests as they arrive in a folder."""
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", max_files).json(path)


def read_event_stream(spark: SparkSession, path: str, schema, ts: str = "ts", max_files: int = 64) -> DataFrame:
    """A parquet event folder as a stream; zone-less times become timestamps so they can be watermarked."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .parquet(path)
        .withColumn(ts, F.col(ts).cast("timestamp"))
    )
