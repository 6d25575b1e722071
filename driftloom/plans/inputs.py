"""Tables the registered queries share, all derived by Spark from the given tables.

Only plans are remembered between queries, never data.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators import extract, latest
from driftloom.sources import tables


@lru_cache
def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.conf.get("spark.driftloom.spreadTables", None)
    return df.repartition(int(cores)) if cores else df


@lru_cache
def pages(spark: SparkSession, sf: str) -> DataFrame:
    return tables.with_domain(table(spark, sf, "pages"))


@lru_cache
def events(spark: SparkSession, sf: str) -> DataFrame:
    """id, ts as a timestamp, user_id, event_type, value."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value"
    )


@lru_cache
def domain_configs(spark: SparkSession, sf: str) -> DataFrame:
    """A configuration per crawled domain, except the spam farm, which has none.

    Blogs look for the title in ``h2`` and ``.net`` sites for a direct link child: both have
    drifted. The price selector matches nowhere.
    """
    d = F.col("domain")
    title = F.when(F.startswith(d, F.lit("blog.")), F.lit("h2")).otherwise(F.lit("h1"))
    link = F.when(F.endswith(d, F.lit(".net")), F.lit("nav > a")).otherwise(F.lit("nav a"))
    fields = (
        ("title", title, "css", "string", "low", True),
        ("page_title", F.lit("title"), "css", "string", "low", True),
        ("ad", F.lit(".ad"), "css", "string", "high", False),
        ("first_link", link, "css", "string", "medium", True),
        ("owner", F.lit("contentinfo"), "role", "string", "low", True),
        ("price", F.lit(".price_color"), "css", "float", "medium", True),
    )
    return (
        pages(spark, sf)
        .where(~F.startswith(d, F.lit("spam-farm")))
        .select("domain")
        .distinct()
        .select(
            "domain",
            (F.lit(20) + F.length("domain")).alias("rate_limit_rpm"),
            F.lit("nav li").alias("item_container"),
            F.array(F.concat(F.lit("https://"), d, F.lit("/a")), F.concat(F.lit("https://"), d, F.lit("/b"))).alias("holdout_urls"),
            F.array(*[_field(*f) for f in fields]).alias("fields"),
        )
    )


def _field(name: str, selector: Column, strategy: str, kind: str, volatility: str, required: bool) -> Column:
    return F.struct(
        F.lit(name).alias("name"),
        selector.alias("selector"),
        F.lit(strategy).alias("strategy"),
        F.lit(kind).alias("field_type"),
        F.lit(volatility).alias("volatility"),
        F.lit(required).alias("required"),
    )


@lru_cache
def fields(spark: SparkSession, sf: str) -> DataFrame:
    return domain_configs(spark, sf).select("domain", F.posexplode("fields").alias("position", "_f")).select(
        "domain", "position", "_f.*"
    )


@lru_cache
def extractions(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract_fields(pages(spark, sf), fields(spark, sf))


def kept_extractions(spark: SparkSession, sf: str) -> DataFrame:
    """For queries that read the extractions more than once: parsed once, spilled when large."""
    return extractions(spark, sf).persist(StorageLevel.MEMORY_AND_DISK)


@lru_cache
def listing_domains(spark: SparkSession, sf: str) -> DataFrame:
    """Every domain as a listing of its navigation entries."""
    cards = (
        ("link_title", F.lit("a"), "css", "string", "low", True),
        ("link_url", F.lit("a"), "css", "url", "low", True),
        ("price", F.lit(".price"), "css", "float", "low", False),
    )
    return pages(spark, sf).select("domain").distinct().select(
        "domain", F.lit("nav li").alias("item_container"), F.array(*[_field(*c) for c in cards]).alias("fields")
    )


def fetched_at(page_id: Column) -> Column:
    """Pages carry no fetch time; their id orders them, one a minute."""
    return F.timestamp_seconds(F.lit(1704067200) + page_id * 60)


@lru_cache
def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Last-known-good candidates: the page title of every page of its domain."""
    only = fields(spark, sf).where("name = 'page_title'")
    return _title_snapshots(extract.extract_fields(pages(spark, sf), only))


def snapshots_of(found: DataFrame) -> DataFrame:
    """The rows of ``snapshots`` out of extractions of all fields, so that no page is read for them again."""
    return _title_snapshots(found.where("field_name = 'page_title'"))


def _title_snapshots(found: DataFrame) -> DataFrame:
    return extract.lkg_snapshots(found, fetched_at(F.col("page_id")))


@lru_cache
def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Per ten-user domain and day: the share of error events as failed fields, and resets.

    A run with a purchase total above its error total counts as failed beyond the threshold for
    variety; domain 7 is reset by hand every tenth day.
    """
    runs = (
        events(spark, sf)
        .groupBy(F.concat(F.lit("d"), F.col("user_id") % 10).alias("domain"), F.date_trunc("day", "ts").alias("ts"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type").isin("error", "view")).alias("failed"))
    )
    day = F.dayofmonth("ts")
    return runs.select(
        "domain",
        "ts",
        F.unix_seconds("ts").alias("id"),
        "total",
        "failed",
        ((day % 10 == 0) & (F.col("domain") == "d7")).alias("is_reset"),
    )


@lru_cache
def repair_events(spark: SparkSession, sf: str) -> DataFrame:
    """Errors are repairs of a field (event family of a domain), a fifth of sign-ups are resets."""
    e = events(spark, sf)
    is_reset = F.col("event_type") == "signup"
    return e.where("event_type = 'error' or (event_type = 'signup' and id % 5 = 0)").select(
        F.concat(F.lit("d"), F.col("user_id") % 10).alias("domain"),
        F.concat(F.lit("f"), F.col("user_id") % 3).alias("field_name"),
        "ts",
        "id",
        is_reset.alias("is_reset"),
    )


def candidates(found: DataFrame) -> DataFrame:
    """A proposal for every failed field of the extractions: right ones and one that finds nothing."""
    failed = found.where("not success")
    selector = (
        F.when(F.col("field_name") == "title", F.when(F.col("page_id") % 2 == 0, F.lit("h1")).otherwise(F.lit("article h1")))
        .when(F.col("field_name") == "first_link", F.lit("nav a"))
        .otherwise(F.lit("[data-price]"))
    )
    return failed.select(
        "page_id",
        "domain",
        "field_name",
        selector.alias("selector"),
        F.lit("css").alias("strategy"),
        F.lit(None).cast("string").alias("role_name"),
        F.lit(None).cast("string").alias("role_type"),
    )


@lru_cache
def holdouts(spark: SparkSession, sf: str) -> DataFrame:
    """The newest three pages of each domain; every seventh page did not load."""
    newest = latest.newest_n(pages(spark, sf), ["domain"], ["page_id"], 3)
    return newest.select("domain", "url", F.when(F.col("page_id") % 7 != 0, F.col("html")).alias("html"))


def rules(spark: SparkSession) -> DataFrame:
    """The business rules of a product catalogue."""
    rows = [
        (0, "price", "gt", "0", None, {"product_type": "physical"}, "physical goods cost something"),
        (1, "price", "gte", "0", None, {"product_type": "digital"}, "digital goods may be free"),
        (2, "title", "min_length", "1", None, {}, "title present"),
        (3, "title", "max_length", "500", None, {}, "title not absurd"),
        (4, "size", "gte", "0", None, {}, "size range"),
        (5, "size", "lte", "45", None, {}, "size range"),
        (6, "brand", "regex", "Brand#[0-9]$", None, {}, "one-digit brands"),
        (7, "kind", "in", None, ["ECONOMY", "SMALL", "MEDIUM"], {}, "listed kinds"),
        (8, "kind", "ne", "PROMO", None, {}, "no promotions"),
    ]
    schema = (
        "position int, field string, op string, value string, values array<string>, context map<string,string>, "
        "description string"
    )
    return spark.createDataFrame(rows, schema)
