"""Configuration tables read from JSON documents with fixed schemas.

A document that does not parse is skipped, never fatal; a missing file gives defaults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions import ids

FIELD = (
    "struct<name:string,selector:string,strategy:string,field_type:string,volatility:string,"
    "required:boolean,description:string>"
)
DOMAIN = (
    "domain string, rate_limit struct<requests_per_minute:int,burst_capacity:int>, rate_limit_rpm int, "
    f"burst_capacity int, fields array<{FIELD}>, holdout_urls array<string>, posture string, "
    "manifest_path string, multi_item boolean, item_container string, scroll_count int"
)
RULE = "field string, op string, value string, values array<string>, context map<string,string>, description string"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of multi-line JSON documents; unreadable documents and missing paths give none."""
    reader = (
        spark.read.schema(f"{schema}, _corrupt_record string")
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("ignoreMissingFiles", True)
    )
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    # The filter names a data column next to the corrupt record, as Spark requires.
    return reader.json(path).where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def load_domains(spark: SparkSession, path: str) -> DataFrame:
    """One row per domain document, nested rate limit flattened and defaults filled in."""
    docs = _json(spark, path, DOMAIN).where("domain is not null")
    fields = F.transform(
        F.coalesce("fields", F.array().cast(f"array<{FIELD}>")),
        lambda f: F.struct(
            f["name"].alias("name"),
            f["selector"].alias("selector"),
            F.coalesce(f["strategy"], F.lit("css")).alias("strategy"),
            F.coalesce(f["field_type"], F.lit("string")).alias("field_type"),
            F.coalesce(f["volatility"], F.lit("medium")).alias("volatility"),
            F.coalesce(f["required"], F.lit(True)).alias("required"),
            F.coalesce(f["description"], F.lit("")).alias("description"),
        ),
    )
    rpm = F.coalesce("rate_limit.requests_per_minute", "rate_limit_rpm", F.lit(30))
    burst = F.coalesce("rate_limit.burst_capacity", "burst_capacity", F.lit(5))
    return docs.select(
        "domain",
        rpm.alias("rate_limit_rpm"),
        burst.alias("burst_capacity"),
        fields.alias("fields"),
        F.coalesce("holdout_urls", F.array().cast("array<string>")).alias("holdout_urls"),
        F.coalesce("posture", F.lit("strict_compliance")).alias("posture"),
        "manifest_path",
        F.coalesce("multi_item", F.lit(False)).alias("multi_item"),
        "item_container",
        F.coalesce("scroll_count", F.lit(0)).alias("scroll_count"),
    )


def field_table(domains: DataFrame) -> DataFrame:
    """One row per field definition, with its position."""
    return domains.select("domain", F.posexplode("fields").alias("position", "_f")).select("domain", "position", "_f.*")


def holdout_table(domains: DataFrame) -> DataFrame:
    return domains.select("domain", F.explode("holdout_urls").alias("url"))


def rate_table(domains: DataFrame) -> DataFrame:
    """Bucket size and refill per second."""
    return domains.select(
        "domain", F.col("burst_capacity").cast("double").alias("capacity"), (F.col("rate_limit_rpm") / 60.0).alias("rate")
    )


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    docs = _json(spark, path, f"rules array<struct<{_struct(RULE)}>>")
    return docs.select(F.posexplode("rules").alias("position", "_r")).select("position", "_r.*")


def load_volatility(spark: SparkSession, path: str) -> DataFrame:
    """profile, sigma_threshold; the three fixed profiles when there is no readable file."""
    docs = _json(spark, path, "profiles map<string,struct<description:string,sigma_threshold:double>>")
    read = docs.select(F.explode("profiles").alias("profile", "_p")).select(
        "profile", F.coalesce("_p.sigma_threshold", F.lit(3.0)).alias("sigma_threshold"), F.lit(1).alias("_rank")
    )
    fixed = spark.createDataFrame([(k, v, 0) for k, v in ids.SIGMA.items()], "profile string, sigma_threshold double, _rank int")
    return read.unionByName(fixed).groupBy("profile").agg(F.max_by("sigma_threshold", "_rank").alias("sigma_threshold"))


def load_postures(spark: SparkSession, path: str) -> DataFrame:
    docs = _json(spark, path, "domains map<string,struct<posture:string,manifest_path:string>>")
    return docs.select(F.explode("domains").alias("domain", "_p")).select("domain", "_p.posture", "_p.manifest_path")


def load_manifests(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        "approver string, expiration_date timestamp, authorized_domains array<string>, techniques array<string>, "
        "signature_ok boolean, issued_at timestamp"
    )
    return _json(spark, path, schema).withColumn("signature_ok", F.coalesce("signature_ok", F.lit(False)))


def normalise_schema(proposed: DataFrame) -> DataFrame:
    """Field names, strategies and required flags of a synthesised schema, made uniform."""
    return proposed.select(
        "domain",
        ids.config_file(F.col("domain")).alias("config_file"),
        ids.field_name(F.col("name")).alias("name"),
        "selector",
        ids.strategy(F.col("strategy")).alias("strategy"),
        F.lower("field_type").alias("field_type"),
        F.lit("low").alias("volatility"),
        ids.required(F.col("name")).alias("required"),
    )


def _struct(ddl: str) -> str:
    """``a string, b map<..>`` as struct members: the first blank of each member becomes a colon."""
    members, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            members.append(":".join(ddl[start:i].strip().split(" ", 1)))
            start = i + 1
    return ",".join(members)
