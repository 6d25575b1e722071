"""Deterministic ids and configuration normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RETENTION_DAYS = 7

# Fixed vocabularies.
STRATEGIES = ("role", "aria", "text", "test_id", "css", "xpath")
FIELD_TYPES = ("string", "float", "int", "bool", "date", "url")
ALWAYS_REQUIRED = ("title", "name", "price", "product_title")
SIGMA = {"low": 2.0, "medium": 3.0, "high": 5.0}


def snapshot_id(*keys: Column) -> Column:
    """Hash of the identifying columns: replaying the same failure gives the same id."""
    return F.sha2(F.concat_ws("#", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]), 256)


def retention_expires_at(quarantined_at: Column) -> Column:
    return quarantined_at + F.expr(f"INTERVAL {RETENTION_DAYS} DAYS")


def field_name(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), "[^a-z0-9_]", "_")


def strategy(s: Column) -> Column:
    """Synthesised schemas only ever name these four; anything else is css."""
    return F.when(F.lower(s).isin("text", "role", "xpath"), F.lower(s)).otherwise(F.lit("css"))


def required(name: Column) -> Column:
    return F.coalesce(name.isin(*ALWAYS_REQUIRED), F.lit(False))


def config_file(domain: Column) -> Column:
    return F.replace(domain, F.lit("."), F.lit("_"))


def sigma(volatility: Column) -> Column:
    """Sigma threshold of a volatility profile, 3 when unknown."""
    return (
        F.when(volatility == "low", F.lit(SIGMA["low"]))
        .when(volatility == "high", F.lit(SIGMA["high"]))
        .otherwise(F.lit(SIGMA["medium"]))
    )


def selector_safe(selector: Column, strategy: Column) -> Column:
    """XPath selectors that call one of four host functions are refused."""
    # Fixed pattern.
    calls = selector.rlike(r"(document|system-property|unparsed-entity-uri|generate-id)\s*\(")
    return ~((strategy == "xpath") & F.coalesce(calls, F.lit(False)))


def candidate_wellformed(selector: Column) -> Column:
    return F.coalesce((selector != "") & (F.length(selector) <= 500), F.lit(False))


def sample_to_json(value: Column) -> Column:
    """A sample value as a one-key JSON document, the storable form of an untyped slot."""
    return F.to_json(F.struct(value.alias("value")))


def sample_from_json(text: Column) -> Column:
    return F.from_json(text, "value string")["value"]
