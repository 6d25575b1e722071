"""Typed readings of scraped strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftloom.functions.let import let

# Fixed vocabulary of boolean readings.
TRUE_WORDS = ("true", "yes", "1", "in stock")
FALSE_WORDS = ("false", "no", "0", "out of stock")

NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

ISO_MOMENT = (
    r"^([0-9]{4})(?:-([0-9]{2})-([0-9]{2})|([0-9]{2})([0-9]{2}))"
    r"(?:.([0-9]{2})(?::?([0-9]{2})(?::?([0-9]{2})(?:[.,]([0-9]+))?)?)?"
    r"(?:([+-])([0-9]{2}):?([0-9]{2})(?::?([0-9]{2}))?)?)?$"
)


def _digits_and_dots(s: Column) -> Column:
    return F.regexp_replace(F.trim(s), "[^0-9.]", "")


def parse_float(s: Column) -> Column:
    """Keep digits and dots, then read a double. A minus sign is dropped; two dots do not parse."""
    kept = _digits_and_dots(s)
    return F.when(kept.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"), kept.try_cast("double"))


def parse_int(s: Column) -> Column:
    """Keep digits and minus signs, so ``3.7`` reads as 37. Null beyond the range of a long."""
    kept = F.regexp_replace(F.trim(s), "[^0-9-]", "")
    return F.when(kept.rlike("^-?[0-9]+$"), kept.try_cast("bigint"))


def parse_bool(s: Column) -> Column:
    word = F.lower(F.trim(s))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def parse_date(s: Column) -> Column:
    """ISO-8601 dates and moments, ``Z`` accepted; a moment without offset is read as UTC."""
    text = F.replace(s, F.lit("Z"), F.lit("+00:00"))
    groups = F.split(F.regexp_replace(text, ISO_MOMENT, "$1|$2$4|$3$5|$6|$7|$8|$9|$10|$11|$12|$13"), r"\|", -1)
    return F.when(text.rlike(ISO_MOMENT), let(groups, _moment))


def _moment(g: Column) -> Column:
    def num(i: int) -> Column:
        return F.coalesce(F.nullif(g[i], F.lit("")).cast("int"), F.lit(0))

    second = num(5) + F.concat(F.lit("0."), F.substring(g[6], 1, 6), F.lit("0")).cast("decimal(8,6)")
    moment = F.try_make_timestamp(num(0), num(1), num(2), num(3), num(4), second)
    offset = (num(8) * 3600 + num(9) * 60 + num(10)) * F.when(g[7] == "-", -1).otherwise(1)
    in_range = (num(3) < 24) & (num(5) < 60)
    return F.when(in_range, F.timestamp_micros(F.unix_micros(moment) - offset.cast("bigint") * 1_000_000))


def is_http_url(s: Column) -> Column:
    return s.rlike("^https?://")


def to_number(s: Column) -> Column:
    """A plain numeric string as double, else null (no currency signs, no type suffixes)."""
    special = F.lower(F.trim(s)).rlike(r"^[+-]?(inf|infinity)$")
    return F.when(s.rlike(NUMBER) | special, F.trim(s).try_cast("double"))


def numeric_for_stats(s: Column) -> Column:
    """Strip thousands commas and the three currency signs, then read a number."""
    return to_number(F.translate(s, ",$€£", ""))


def type_failure(value: Column, field_type: Column, required: Column) -> Column:
    """Null when the value fits its declared type, else a short reason code."""
    kind = F.lower(field_type)
    empty = value.isNull() | ~value.rlike(r"\S")
    long_int = F.regexp_replace(F.trim(value), "[^0-9-]", "").rlike("^-?[0-9]+$")
    return (
        F.when(empty & F.coalesce(required, F.lit(False)), F.lit("required_empty"))
        .when(empty, F.lit(None).cast("string"))
        .when((kind == "float") & parse_float(value).isNull(), F.lit("not_float"))
        .when((kind == "int") & ~long_int, F.lit("not_int"))
        .when((kind == "bool") & parse_bool(value).isNull(), F.lit("not_bool"))
        .when((kind == "date") & parse_date(value).isNull(), F.lit("not_date"))
        .when((kind == "url") & ~is_http_url(value), F.lit("not_http_url"))
    )


def type_check(value: Column, field_type: Column, required: Column) -> Column:
    """``struct(passed, reason)``."""
    reason = type_failure(value, field_type, required)
    return let(reason, lambda r: F.struct(r.isNull().alias("passed"), r.alias("reason")))
