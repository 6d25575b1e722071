"""Heuristics for a listing card's text, and the key that tells two cards apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns.
PRICE = r"([$₹€£¥]\s*[\d,]+\.?\d*)"
RATING = r"(?i)([0-5]\.\d)\s*(?:out of 5 stars|stars|\/5)"
COUNT = r"(?i)([\d,]+)\s*(?:customer reviews?|reviews?|ratings?)"


def _first(s: Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(s, pattern, 1)), F.lit(""))


def price_from_text(s: Column) -> Column:
    return _first(s, PRICE)


def rating_from_text(s: Column) -> Column:
    return F.concat(_first(s, RATING), F.lit(" out of 5 stars"))


def count_from_text(s: Column) -> Column:
    return _first(s, COUNT)


def title_from_text(s: Column) -> Column:
    """First line of the trimmed text."""
    return F.nullif(F.split_part(F.regexp_replace(s, r"^\s+|\s+$", ""), F.lit("\n"), F.lit(1)), F.lit(""))


def is_url_field(name: Column, field_type: Column) -> Column:
    return (field_type == "url") | F.contains(F.lower(name), F.lit("url"))


def heuristic_value(name: Column, field_type: Column, text: Column, link_label: Column) -> Column:
    """Value of a field no selector matched, guessed from the card text by the field's name."""
    n = F.lower(name)

    def named(*parts: str) -> Column:
        test = F.lit(False)
        for p in parts:
            test = test | F.contains(n, F.lit(p))
        return test

    label = F.nullif(F.trim(link_label), F.lit(""))
    return F.when(
        text != "",
        F.when(named("price") | field_type.isin("float", "price"), price_from_text(text))
        .when(named("rating", "star"), rating_from_text(text))
        .when(named("review", "count"), count_from_text(text))
        .when(named("title", "name"), F.coalesce(label, title_from_text(text))),
    )


def dedup_key(fields: Column) -> Column:
    """Key of one card from its ordered ``array<struct<name,field_type,value>>``.

    The first filled URL field without its query, else the first 100 characters of the first
    filled field. Null when nothing is filled.
    """
    filled = F.filter(fields, lambda f: f["value"].isNotNull() & (f["value"] != ""))
    urls = F.filter(filled, lambda f: is_url_field(f["name"], f["field_type"]))
    by_url = F.split_part(F.get(urls, F.lit(0))["value"], F.lit("?"), F.lit(1))
    by_value = F.trim(F.substring(F.get(filled, F.lit(0))["value"], 1, 100))
    return F.coalesce(F.nullif(by_url, F.lit("")), F.nullif(by_value, F.lit("")))
