"""Listing pages: repeated cards to deduplicated items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions import items as I
from driftloom.functions import page, urls
from driftloom.operators.extract import FIELD, oversize
from driftloom.operators.once import with_once
from driftloom.operators.sized import join_small


def extract_cards(pages: DataFrame, domains: DataFrame) -> DataFrame:
    """One row per container: its position and its field values, before deduplication.

    ``domains``: domain, item_container, fields array. A value comes from the scoped selector,
    else for URL fields from the first link, else from the text heuristics.
    """
    wanted = F.transform("fields", lambda f: F.struct(*[f[c].alias(c) for c in FIELD[:4]]))
    conf = domains.select("domain", "item_container", wanted.alias("wanted"))
    wide = pages.where(~oversize(F.octet_length("html"))).select("page_id", "url", "domain", "html")
    found = (
        join_small(wide, conf, ["domain"])
        .select("page_id", "url", "domain", "wanted", page.select_cards("html", "item_container", "wanted").alias("_f"))
    )
    cards = found.select(
        "page_id", "url", "domain", "wanted", F.col("_f.container").alias("container"),
        F.posexplode("_f.cards").alias("pos", "_card"),
    )
    zipped = F.arrays_zip(
        "wanted", F.col("_card.values").alias("value"), F.col("_card.hrefs").alias("href")
    )

    def filled(z):
        name, kind = z["wanted"]["name"], z["wanted"]["field_type"]
        is_url = I.is_url_field(name, kind)
        href = F.coalesce(z["href"], F.col("_card.link"))
        found = F.when(is_url, urls.resolve_url(F.col("url"), href)).otherwise(z["value"])
        guess = I.heuristic_value(name, kind, F.col("_card.text"), F.col("_card.label"))
        return F.struct(name.alias("name"), kind.alias("field_type"), F.coalesce(found, guess).alias("value"))

    return with_once(cards, "values", F.transform(zipped, filled)).select(
        "page_id", "url", "domain", "container", "pos", "values"
    )


def extract_items(pages: DataFrame, domains: DataFrame) -> DataFrame:
    """Accepted items: non-empty cards, the first of each key within its page.

    The first-of-key step is an aggregate whose map side already sees a whole page.
    """
    keyed = with_once(extract_cards(pages, domains), "dedup_key", I.dedup_key(F.col("values")))
    first = F.min_by(F.struct("url", "domain", "container", "values"), "pos").alias("_first")
    return (
        keyed.where(F.col("dedup_key").isNotNull())
        .groupBy("page_id", "dedup_key")
        .agg(F.min("pos").alias("pos"), first)
        .select("page_id", "_first.*", "pos", "dedup_key")
    )


def listing_outcomes(pages: DataFrame, domains: DataFrame) -> DataFrame:
    """One row per page of a listing domain, also for pages that yield nothing: ``container``, ``n_cards``, ``n_items`` (the rows that
    ``extract_items`` gives) and ``error``, null where there are items. A page is ``no_content`` (null or blank), ``response_too_large``
    (not read), ``no_container`` (no card on it) or ``no_items`` (cards, but all empty)."""
    conf = domains.select("domain", "item_container").dropDuplicates(["domain"])
    size = F.octet_length("html")
    blank = F.coalesce(F.trim("html") == "", F.lit(True))
    seen = join_small(pages.select("page_id", "url", "domain", blank.alias("_blank"), F.coalesce(oversize(size), F.lit(False)).alias("_large")), conf, ["domain"])
    keyed = with_once(extract_cards(pages, domains), "dedup_key", I.dedup_key(F.col("values")))
    found = keyed.groupBy("page_id").agg(F.min("container").alias("container"), F.count(F.lit(1)).alias("n_cards"), F.count_distinct("dedup_key").alias("n_items"))
    rows = seen.join(found, "page_id", "left").withColumns({"n_cards": F.coalesce("n_cards", F.lit(0)), "n_items": F.coalesce("n_items", F.lit(0))})
    error = (
        F.when(F.col("_blank"), F.lit("no_content"))
        .when(F.col("_large"), F.lit("response_too_large"))
        .when(F.col("n_cards") == 0, F.lit("no_container"))
        .when(F.col("n_items") == 0, F.lit("no_items"))
    )
    return rows.select("page_id", "url", "domain", "container", "n_cards", "n_items", error.alias("error"))


def melt_items(items: DataFrame) -> DataFrame:
    """Long form: page_id, domain, pos, name, value."""
    return items.select("page_id", "domain", "pos", F.inline("values")).select(
        "page_id", "domain", "pos", "name", "value"
    )


def field_success(long_items: DataFrame, keys: list[str] = ["domain"]) -> DataFrame:  # noqa: B006
    """A field succeeds when it has a value in at least one item."""
    return long_items.groupBy(*keys, "name").agg(F.bool_or(F.col("value").isNotNull()).alias("success"))


def sample_first_item(long_items: DataFrame) -> DataFrame:
    """The first accepted item of a page represents it."""
    return long_items.groupBy("page_id", "name").agg(
        F.min_by("value", "pos").alias("value"), F.min("pos").alias("pos")
    )


def first_container(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Of the selectors with a match, the one listed first. ``counts``: keys, rank, selector, n."""
    return counts.where("n > 0").groupBy(*keys).agg(
        F.min_by("selector", "rank").alias("selector"), F.min_by("n", "rank").alias("n")
    )


def preview(items: DataFrame, n: int = 20) -> DataFrame:
    """The first rows shown to a person."""
    return items.orderBy("page_id", "pos").limit(n)
