"""Field extraction from pages: one row per page and configured field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions import page, text
from driftloom.operators.once import with_once
from driftloom.operators.sized import join_small
from driftloom.session import reliable_checkpoint

MAX_PAGE_BYTES = 50 * 1024 * 1024
FIELD = ["name", "selector", "strategy", "field_type", "volatility", "required"]


def oversize(length: Column) -> Column:
    """A response too large to handle; an unknown length is fine."""
    return F.coalesce(length > MAX_PAGE_BYTES, F.lit(False))


def bundle_fields(fields: DataFrame, keys: list[str]) -> DataFrame:
    """One row per domain (and version) with its field definitions in order, so a page is parsed only once.

    ``parse`` tells whether any selector of the domain needs a parsed page. A group is one
    domain's configuration, never its data.
    """
    defs = fields.withColumn("pattern", page.selector_pattern(F.col("selector"), F.col("strategy")))
    member = F.struct("position", *FIELD, "pattern")
    return (
        defs.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(member)).alias("wanted"), F.bool_or(F.col("pattern").isNull()).alias("parse"))
    )


def unconfigured(pages: DataFrame, fields: DataFrame) -> DataFrame:
    """Pages whose domain has no configuration, as error rows."""
    error = F.concat(F.lit("No configuration found for domain '"), F.col("domain"), F.lit("'"))
    return pages.join(fields.select("domain").distinct(), "domain", "left_anti").select(
        "page_id", "url", "domain", error.alias("error")
    )


def hits(html: Column, wanted: Column, parse: Column | None = None) -> Column:
    """Nodes for an array of selectors: natively where ``parse`` is false, else by one parse."""
    parsed = page.select_nodes(F.when(parse, html) if parse is not None else html, wanted)
    if parse is None:
        return parsed
    native = page.native_nodes(page.without_code(html), wanted)
    return F.when(parse, parsed).otherwise(native)


def extract_fields(pages: DataFrame, fields: DataFrame, engine: str = "auto") -> DataFrame:
    """First match per page and field, text trimmed.

    ``engine``: ``parser`` parses every page; ``auto`` parses the pages of domains with a selector that no exact pattern covers, and
    all pages whose markup a pattern could misread, so both give the same rows. A page too large to handle is not read: each of its
    fields gets an error row.
    """
    return _extracted(join_small(_wide(pages), bundle_fields(fields, ["domain"]), ["domain"]), engine)


def extract_at(pages: DataFrame, versions: DataFrame, at: str = "requested_at", engine: str = "auto", chunk_seconds: int = 86400) -> DataFrame:
    """``extract_fields`` with the definitions in force at each page's time. ``versions``: of ``latest.locator_versions``.

    An interval join: a version is listed in the time chunks that it touches and that have pages, so a page meets only the versions of
    its domain and chunk, by an equi-join, and one of them holds at its time. Pages are not multiplied, and not shuffled while the
    versions are small. A page without a time has no definitions in force and gives no rows.
    """
    chunk = lambda t: F.floor(F.unix_seconds(t) / chunk_seconds)
    wide = _wide(pages, at).withColumn("_chunk", chunk(F.col("_at")))
    # Configuration and the chunks in use are small and read several times over: written once.
    bundles = reliable_checkpoint(bundle_fields(versions, ["domain", "valid_from", "valid_to"]))
    used = reliable_checkpoint(wide.select("domain", "_chunk").distinct())
    spans = bundles.select("domain", "valid_from", "valid_to").join(used, "domain").where(
        (F.col("_chunk") >= chunk(F.col("valid_from"))) & (F.col("valid_to").isNull() | (F.col("_chunk") <= chunk(F.col("valid_to"))))
    )
    listed = spans.join(bundles, (spans["domain"] == bundles["domain"]) & (spans["valid_from"] == bundles["valid_from"])).select(
        spans["domain"], "_chunk", spans["valid_from"].alias("_from"), spans["valid_to"].alias("_to"), "wanted", "parse"
    )
    met = join_small(wide, listed, ["domain", "_chunk"])
    holds = (F.col("_from") <= F.col("_at")) & (F.col("_to").isNull() | (F.col("_at") < F.col("_to")))
    return _extracted(met.where(holds), engine)


def _wide(pages: DataFrame, at: str | None = None) -> DataFrame:
    time = [F.col(at).alias("_at")] if at else []
    return pages.select("page_id", "url", "domain", "html", oversize(F.octet_length("html")).alias("_large"), *time)


def _extracted(joined: DataFrame, engine: str) -> DataFrame:
    html = F.when(~F.col("_large"), F.col("html"))
    if engine == "parser":
        nodes = hits(html, F.col("wanted"))
    else:
        joined = with_once(joined, "_parse", F.col("parse") | ~F.coalesce(page.plain(html), F.lit(True)))
        nodes = hits(html, F.col("wanted"), F.col("_parse"))
    refused = F.transform("wanted", lambda w: page.failed_node("response_too_large"))
    nodes = F.when(F.col("_large"), refused).otherwise(nodes)
    pairs = joined.select(
        "page_id", F.col("url").alias("page_url"), "domain", F.arrays_zip("wanted", nodes.alias("node")).alias("_pairs")
    )
    # The outer form: for the plain one a filter would be inferred that parses the page again.
    return pairs.select("page_id", "page_url", "domain", F.explode_outer("_pairs").alias("_p")).select(
        "page_id",
        "page_url",
        "domain",
        F.col("_p.wanted.name").alias("field_name"),
        F.col("_p.wanted.selector").alias("selector_used"),
        *[F.col(f"_p.wanted.{c}").alias(c) for c in FIELD[2:]],
        F.col("_p.node.tag").alias("tag"),
        F.col("_p.node.value").alias("value"),
        F.col("_p.node.error").isNull().alias("success"),
        F.col("_p.node.error").alias("error"),
    )


def split_outcomes(extractions: DataFrame) -> tuple[DataFrame, DataFrame]:
    return extractions.where("success"), extractions.where("not success")


def lkg_snapshots(extractions: DataFrame, snapshot_at: Column) -> DataFrame:
    """One last-known-good sample per successful extraction, its text cut to 200 characters."""
    return extractions.where("success").select(
        "domain",
        "field_name",
        F.col("selector_used").alias("selector"),
        "strategy",
        page.element_outline(F.col("tag"), F.col("value")).alias("outline"),
        text.text_signature(F.col("value")).alias("text_signature"),
        F.col("value").alias("sample_value"),
        "page_url",
        snapshot_at.alias("snapshot_at"),
        F.col("page_id").alias("snapshot_id"),
    )
