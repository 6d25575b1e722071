"""Proposed selector repairs: score, cross-validate, decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions import ids, page, parsing, similarity
from driftloom.operators.sized import join_small

THRESHOLD = 0.75
FIELD_KEYS = ["domain", "field_name"]
SELECTOR_KEYS = [*FIELD_KEYS, "selector", "strategy"]


def score_candidates(candidates: DataFrame, pages: DataFrame, lkg: DataFrame) -> DataFrame:
    """Confidence of each proposal: apply it to its page, compare with the latest good sample.

    ``candidates``: page_id, domain, field_name, selector, strategy, role_name, role_type.
    A page carries at most one proposal per failed field, so its group is bounded by the config.
    """
    proposal = F.struct("field_name", "selector", "strategy", "role_name", "role_type")
    per_page = candidates.groupBy("page_id", "domain").agg(F.collect_list(proposal).alias("_c"))
    nodes = (
        join_small(pages.select("page_id", "html"), per_page, ["page_id"])
        .select("page_id", "domain", "_c", page.select_nodes("html", "_c").alias("_n"), page.page_outline(F.col("html")).alias("_page"))
        .select("page_id", "domain", "_page", F.explode_outer(F.arrays_zip("_c", "_n")).alias("_z"))
        .select("page_id", "domain", "_page", "_z._c.*", "_z._n.tag", "_z._n.value")
    )
    known = lkg.select(
        *FIELD_KEYS,
        F.lit(True).alias("_has"),
        F.col("outline").alias("_outline"),
        F.col("text_signature").alias("_text"),
        F.col("strategy").alias("_role"),
        F.col("sample_value").alias("_sample"),
    )
    # One sample per field of a domain, usually few: page outlines are then not shuffled to meet them.
    scored = join_small(nodes, known, FIELD_KEYS, "left")
    outline = F.coalesce(page.element_outline(F.col("tag"), F.col("value")), F.col("_page"))
    score = similarity.confidence(
        outline=outline,
        text=F.col("value"),
        role=F.coalesce(F.nullif("role_type", F.lit("")), F.nullif("role_name", F.lit("")), F.col("strategy")),
        has_baseline=F.coalesce("_has", F.lit(False)),
        known_outline=F.col("_outline"),
        known_text=F.col("_text"),
        known_role=F.col("_role"),
        known_sample=F.col("_sample"),
    )
    return scored.select(
        "page_id", *SELECTOR_KEYS, F.col("value").alias("candidate_value"), score.alias("confidence")
    )


def cross_validate(candidates: DataFrame, holdouts: DataFrame, fields: DataFrame) -> DataFrame:
    """Verdict per distinct proposed selector over its domain's hold-out pages.

    ``holdouts``: domain, url, html (null when the page did not load). A page passes when the
    selector yields a non-blank value of the field's type. No hold-outs configured passes as
    (1, 1); none loaded fails. Counts are aggregated map-side, page by page.
    """
    proposals = candidates.select(*SELECTOR_KEYS).distinct()
    typed = proposals.join(
        fields.select("domain", F.col("name").alias("field_name"), "field_type", "required"), FIELD_KEYS, "left"
    )
    # A domain's proposals are configuration: bundled, they meet each page once, and a page is parsed once for all of them.
    bundle = typed.groupBy("domain").agg(F.collect_list(F.struct(*[c for c in typed.columns if c != "domain"])).alias("_proposals"))
    tried = join_small(holdouts.select("domain", F.col("url").alias("_url"), "html"), bundle, ["domain"])
    wanted = F.transform("_proposals", lambda p: F.struct(p["selector"].alias("selector"), p["strategy"].alias("strategy")))
    nodes = F.coalesce(page.select_nodes("html", wanted), F.transform("_proposals", lambda p: page.failed_node("not_loaded")))
    answers = tried.select("domain", "_url", F.col("html").isNotNull().alias("_loaded"), F.explode_outer(F.arrays_zip("_proposals", nodes.alias("_node"))).alias("_z"))
    checked = answers.select("domain", "_z._proposals.*", "_url", "_loaded", F.col("_z._node.value").alias("_v")).unionByName(
        typed.withColumns({"_url": F.lit(None).cast("string"), "_loaded": F.lit(False), "_v": F.lit(None).cast("string")})
    )
    blank = F.col("_v").isNull() | (F.col("_v") == "")
    ok = ~blank & parsing.type_failure(F.col("_v"), F.coalesce("field_type", F.lit("string")), F.col("required")).isNull()
    counts = checked.groupBy(*SELECTOR_KEYS).agg(
        F.count("_url").alias("_configured"),
        F.count_if("_loaded").alias("_loaded"),
        F.count_if(F.col("_loaded") & ok).alias("_passed"),
    )
    free = F.col("_configured") == 0
    return counts.select(
        *SELECTOR_KEYS,
        (free | ((F.col("_loaded") > 0) & (F.col("_passed") == F.col("_loaded")))).alias("holdout_passed"),
        F.when(free, 1).otherwise(F.col("_passed")).cast("bigint").alias("pass_count"),
        F.when(free, 1).otherwise(F.col("_loaded")).cast("bigint").alias("total"),
    )


def uniform_failure(verdicts: DataFrame) -> DataFrame:
    """Verdicts where every hold-out page failed: a site-wide change, counted as global drift."""
    return verdicts.where("pass_count = 0 and total > 0")


def confidence_split(df: DataFrame, threshold: float = THRESHOLD, score: str = "confidence") -> tuple[DataFrame, DataFrame]:
    approved = F.coalesce(F.col(score) >= threshold, F.lit(False))
    return df.where(approved), df.where(~approved)


def outcome(locked: Column, wellformed: Column, holdout_passed: Column, confidence: Column, threshold: float = THRESHOLD) -> Column:
    """Healing outcome of one failed field; the order of the tests is the order of the steps."""
    no = F.lit(False)
    return (
        F.when(F.coalesce(locked, no), F.lit("rejected_breaker"))
        .when(~F.coalesce(wellformed, no), F.lit("failed"))
        .when(~F.coalesce(holdout_passed, no), F.lit("rejected_overfit"))
        .when(F.coalesce(confidence >= threshold, no), F.lit("auto_approved"))
        .otherwise(F.lit("quarantined"))
    )


def decide(
    failed: DataFrame,
    fields: DataFrame,
    scored: DataFrame,
    verdicts: DataFrame,
    locks: DataFrame,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One outcome per failed field of a page; fields without a definition are skipped.

    ``failed``: page_id, page_url, domain, field_name, selector_used. ``locks``: the locked
    fields. Auto-approved rows carry the value the new selector found, all others null.
    """
    defined = fields.select("domain", F.col("name").alias("field_name"))
    locked = locks.select(*FIELD_KEYS).distinct().withColumn("_locked", F.lit(True))
    rows = (
        failed.select("page_id", "page_url", *FIELD_KEYS, "selector_used")
        .join(defined, FIELD_KEYS, "left_semi")
        .join(scored, ["page_id", *FIELD_KEYS], "left")
        .join(verdicts, SELECTOR_KEYS, "left")
        .join(locked, FIELD_KEYS, "left")
    )
    safe = ids.candidate_wellformed(F.col("selector")) & ids.selector_safe(F.col("selector"), F.col("strategy"))
    decided = rows.withColumn(
        "outcome", outcome(F.col("_locked"), safe, F.col("holdout_passed"), F.col("confidence"), threshold)
    )
    approved = F.col("outcome") == "auto_approved"
    return decided.select(
        "page_id",
        "page_url",
        *FIELD_KEYS,
        F.col("selector_used").alias("old_selector"),
        F.col("selector").alias("proposed_selector"),
        F.col("strategy").alias("proposed_strategy"),
        "confidence",
        "outcome",
        F.when(approved, F.col("candidate_value")).alias("value"),
    )


def registry_updates(decisions: DataFrame, now: Column) -> DataFrame:
    """Hot-reload log rows of the approved repairs."""
    return decisions.where("outcome = 'auto_approved'").select(
        *FIELD_KEYS,
        F.col("proposed_selector").alias("selector"),
        F.col("proposed_strategy").alias("strategy"),
        now.alias("updated_at"),
        F.col("page_id").cast("bigint").alias("seq"),
    )


def repair_log(decisions: DataFrame, now: Column) -> DataFrame:
    """Repair-history rows of the approved repairs."""
    return decisions.where("outcome = 'auto_approved'").select(
        *FIELD_KEYS,
        "old_selector",
        F.col("proposed_selector").alias("new_selector"),
        F.col("confidence").alias("confidence_score"),
        now.alias("repaired_at"),
    )
