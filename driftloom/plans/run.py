"""The whole run over a table of pages: comply, admit, extract, classify, repair, quarantine, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.operators import compliance, drift, extract, latest, quarantine, ratelimit, repair, reports
from driftloom.operators.sized import MAX_BROADCAST_IDS, join_small
from driftloom.session import reliable_checkpoint


@dataclass(frozen=True)
class SiteRun:
    """Output tables of one run. The tables that several outputs share are written once, to the folder of checkpoints."""

    pages: DataFrame
    now: Column
    entry: DataFrame
    extractions: DataFrame
    drift: DataFrame
    decisions: DataFrame
    holdout_verdicts: DataFrame

    def responses(self) -> DataFrame:
        """One row per page: success or the first error, the field map, the fields held back."""
        healed = self.decisions.select("page_id", "field_name", "outcome", F.col("value").alias("_healed"))
        values = (
            self.extractions.select("page_id", "field_name", "value")
            .join(healed, ["page_id", "field_name"], "left")
            .select(
                "page_id",
                "field_name",
                F.coalesce("_healed", "value").alias("value"),
                F.coalesce(F.col("outcome") != "auto_approved", F.lit(False)).alias("quarantined"),
            )
        )
        answers = reports.assemble_response(values, ["page_id"])
        whole = self.drift.where("drift_type = 'global'").select("page_id", F.lit("global_drift").alias("_drift"))
        return (
            self.entry.join(whole, "page_id", "left")
            .join(answers, "page_id", "left")
            .withColumn("error", F.coalesce("error", "_drift"))
            .select("page_id", "url", "domain", (F.col("error").isNull() & F.col("fields").isNotNull()).alias("success"), "error", "fields", "quarantined_fields")
        )

    def snapshots(self) -> DataFrame:
        return extract.lkg_snapshots(self.extractions, self.now)

    def quarantine(self) -> DataFrame:
        return quarantine.quarantine(self.decisions, self.pages, self.now)

    def registry_updates(self) -> DataFrame:
        return repair.registry_updates(self.decisions, self.now)

    def repair_log(self) -> DataFrame:
        return repair.repair_log(self.decisions, self.now)

    def global_failures(self) -> DataFrame:
        return repair.uniform_failure(self.holdout_verdicts)


def run_site(
    pages: DataFrame,
    fields: DataFrame,
    now: Column,
    *,
    postures: DataFrame,
    manifests: DataFrame,
    robots: DataFrame,
    fetches: DataFrame,
    responses: DataFrame,
    rates: DataFrame,
    open_breakers: DataFrame,
    candidates: DataFrame,
    holdouts: DataFrame,
    lkg: DataFrame,
    locks: DataFrame,
    reloads: DataFrame | None = None,
    threshold: float = repair.THRESHOLD,
) -> SiteRun:
    """Gate, extract, classify and decide; the result builds each output table when asked.

    ``pages``: page_id, url, html, domain, requested_at. ``open_breakers``: domains whose breaker
    is open. The gates run on narrow columns; pages are read again only to be parsed, and only
    those that passed. ``reloads``: the log of changed locators (``registry_updates`` of earlier runs belong to it); a page is
    extracted with the locators of its ``requested_at``, proposals are judged with those in force at the end of the log.
    """
    narrow = pages.select("page_id", "url", "domain", "requested_at")
    known = fields.select("domain").distinct().withColumn("_known", F.lit(True))
    audit = compliance.audit_compliance(narrow, postures, manifests, robots, fetches, responses, now)
    gated = narrow.join(known, "domain", "left").join(audit.select("page_id", "reason"), "page_id", "left")
    fit = gated.where("_known and reason is null").select(
        "page_id", "url", "domain", F.col("requested_at").alias("ts"), F.col("page_id").alias("id")
    )
    admitted = ratelimit.admit(fit, rates).select("page_id", F.col("allowed").alias("_allowed"))
    tripped = open_breakers.select("domain").distinct().withColumn("_open", F.lit(True))
    entry = (
        gated.join(admitted, "page_id", "left")
        .join(tripped, "domain", "left")
        .withColumn(
            "error",
            F.when(F.col("_known").isNull(), F.lit("no_configuration"))
            .when(F.col("reason").isNotNull(), F.concat(F.lit("compliance:"), F.col("reason")))
            .when(~F.coalesce("_allowed", F.lit(False)), F.lit("rate_limited"))
            .when(F.col("_open").isNotNull(), F.lit("breaker_open")),
        )
        .select("page_id", "url", "domain", "error")
    )
    entry = reliable_checkpoint(entry)
    # The few stopped pages are taken out, rather than the many others joined in: the pages
    # themselves are only shuffled when there are too many stops to broadcast.
    stopped = entry.where("error is not null").select("page_id")
    passed = join_small(pages, stopped, ["page_id"], "left_anti", MAX_BROADCAST_IDS)
    if reloads is None:
        found = extract.extract_fields(passed, fields)
    else:
        found = extract.extract_at(passed, latest.locator_versions(fields, reloads))
        current = latest.latest(reloads, latest.LKG_KEYS, ["updated_at", "seq"])
        fields = latest.effective_locators(fields, current)
    extractions = reliable_checkpoint(found)
    verdicts = drift.classify_drift(extractions)
    local = verdicts.where("drift_type = 'local'").select("page_id")
    failed = extractions.where("not success").join(local, "page_id", "left_semi")
    proposals = candidates.join(failed.select("page_id", "field_name"), ["page_id", "field_name"], "left_semi")
    scored = repair.score_candidates(proposals, passed, lkg)
    checked = repair.cross_validate(proposals, holdouts, fields)
    decisions = reliable_checkpoint(repair.decide(failed, fields, scored, checked, locks, threshold))
    return SiteRun(pages, now, entry, extractions, verdicts, decisions, checked)
