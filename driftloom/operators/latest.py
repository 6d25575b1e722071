"""Newest-per-key views over append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.operators.chunks import running

LKG_KEYS = ["domain", "field_name"]
LKG_SIZE = 5


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key. An aggregate, so each map task sends one row per key, hot or not."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*df.columns)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest-wins merge of a table with newer rows."""
    return latest(current.unionByName(changes), keys, order)


def newest_n(df: DataFrame, keys: list[str], order: list[str], n: int, rank: str | None = None) -> DataFrame:
    """Newest ``n`` rows per key.

    Spark limits the groups before the shuffle as well (WindowGroupLimit), so a hot key costs
    at most ``n`` rows per map task.
    """
    w = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    name = rank or "_rn"
    ranked = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def lkg_window(snapshots: DataFrame, n: int = LKG_SIZE, order: list[str] | None = None) -> DataFrame:
    """Last-known-good samples: the newest ``n`` per field of a domain, older ones evicted."""
    return newest_n(snapshots, LKG_KEYS, order or ["snapshot_at", "snapshot_id"], n)


def lkg_latest(snapshots: DataFrame, order: list[str] | None = None) -> DataFrame:
    return latest(snapshots, LKG_KEYS, order or ["snapshot_at", "snapshot_id"])


def lkg_history(snapshots: DataFrame, domain: str, field: str, limit: int = LKG_SIZE) -> DataFrame:
    """One field's samples, newest first. For many fields at once, ``lkg_window`` of the samples that semi-join them."""
    one = (F.col("domain") == domain) & (F.col("field_name") == field)
    return snapshots.where(one).orderBy(F.desc("snapshot_at"), F.desc("snapshot_id")).limit(limit)


def lkg_rollback(snapshots: DataFrame, steps: int = 1, n: int = LKG_SIZE, order: list[str] | None = None) -> DataFrame:
    """Drop the newest ``steps`` samples of each window; what is left starts at the new latest."""
    order = order or ["snapshot_at", "snapshot_id"]
    return newest_n(snapshots, LKG_KEYS, order, n, rank="_age").where(F.col("_age") > steps).drop("_age")


def lkg_as_of(moments: DataFrame, snapshots: DataFrame, at: str, key: str, snapshot_order: list[str] | None = None) -> DataFrame:
    """For each moment the newest sample of its field at or before ``at``, over the whole history.

    Moments and samples are one timeline per field. A running maximum over it carries the newest sample forward in time chunks, so no
    moment is multiplied and a hot field is spread over its chunks. A moment without time or field has no sample.
    """
    order = snapshot_order or ["snapshot_at", "snapshot_id"]
    sample = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*[c for c in snapshots.columns if c not in LKG_KEYS]).alias("_s"))
    moment = F.struct(*[c for c in moments.columns if c not in LKG_KEYS])
    events = snapshots.select(*LKG_KEYS, F.col(order[0]).alias("_at"), F.lit(0).alias("_kind"), sample.alias("_sample"))
    waiting = moments.select(*LKG_KEYS, F.col(at).alias("_at"), F.lit(1).alias("_kind"), moment.alias("_moment"))
    timeline = events.unionByName(waiting, allowMissingColumns=True)
    sound = F.col("_at").isNotNull() & F.col(LKG_KEYS[0]).isNotNull() & F.col(LKG_KEYS[1]).isNotNull()
    found = running(timeline.where(sound), LKG_KEYS, "_at", ["_at", "_kind"], maxes={"_newest": F.col("_sample")}).where("_kind = 1")
    lost = timeline.where("_kind = 1").where(~sound).withColumn("_newest", F.lit(None).cast(timeline.schema["_sample"].dataType))
    rows = found.select(*LKG_KEYS, "_moment", "_newest").unionByName(lost.select(*LKG_KEYS, "_moment", "_newest"))
    out = rows.select(*LKG_KEYS, "_moment.*", F.col("_newest._s").alias("lkg"))
    return out.select(key, *[c for c in moments.columns if c != key], "lkg")


def registry_current(config: DataFrame, reloads: DataFrame) -> DataFrame:
    """Locators in force: configured selectors at time zero, then hot reloads, last write wins.

    ``config``: domain, field_name, selector, strategy. ``reloads`` adds updated_at and seq.
    """
    base = config.withColumns({"updated_at": F.timestamp_seconds(F.lit(0)), "seq": F.lit(-1).cast("bigint")})
    columns = ["domain", "field_name", "selector", "strategy", "updated_at", "seq"]
    return latest(base.select(columns).unionByName(reloads.select(columns)), LKG_KEYS, ["updated_at", "seq"])


def effective_locators(fields: DataFrame, registry: DataFrame) -> DataFrame:
    """Field definitions with a registry override where there is one."""
    override = registry.select(
        "domain", F.col("field_name").alias("name"), F.col("selector").alias("_sel"), F.col("strategy").alias("_strat")
    )
    return (
        fields.join(override, ["domain", "name"], "left")
        .withColumns({"selector": F.coalesce("_sel", "selector"), "strategy": F.coalesce("_strat", "strategy")})
        .drop("_sel", "_strat")
    )


def locator_versions(fields: DataFrame, reloads: DataFrame) -> DataFrame:
    """Field definitions with the time they hold: (domain, valid_from, valid_to) and the columns of ``fields``.

    Every reload of a domain begins a version of all its fields; each field has the newest reload at or before that time, else its
    configured selector. The first version holds from time zero, the last one has no end. ``reloads``: domain, field_name, selector,
    strategy, updated_at, seq; of reloads at one time the highest seq wins. All of it is configuration and its history, not data.
    """
    starts = reloads.select("domain", F.col("updated_at").alias("valid_from")).where("valid_from is not null")
    zero = fields.select("domain", F.timestamp_seconds(F.lit(0)).alias("valid_from"))
    # A time before zero begins no version of its own: what it set holds from zero on.
    starts = starts.where(F.col("valid_from") >= F.timestamp_seconds(F.lit(0))).union(zero).distinct()
    ends = starts.withColumn("valid_to", F.lead("valid_from").over(W.partitionBy("domain").orderBy("valid_from")))
    grid = fields.join(ends, "domain").withColumn("field_name", F.col("name"))
    found = lkg_as_of(grid, reloads.select(*LKG_KEYS, "updated_at", "seq", "selector", "strategy"), "valid_from", "domain", ["updated_at", "seq"])
    override = {c: F.when(F.col("lkg").isNotNull(), F.col(f"lkg.{c}")).otherwise(F.col(c)) for c in ("selector", "strategy")}
    return found.withColumns(override).select(*fields.columns, "valid_from", "valid_to")
