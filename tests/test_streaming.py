"""Streams against their batch twins, over files that arrive one after the other."""

import pytest
from pyspark.sql import functions as F

from driftloom.operators import drift, latest, ratelimit, stats
from driftloom.plans import inputs
from driftloom.sources import tables
from driftloom.streaming import flows, stateful


def arriving(spark, df, tmp_path, order, n=3):
    """The rows as a stream of ``n`` files in the given order."""
    path = str(tmp_path / "in")
    rows = df.orderBy(order).toPandas()
    size = -(-len(rows) // n)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows.iloc[i : i + size], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)


def run(stream, tmp_path, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name)
    q = q.option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None
    return stream.sparkSession.table(name)


def same(a, b, columns):
    a, b = a.select(columns), b.select(columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture(scope="module")
def events(spark, sf):
    return inputs.events(spark, sf).withColumn("domain", F.concat(F.lit("d"), F.col("user_id") % 3)).cache()


@pytest.fixture
def variables(spark):
    stateful.use_state_variables(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_admission(spark, events, tmp_path, variables):
    rows = events.select("domain", "ts", "id")
    stream = arriving(spark, rows, tmp_path, "ts").withWatermark("ts", "1 hour")
    out = run(stateful.admit_stream(stream, capacity=2.0, rate=1 / 7200.0), tmp_path, "admitted")
    rates = rows.select("domain").distinct().select("domain", F.lit(2.0).alias("capacity"), F.lit(1 / 7200.0).alias("rate"))
    assert same(out, ratelimit.admit(rows, rates), ["id", "allowed", "tokens_left", "wait_seconds"])


def test_admission_with_changing_rates_asked_tokens_and_expiry(spark, events, tmp_path, variables):
    rows = events.select("domain", "ts", "id", (F.col("id") % 3 / 2 + 0.5).alias("tokens"))
    low, high = (r for r in rows.agg(F.min("ts"), F.max("ts")).first())
    middle = low + (high - low) / 2
    rates = spark.createDataFrame([("d0", 2.0, 1 / 7200.0, None), ("d0", 5.0, 1 / 600.0, middle), ("d1", 1.5, 1 / 3600.0, middle)], "domain string, capacity double, rate double, valid_from timestamp")
    manifests = spark.createDataFrame([("d2", low + (high - low) * 3 / 4), ("d0", high)], "domain string, expires_at timestamp")
    whole = ratelimit.admit(rows, rates, manifests)
    verdict = ["id", "allowed", "tokens_left", "wait_seconds"]
    stream = arriving(spark, rows, tmp_path, "ts", n=5).withWatermark("ts", "1 hour")
    out = run(stateful.admit_stream(stream, rates=rates, manifests=manifests), tmp_path, "termed")
    assert same(out, whole, verdict) and out.where("wait_seconds = -1").count() > 0


def test_admission_goes_on_from_a_judged_log(spark, events, tmp_path, variables):
    rows = events.select("domain", "ts", "id")
    low, high = (r for r in rows.agg(F.min("ts"), F.max("ts")).first())
    rates = rows.select("domain").distinct().select("domain", F.lit(8.0).alias("capacity"), F.lit(1 / 86400.0).alias("rate"))
    middle = low + (high - low) / 2
    first, rest = ratelimit.admit(rows.where(F.col("ts") < middle), rates), rows.where(F.col("ts") >= middle)
    stream = arriving(spark, rest, tmp_path, "ts").withWatermark("ts", "1 hour")
    out = run(stateful.admit_stream(stream, rates=rates, initial=ratelimit.bucket_state(first)), tmp_path, "resumed")
    whole = ratelimit.admit(rows, rates).where(F.col("ts") >= middle)
    assert same(out, whole, ["id", "allowed"]) and whole.where("not allowed").count() > 0


def test_thrash(spark, sf, tmp_path):
    log = inputs.repair_events(spark, sf)
    out = run(stateful.thrash_stream(arriving(spark, log, tmp_path, "ts"), limit=3), tmp_path, "thrash")
    assert same(out, drift.thrash_lock(log, limit=3), ["id", "repairs", "locked"])


def test_anomalies(spark, events, tmp_path):
    rows = events.select("domain", "ts", "id", "value")
    out = run(stateful.anomaly_stream(arriving(spark, rows, tmp_path, "ts"), ["domain"], 2.0), tmp_path, "anomalies")
    assert same(out, stats.gated_zscore(rows, ["domain"], F.lit(2.0)), ["id", "prior_n", "valid"])


def test_debounce(spark, sf, tmp_path):
    runs = inputs.run_log(spark, sf).withColumn("drift_type", drift.drift_type(F.col("failed"), F.col("total")))
    rows = runs.select("domain", "ts", "id", "drift_type", "is_reset")
    out = run(stateful.debounce_stream(arriving(spark, rows, tmp_path, "ts")), tmp_path, "debounced")
    assert same(out, drift.debounce_state(rows), ["domain", "id", "global_failures", "state"])


def test_lkg_samples(spark, sf, tmp_path):
    samples = inputs.snapshots(spark, sf)
    stream = arriving(spark, samples, tmp_path, "snapshot_at")
    flows.lkg_stream(stream, str(tmp_path / "lkg"), str(tmp_path / "cp")).awaitTermination()
    kept = flows.read_lkg(spark, str(tmp_path / "lkg"))
    assert same(kept, latest.lkg_window(samples), samples.columns)


def test_requests_are_deduplicated(spark, tmp_path):
    rows = spark.sql(
        "SELECT concat('r', id % 5) request_id, 'u' url, 'd' domain, 1 priority, timestamp_seconds(1704067200 + id) requested_at FROM range(20)"
    )
    out = run(flows.dedup_requests(arriving(spark, rows, tmp_path, "requested_at")), tmp_path, "deduped")
    assert out.count() == 5


def test_request_folder(spark, tmp_path):
    spark.sql("SELECT 'r1' request_id, 'http://a/' url, 'a' domain, 2 priority").write.json(str(tmp_path / "in"))
    out = run(tables.read_requests_stream(spark, str(tmp_path / "in")), tmp_path, "requests")
    assert out.first()["priority"] == 2


def test_windowed_counters(spark, events, tmp_path):
    rows = events.select(
        F.lit("m").alias("metric"), "domain", F.lit(None).cast("string").alias("field"), F.col("event_type").alias("detail"), "ts"
    )
    out = run(flows.metrics_stream(arriving(spark, rows, tmp_path, "ts")), tmp_path, "windowed", "complete")
    plain = rows.groupBy(F.date_trunc("hour", "ts").alias("window_start"), "metric", "domain", "field", "detail").agg(F.count(F.lit(1)).alias("value"))
    assert same(out, plain, plain.columns)


def test_windowed_histogram(spark, events, tmp_path):
    rows = events.select("domain", "ts", (F.col("value") / 20).alias("seconds"))
    out = run(flows.histogram_stream(arriving(spark, rows, tmp_path, "ts"), ["domain"], "seconds"), tmp_path, "histo", "complete")
    assert out.agg(F.sum("count")).first()[0] == rows.count()
    assert out.where("le_0_5 > le_1_0 or le_10_0 > count").isEmpty()


def test_retention(spark, tmp_path):
    rows = spark.sql(
        "SELECT concat('s', id) snapshot_id, timestamp_seconds(1704067200 + id * 86400) quarantined_at, "
        "timestamp_seconds(1704067200 + (id + 7) * 86400) retention_expires_at FROM range(20)"
    )
    stream = arriving(spark, rows, tmp_path, "quarantined_at", n=5).withWatermark("quarantined_at", "0 seconds")
    out = {r["snapshot_id"] for r in run(stateful.retention_stream(stream), tmp_path, "retention").collect()}
    # The last watermark is day 19, so everything that expired before it is out.
    assert out == {f"s{i}" for i in range(12)}


def test_arriving_pages(spark, sf, tmp_path):
    raw = spark.read.parquet(f"{sf}/pages.parquet")
    fields, rules = inputs.fields(spark, sf), inputs.rules(spark)
    stream = arriving(spark, raw, tmp_path, "page_id", n=2)
    flows.page_stream(stream, fields, rules, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out" / "extractions"))
    assert same(found, inputs.extractions(spark, sf), ["page_id", "field_name", "value", "success"])
    assert spark.read.parquet(str(tmp_path / "out" / "validations")).count() > 0
