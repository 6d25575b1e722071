import json

import pytest
from pyspark.sql import functions as F

from driftloom.operators import latest, stats, validate
from driftloom.plans import inputs
from driftloom.sources import config, statelog, tables

DOMAIN = {
    "domain": "books.example",
    "rate_limit": {"requests_per_minute": 20},
    "fields": [{"name": "title", "selector": "h1"}, {"name": "price", "selector": ".p", "field_type": "float", "required": False}],
    "holdout_urls": ["https://books.example/1", "https://books.example/2"],
}


def _write(folder, name, doc):
    (folder / name).write_text(doc if isinstance(doc, str) else json.dumps(doc, indent=1))


def test_domains_with_defaults_and_a_bad_file(spark, tmp_path):
    _write(tmp_path, "a.json", DOMAIN)
    _write(tmp_path, "b.json", {"domain": "flat.example", "rate_limit_rpm": 60, "burst_capacity": 3, "multi_item": True, "item_container": "li"})
    _write(tmp_path, "c.json", "{ not json")
    rows = {r["domain"]: r for r in config.load_domains(spark, str(tmp_path)).collect()}
    assert set(rows) == {"books.example", "flat.example"}
    a, b = rows["books.example"], rows["flat.example"]
    assert (a["rate_limit_rpm"], a["burst_capacity"], b["rate_limit_rpm"], b["burst_capacity"]) == (20, 5, 60, 3)
    assert (a["fields"][0]["strategy"], a["fields"][0]["required"], a["fields"][1]["required"], a["fields"][0]["volatility"]) == ("css", True, False, "medium")
    assert config.holdout_table(config.load_domains(spark, str(tmp_path))).count() == 2
    assert [r["position"] for r in config.field_table(config.load_domains(spark, str(tmp_path))).orderBy("position").collect()] == [0, 1]
    rates = {r["domain"]: (r["capacity"], r["rate"]) for r in config.rate_table(config.load_domains(spark, str(tmp_path))).collect()}
    assert rates["flat.example"] == (3.0, 1.0)


def test_missing_files_give_defaults(spark, tmp_path):
    assert config.load_rules(spark, f"{tmp_path}/none.json").isEmpty()
    assert config.load_postures(spark, f"{tmp_path}/none.json").isEmpty()
    got = {r["profile"]: r["sigma_threshold"] for r in config.load_volatility(spark, f"{tmp_path}/none.json").collect()}
    assert got == {"low": 2.0, "medium": 3.0, "high": 5.0}


def test_rules_volatility_postures_manifests(spark, tmp_path):
    _write(tmp_path, "r.json", {"rules": [{"field": "price", "op": "gt", "value": 0, "context": {"t": "x"}}, {"field": "k", "op": "in", "values": ["a"]}]})
    _write(tmp_path, "v.json", {"profiles": {"low": {"sigma_threshold": 1.5}}})
    _write(tmp_path, "p.json", {"domains": {"a.example": {"posture": "adversarial_commercial"}}})
    _write(tmp_path, "m.json", {"approver": "x", "expiration_date": "2030-01-01T00:00:00Z", "authorized_domains": ["a.example"]})
    r = config.load_rules(spark, f"{tmp_path}/r.json").orderBy("position").collect()
    assert (r[0]["value"], r[0]["context"], r[1]["values"]) == ("0", {"t": "x"}, ["a"])
    v = {x["profile"]: x["sigma_threshold"] for x in config.load_volatility(spark, f"{tmp_path}/v.json").collect()}
    assert v == {"low": 1.5, "medium": 3.0, "high": 5.0}
    assert config.load_postures(spark, f"{tmp_path}/p.json").first()["posture"] == "adversarial_commercial"
    assert config.load_manifests(spark, f"{tmp_path}/m.json").first()["signature_ok"] is False


def test_provider_envelopes_lists_and_bare_records(spark, tmp_path):
    rec = {"url": "https://www.s.example/1", "title": "A", "price": "N/A"}
    _write(tmp_path, "1.json", {"collection_id": "c", "status": "ready", "total_records": 1, "data": [rec]})
    _write(tmp_path, "2.json", {"collection_id": "d", "status": "running", "data": [rec]})
    _write(tmp_path, "3.json", rec)
    _write(tmp_path, "4.json", [rec, rec])
    records = tables.read_provider_batches(spark, str(tmp_path))
    assert records.count() == 4
    rows = tables.provider_extractions(records, ["title", "price"]).distinct().collect()
    assert {(r["domain"], r["field_name"], r["value"], r["success"]) for r in rows} == {("s.example", "title", "A", True), ("s.example", "price", None, False)}


def test_response_documents(spark, tmp_path):
    doc = [{"request_id": "r", "domain": "d", "url": "u", "timestamp": "2026-01-01T00:00:00Z", "status": "SUCCESS", "extracted_data": {"title": "T", "price": 5.5},
            "validation": {"type_checks_passed": True, "z_score": 0.4}, "drift_detected": False, "quarantined": False}]
    _write(tmp_path, "r.json", doc)
    row = tables.read_responses(spark, f"{tmp_path}/r.json").first()
    assert (row["title"], row["price"], row["type_checks_passed"], row["z_score"]) == ("T", 5.5, True, 0.4)


def test_dataset_round_trip(spark, sf, tmp_path):
    from driftloom.operators import items

    found = items.extract_items(inputs.pages(spark, sf), inputs.listing_domains(spark, sf))
    docs = tables.dataset_documents(found)
    tables.write_dataset(docs, f"{tmp_path}/out")
    back = spark.read.json(f"{tmp_path}/out")
    assert back.count() == docs.count()
    assert back.agg(F.sum("total_items")).first()[0] == found.count()


def test_state_log_and_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, seq long, v string")
    path = f"{tmp_path}/state"
    tables.append_state(rows.where("seq = 1"), path)
    tables.append_state(rows.where("seq = 2"), path)
    assert {r["k"]: r["v"] for r in tables.read_state(spark, path, ["k"], ["seq"]).collect()} == {"a": "y", "b": "z"}
    tables.compact_state(spark, path, f"{tmp_path}/compact", ["k"], ["seq"])
    assert spark.read.parquet(f"{tmp_path}/compact").count() == 2
    snaps = spark.sql("SELECT 's1' snapshot_id, 'c' content, TIMESTAMP'2024-01-02 03:00:00' quarantined_at")
    tables.write_snapshots(snaps, f"{tmp_path}/snap")
    assert tables.read_snapshots(spark, f"{tmp_path}/snap", F.lit("2024-01-02").cast("date")).first()["content"] == "c"
    assert tables.read_snapshots(spark, f"{tmp_path}/snap", F.lit("2024-01-03").cast("date")).isEmpty()


def test_accepted_values_feed_the_next_run(spark):
    from datetime import datetime

    rows = [("d", "price", "k", v, "float", "low", True, None, datetime(2024, 1, 1), i) for i, v in enumerate(("5", "£6", "bad"))]
    ext = spark.createDataFrame(rows, "domain string, field_name string, item_key string, value string, field_type string, volatility string, required boolean, context map<string,string>, ts timestamp, id long")
    row = validate.accepted_stats(validate.check_values(ext, inputs.rules(spark))).first()
    assert (row["value_count"], row["value_sum"], row["last_value"]) == (2, 11.0, 6.0)


def _log(spark, tmp_path, every=3):
    return statelog.StateLog(spark, f"{tmp_path}/log", lambda rows: latest.latest(rows, ["k"], ["seq"]), every)


def test_a_run_counts_once_and_only_when_committed(spark, tmp_path):
    log = _log(spark, tmp_path)
    assert log.read("k string, seq long").isEmpty()
    with pytest.raises(ValueError):
        log.read()
    rows = lambda seq: spark.createDataFrame([("a", seq), (f"b{seq}", seq)], "k string, seq long")
    current = lambda: {r["k"]: r["seq"] for r in log.read().collect()}
    assert log.append(rows(1), "one") and not log.append(rows(7), "one")
    assert current() == {"a": 1, "b1": 1}
    # A run whose rows are written but not named by a manifest.
    rows(9).write.mode("overwrite").parquet(f"{tmp_path}/log/rows/slot={log.manifest()['next']}")
    assert current() == {"a": 1, "b1": 1}
    assert log.append(rows(2), "two") and log.append(rows(3), "three")
    assert log.manifest()["open"] == [] and current() == {"a": 3, "b1": 1, "b2": 2, "b3": 3}
    assert not log.append(rows(8), "two") and current()["a"] == 3


def test_a_crash_between_base_and_manifest(spark, tmp_path, monkeypatch):
    log = _log(spark, tmp_path, every=100)
    for seq in range(4):
        log.append(spark.createDataFrame([("a", seq), (f"b{seq}", seq)], "k string, seq long"), str(seq))
    before = sorted(map(tuple, log.read().collect()))

    def crash(state):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(log, "_switch", crash)
        with pytest.raises(RuntimeError):
            log.compact()
        with pytest.raises(RuntimeError):
            log.append(spark.createDataFrame([("a", 99)], "k string, seq long"), "99")
    assert sorted(map(tuple, log.read().collect())) == before and len(log.manifest()["open"]) == 4
    log.compact()
    assert sorted(map(tuple, log.read().collect())) == before and log.manifest()["open"] == []
    # A manifest that broke off while it was written is not whole.
    version = log.manifest()["version"]
    (tmp_path / "log" / "pointer" / f"slot={(version + 1) % 2}" / "part-x.json").write_text('{"version": 9')
    assert sorted(map(tuple, log.read().collect())) == before


def test_folders_stay_bounded_and_nothing_is_lost(spark, tmp_path):
    log = _log(spark, tmp_path, every=3)
    for seq in range(20):
        log.append(spark.createDataFrame([("a", seq), (f"b{seq}", seq)], "k string, seq long").coalesce(1), str(seq))
    assert len(list((tmp_path / "log").glob("*/*"))) <= 2 * 3 + 4
    assert {r["k"]: r["seq"] for r in log.read().collect()} == {"a": 19} | {f"b{s}": s for s in range(20)}


def test_statistics_of_a_rerun_batch_count_once(spark, sf, tmp_path):
    ev = inputs.events(spark, sf).withColumn("domain", F.lit("d"))
    log = statelog.StateLog(spark, f"{tmp_path}/stats", lambda rows: stats.fold_stats(rows, ["domain"]), 2)
    for part in (0, 1, 1, 2, 0):
        log.append(stats.field_stats(ev.where(F.col("id") % 3 == part), ["domain"]), f"batch {part}")
    assert log.read().drop("totals").collect() == stats.field_stats(ev, ["domain"]).drop("totals").collect()


def test_appended_runs_replace_themselves(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, seq long")
    for run in ("x", "y", "x"):
        tables.append_state(rows, f"{tmp_path}/runs", run=run)
    assert tables.read_state(spark, f"{tmp_path}/runs").count() == 4


def test_expired_snapshots_leave_the_store(spark, tmp_path):
    path = f"{tmp_path}/snaps"
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 21600)  # four a day from 2024-01-01
    rows = spark.range(40).select(F.concat(F.lit("s"), "id").alias("snapshot_id"), F.lit("c").alias("content"), at.alias("quarantined_at"))
    tables.write_snapshots(rows.union(spark.sql("SELECT 'null', 'c', cast(null as timestamp)")), path)
    files = lambda: {p.relative_to(path) for p in (tmp_path / "snaps").rglob("*.json")}
    before, now = files(), F.lit("2024-01-11 07:00:00").cast("timestamp")
    assert tables.expire_snapshots(spark, path, now) == 14
    left = {r["snapshot_id"] for r in tables.read_snapshots(spark, path).collect()}
    assert left == {f"s{i}" for i in range(14, 40)} | {"null"}
    kept = {p for p in before if p.parts[0] > "quarantined_date=2024-01-04" or "HIVE" in p.parts[0]}
    assert kept <= files() and not [p for p in files() if p.parts[0] < "quarantined_date=2024-01-04" and (tmp_path / "snaps" / p).stat().st_size]
    assert tables.expire_snapshots(spark, path, now) == 0 and kept <= files()
    assert tables.expire_snapshots(spark, path, F.lit("2025-01-01").cast("timestamp")) == 26
