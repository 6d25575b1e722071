"""Operators on small tables whose answers can be worked out by hand or by a plain loop."""

import ipaddress
import json
import math
import random
import re
from datetime import datetime, timedelta
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.functions import exact, urls
from driftloom.operators import (
    bucket, chunks, compliance, drift, extract, gate, items, latest, metrics, network, quarantine, ratelimit, repair, reports, stats, validate,
)
from driftloom.plans import catalogue, inputs, run
from driftloom.session import reliable_checkpoint

T0 = datetime(2024, 1, 1)


def test_listing_card(spark):
    pages = spark.createDataFrame(
        [(1, "https://example.com/products", "example.com",
          '<div class="card"><h2>Running Shoes</h2><span class="price">$89.99</span></div><div class="card"></div>')],
        "page_id long, url string, domain string, html string",
    )
    fields = [("title", "h2", "css", "string"), ("price", ".price", "css", "float")]
    domains = spark.createDataFrame(
        [("example.com", ".card", fields)],
        "domain string, item_container string, fields array<struct<name:string,selector:string,strategy:string,field_type:string>>",
    )
    got = items.extract_items(pages, domains)
    rows = got.collect()
    assert [{v["name"]: v["value"] for v in r["values"]} for r in rows] == [{"title": "Running Shoes", "price": "$89.99"}]
    success = items.field_success(items.melt_items(got)).collect()
    assert {r["name"]: r["success"] for r in success} == {"title": True, "price": True}


def test_card_heuristics_and_fallback_container(spark):
    html = (
        '<article><a href="/a?x=1" aria-label="Red shoe">pic</a> now ₹ 1,299.50 rated 4.5 out of 5 stars by 1,024 ratings</article>'
        '<article><a href="/a?x=2">again</a></article><article><p>plain title\nmore</p></article>'
    )
    pages = spark.createDataFrame([(1, "https://s.example/l/", "s.example", html)], "page_id long, url string, domain string, html string")
    fields = [(n, "text", "css", t) for n, t in (("product_title", "string"), ("price", "string"), ("rating", "string"), ("review_count", "string"), ("product_url", "url"))]
    domains = spark.createDataFrame(
        [("s.example", ".gone", fields)],
        "domain string, item_container string, fields array<struct<name:string,selector:string,strategy:string,field_type:string>>",
    )
    rows = items.extract_items(pages, domains).orderBy("pos").collect()
    assert [r["container"] for r in rows] == ["article", "article"]
    assert {v["name"]: v["value"] for v in rows[0]["values"]} == {
        "product_title": "Red shoe", "price": "₹ 1,299.50", "rating": "4.5 out of 5 stars", "review_count": "1,024",
        "product_url": "https://s.example/a?x=1",
    }
    # The second card has the same link without its query, so the third is the next item.
    assert rows[1]["dedup_key"] == "plain title" and rows[1]["pos"] == 2


def test_native_and_parsed_extraction_agree(spark, sf):
    pages, fields = inputs.pages(spark, "/root/testdata/sf0.01"), inputs.fields(spark, "/root/testdata/sf0.01")
    flat = fields.where("selector in ('h1', 'h2', 'title')")
    native, parsed = (extract.extract_fields(pages, flat, e) for e in ("auto", "parser"))
    assert native.count() > 0 and native.exceptAll(parsed).isEmpty() and parsed.exceptAll(native).isEmpty()


def test_running_matches_a_plain_window(spark, sf):
    from pyspark.sql import Window as W

    ev = inputs.events(spark, sf)
    out = chunks.running(ev, ["event_type"], "ts", ["ts", "id"], sums={"s": F.col("value")}, maxes={"m": F.col("value")}, chunk_seconds=600)
    w = W.partitionBy("event_type").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, 0)
    plain = ev.select("id", F.sum("value").over(w).alias("ps"), F.max("value").over(w).alias("pm"))
    assert out.join(plain, "id").where("abs(s - ps) > 1e-6 or m != pm").isEmpty()
    assert out.count() == ev.count()


def test_sliding_count_is_independent_of_the_chunk(spark, sf):
    ev = inputs.events(spark, sf)
    a = chunks.sliding_count(ev, ["event_type"], "ts", 172800, "n", chunk_seconds=3600)
    b = chunks.sliding_count(ev, ["event_type"], "ts", 172800, "n", chunk_seconds=172800)
    assert a.select("id", "n").exceptAll(b.select("id", "n")).isEmpty()
    with pytest.raises(ValueError):
        chunks.sliding_count(ev, ["event_type"], "ts", 100, "n", chunk_seconds=60)


def _gated_by_loop(rows, sigma):
    """(id -> prior_n, zscore, valid), one value after the other, with exact totals."""
    state, out = {}, {}
    for key, _, i, x in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        totals = state.setdefault(key, {})
        n = sum(t[0] for t in totals.values())
        s = ss = 0.0
        for at in sorted(totals):
            value, square = exact.read_parts(at, np.array([totals[at][1:]], dtype=np.int64))
            s, ss = s + value[0], ss + square[0]
        z = None
        if n >= 2:
            z = abs(x - s / n) / max(math.sqrt(max((ss - s * s / n) / (n - 1), 0.0)), stats.MIN_SPREAD)
        ok = z is None or z <= sigma
        out[i] = (n, z, ok)
        if ok:
            (at,), (parts,) = exact.split(np.array([x]))
            own = totals.setdefault(int(at), [0] * 9)
            totals[int(at)] = [a + b for a, b in zip(own, [1, *parts.tolist()])]
    return out


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_gated_zscore_is_the_sequential_loop_bit_by_bit(spark, sf, partitions):
    ev = inputs.events(spark, sf)
    wild = F.when(ev.id % 5 == 0, ev.value * 1e9).when(ev.id % 7 == 0, -ev.value / 1e7).otherwise(ev.value)
    for frame in (ev, ev.withColumn("value", wild), ev.withColumn("event_type", F.when(ev.id % 50 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), ev.id)))):
        rows = [(r["event_type"], r["ts"], r["id"], r["value"]) for r in frame.collect()]
        out = stats.gated_zscore(frame, ["event_type"], F.lit(2.0), partitions=partitions)
        assert {r["id"]: (r["prior_n"], r["zscore"], r["valid"]) for r in out.collect()} == _gated_by_loop(rows, 2.0)


def test_gated_zscore_odd_values(spark):
    rows = [("a", 1, 1.0), ("a", 2, float("nan")), ("a", 3, 1.5), ("a", 4, 1e300), ("a", 5, None), ("a", 6, 900.0), ("a", 7, 1.25), (None, 1, 5.0), (None, 2, 5.0), (None, 3, 6.0)]
    df = spark.createDataFrame([(k, T0 + timedelta(seconds=i), i, v) for k, i, v in rows], "k string, ts timestamp, id long, value double")
    got = {(r.k, r.id): (r.prior_n, r.valid) for r in stats.gated_zscore(df, ["k"], F.lit(3.0)).collect()}
    assert got == {
        ("a", 1): (0, True), ("a", 2): (1, True), ("a", 3): (1, True), ("a", 4): (2, True), ("a", 6): (2, False), ("a", 7): (2, True),
        (None, 1): (0, True), (None, 2): (1, True), (None, 3): (2, False),
    }
    assert stats.gated_zscore(df.limit(0), ["k"], F.lit(3.0)).count() == 0
    assert stats.gated_zscore(df, ["k"], F.lit(None)).where("not valid").count() == 0


def test_a_gate_that_turns_with_every_value():
    """Verdicts that hang on each other all the way."""
    x = np.array([0.0, 1.0] + [(-2.0) ** k for k in range(60)])
    n, z, valid, state = gate.judge(x, np.full(len(x), 1.5), np.zeros(len(x), dtype=bool), {})
    expected = _gated_by_loop([("k", i, i, v) for i, v in enumerate(x.tolist())], 1.5)
    assert [(a, None if np.isnan(b) else b, c) for a, b, c in zip(n.tolist(), z.tolist(), valid.tolist())] == list(expected.values())
    halves = gate.judge(x[:30], np.full(30, 1.5), np.zeros(30, dtype=bool), {})
    rest = gate.judge(x[30:], np.full(32, 1.5), np.zeros(32, dtype=bool), halves[3])
    assert rest[3] == state and np.array_equal(np.concatenate((halves[0], rest[0])), n)


def test_parts_hold_values_and_squares_exactly(spark):
    rng = random.Random(9)
    values = [rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.randint(-200, 200) for _ in range(300)]
    values += [0.0, -0.0, 1.0, -1.0, 2.0**14, 2.0**28 - 2.0**-24, 0.1, 1e100, 3.0**100, 2.0**-14, float(np.nextafter(2.0**14, 0)), float(np.nextafter(2.0**-28, 1))]

    def whole(at, p):
        x = sum(Fraction(p[k]) * Fraction(2) ** (28 * (1 - k) + 14 * at - 28) for k in range(3))
        return x, sum(Fraction(p[3 + k]) * Fraction(2) ** (28 * (2 - k) + 28 * at - 56) for k in range(5))

    for at, p, v in zip(*exact.split(np.array(values)), values):
        assert whole(int(at), p.tolist()) == (Fraction(v), Fraction(v) ** 2)
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in exact.with_parts(df, F.col("v")).collect():
        assert whole(r["at"], [r[c] for c in exact.PARTS]) == (Fraction(r["v"]), Fraction(r["v"]) ** 2)


def test_totals_do_not_depend_on_partitions_or_merges(spark):
    rng = random.Random(2)
    rows = [("d", f"f{i % 3}", "k", i, rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-8, 12)) for i in range(900)] + [("d", "f0", "k", 9999, float("inf"))]
    df = spark.createDataFrame([(d, f, k, i, T0 + timedelta(seconds=i), v) for d, f, k, i, v in rows], "domain string, field_name string, item_key string, id long, ts timestamp, value double")
    whole = [sorted(map(tuple, stats.field_stats(df.repartition(n)).drop("totals").collect())) for n in (1, 7)]
    merged = stats.merge_stats(stats.merge_stats(stats.field_stats(df.where("id % 2 = 0")), stats.field_stats(df.where("id % 4 = 1"))), stats.field_stats(df.where("id % 4 = 3")))
    assert whole[0] == whole[1] == sorted(map(tuple, merged.drop("totals").collect()))
    for r in whole[0]:
        own = [v for _, f, _, i, v in rows if f == r[1] and i != 9999]
        assert r[3] == 300 and r[4] == pytest.approx(math.fsum(own), rel=1e-14) and r[5] == pytest.approx(math.fsum(v * v for v in own), rel=1e-14)


def test_normal_and_anomalous_value(spark):
    stored = spark.createDataFrame([("d", "price", "k", 10, 100.0, 1004.0)], "domain string, field_name string, item_key string, value_count long, value_sum double, value_sum_sq double")
    rows = [("d", "price", "k", v, "float", "low", True, None) for v in ("10.5", "£99", "n/a")]
    ext = spark.createDataFrame(rows, "domain string, field_name string, item_key string, value string, field_type string, volatility string, required boolean, context map<string,string>")
    rules = inputs.rules(spark)
    got = {r["value"]: [c["check_type"] for c in r["checks"]] + [r["all_passed"]] for r in validate.check_values(ext, rules, stored).collect()}
    assert got == {"10.5": ["type", "statistical", True], "£99": ["type", "statistical", False], "n/a": ["type", False]}


def test_short_circuit_after_a_failed_rule(spark):
    stored = spark.createDataFrame([("d", "price", "k", 10, 100.0, 1004.0)], "domain string, field_name string, item_key string, value_count long, value_sum double, value_sum_sq double")
    ext = spark.createDataFrame([("d", "price", "k", "0", "float", "low", True, {"product_type": "physical"})], "domain string, field_name string, item_key string, value string, field_type string, volatility string, required boolean, context map<string,string>")
    row = validate.check_values(ext, inputs.rules(spark), stored).first()
    assert [(c["check_type"], c["passed"]) for c in row["checks"]] == [("type", True), ("business_rule", False)]


@pytest.mark.parametrize("failed,total,kind", [(2, 5, "local"), (3, 5, "global"), (0, 0, "local")])
def test_drift_threshold(spark, failed, total, kind):
    assert spark.range(1).select(drift.drift_type(F.lit(failed), F.lit(total))).first()[0] == kind


def _verdicts(spark, marks):
    rows = [("d", T0 + timedelta(hours=i), i, "global" if m == "G" else "local", m == "R") for i, m in enumerate(marks)]
    return spark.createDataFrame(rows, "domain string, ts timestamp, id long, drift_type string, is_reset boolean")


def test_debounce_is_cumulative_and_reset_closes(spark):
    out = drift.debounce_state(_verdicts(spark, "GLGGRGG")).orderBy("id").collect()
    assert [r["global_failures"] for r in out] == [1, 1, 2, 3, 0, 1, 2]
    assert [r["state"] for r in out] == ["closed"] * 3 + ["open"] + ["closed"] * 3
    streak = drift.debounce_state(_verdicts(spark, "GLGGRGG"), consecutive=True).orderBy("id").collect()
    assert [r["global_failures"] for r in streak] == [1, 0, 1, 2, 0, 1, 2]


def _repairs(spark, hours, resets=()):
    rows = [("d", "f", T0 + timedelta(hours=h), i, i in resets) for i, h in enumerate(hours)]
    return spark.createDataFrame(rows, "domain string, field_name string, ts timestamp, id long, is_reset boolean")


def test_thrash_lock_window_and_no_auto_reset(spark):
    out = drift.thrash_lock(_repairs(spark, [0, 24, 49, 50, 200])).orderBy("id").collect()
    assert [r["repairs"] for r in out] == [1, 2, 2, 3, 1]
    assert [r["locked"] for r in out] == [False, False, False, True, True]


def test_reset_unlocks_but_keeps_history(spark):
    out = drift.thrash_lock(_repairs(spark, [0, 1, 2, 3, 4], resets={3})).orderBy("id").collect()
    assert [r["locked"] for r in out] == [False, False, True, False, True]


def test_48h_window_is_inclusive(spark):
    out = drift.repair_count(_repairs(spark, [0, 48, 49])).orderBy("id").collect()
    assert [r["repairs"] for r in out] == [1, 2, 2]


def _samples(spark, n=8):
    rows = [("d", "f", i, T0 + timedelta(hours=i), f"v{i}") for i in range(n)]
    return spark.createDataFrame(rows, "domain string, field_name string, snapshot_id long, snapshot_at timestamp, sample_value string")


def test_lkg_window_latest_history_rollback(spark):
    s = _samples(spark)
    assert sorted(r["snapshot_id"] for r in latest.lkg_window(s).collect()) == [3, 4, 5, 6, 7]
    assert latest.lkg_latest(s).first()["snapshot_id"] == 7
    assert [r["snapshot_id"] for r in latest.lkg_history(s, "d", "f", 2).collect()] == [7, 6]
    assert latest.lkg_latest(latest.lkg_rollback(s, 2)).first()["snapshot_id"] == 5
    assert latest.lkg_rollback(s, 5).isEmpty()


def test_lkg_as_of(spark):
    moments = spark.createDataFrame([(1, "d", "f", T0 + timedelta(hours=4, minutes=30)), (2, "d", "g", T0)], "k long, domain string, field_name string, at timestamp")
    got = {r["k"]: r["lkg"] and r["lkg"]["snapshot_id"] for r in latest.lkg_as_of(moments, latest.lkg_window(_samples(spark)), "at", "k").collect()}
    assert got == {1: 4, 2: None}


def test_registry_hot_reload(spark):
    config = spark.createDataFrame([("d", "title", "h1", "css"), ("d", "price", ".p", "css")], "domain string, field_name string, selector string, strategy string")
    reloads = spark.createDataFrame([("d", "title", "h2", "css", T0, 1), ("d", "title", "h3", "role", T0, 2)], "domain string, field_name string, selector string, strategy string, updated_at timestamp, seq long")
    got = {r["field_name"]: r["selector"] for r in latest.registry_current(config, reloads).collect()}
    assert got == {"title": "h3", "price": ".p"}


@pytest.mark.parametrize(
    "locked,ok,holdout,score,expected",
    [(True, True, True, 0.9, "rejected_breaker"), (False, False, True, 0.9, "failed"), (False, True, False, 0.9, "rejected_overfit"),
     (False, True, True, 0.75, "auto_approved"), (False, True, True, 0.7499, "quarantined"), (False, None, None, None, "failed")],
)
def test_outcome_order(spark, locked, ok, holdout, score, expected):
    c = [F.lit(v).cast(t) for v, t in ((locked, "boolean"), (ok, "boolean"), (holdout, "boolean"), (score, "double"))]
    assert spark.range(1).select(repair.outcome(*c)).first()[0] == expected


def test_cross_validation(spark):
    c = spark.createDataFrame([(d, "title", "h1", "css") for d in ("all", "some", "none", "free", "down")], "domain string, field_name string, selector string, strategy string")
    good, bad = "<h1>x</h1>", "<h1> </h1>"
    h = spark.createDataFrame(
        [("all", "1", good), ("all", "2", good), ("some", "1", good), ("some", "2", bad), ("none", "1", bad), ("none", "2", None), ("down", "1", None)],
        "domain string, url string, html string",
    )
    f = spark.createDataFrame([(d, "title", "string", True) for d in ("all", "some", "none", "free", "down")], "domain string, name string, field_type string, required boolean")
    out = repair.cross_validate(c, h, f)
    got = {r["domain"]: (r["holdout_passed"], r["pass_count"], r["total"]) for r in out.collect()}
    assert got == {"all": (True, 2, 2), "some": (False, 1, 2), "none": (False, 0, 1), "free": (True, 1, 1), "down": (False, 0, 0)}
    assert [r["domain"] for r in repair.uniform_failure(out).collect()] == ["none"]


def _records(spark):
    rows = [(f"s{i}", "d", "title", f"u{i}", "h1", "h2", 0.5, T0 + timedelta(days=i), T0 + timedelta(days=i + 7), False, None, None) for i in range(4)]
    return spark.createDataFrame(
        rows,
        "snapshot_id string, domain string, field_name string, page_url string, broken_selector string, proposed_selector string, confidence_score double, "
        "quarantined_at timestamp, retention_expires_at timestamp, resolved boolean, resolved_by string, resolved_at timestamp",
    )


def test_expiry_and_pending(spark):
    now = F.lit(T0 + timedelta(days=9))
    assert sorted(r[0] for r in quarantine.expired(_records(spark), now).select("snapshot_id").collect()) == ["s0", "s1"]
    assert quarantine.unexpired(_records(spark), now).count() == 2
    assert quarantine.pending(_records(spark), "other").isEmpty()


def test_replay_twice_is_once(spark):
    found = spark.createDataFrame([("d", "title", "u1", True), ("d", "title", "u2", False)], "domain string, field_name string, page_url string, success boolean")
    now = F.lit(T0)
    first = quarantine.replay(_records(spark), found, now)
    assert [r["snapshot_id"] for r in first.collect()] == ["s1"]
    assert quarantine.replay(quarantine.resolve(_records(spark), first), found, now).isEmpty()


def test_compliance_stops_and_robots(spark):
    df = spark.createDataFrame([(403,), (404,), (429,), (451,), (503,), (200,)], "s int")
    strict = [r[0] for r in df.select(compliance.response_blocked(F.col("s"), F.lit("strict_compliance"))).collect()]
    assert strict == [True, False, True, True, False, False]
    rules = spark.createDataFrame(
        [("h", "*", False, "/private", None), ("h", "*", True, "/private/ok", None), ("h", "*", False, "/*.pdf$", 3.0)],
        "host string, user_agent string, allow boolean, path string, crawl_delay double",
    )
    u = spark.createDataFrame([(f"http://{h}{p}",) for h, p in (("h", "/private/x"), ("h", "/private/ok/1"), ("h", "/a.pdf"), ("h", "/a.pdf?x"), ("e", "/"), ("m", "/"), ("u", "/"))], "url string")
    fetches = spark.createDataFrame([("h", 200), ("e", 500), ("m", 404)], "host string, status int")
    got = {r["url"]: r["robots_allowed"] for r in compliance.robots_filter(u, compliance.robots_index(rules), fetches).collect()}
    assert got == {
        "http://h/private/x": False, "http://h/private/ok/1": True, "http://h/a.pdf": False, "http://h/a.pdf?x": True,
        "http://e/": False, "http://m/": True, "http://u/": False,
    }


def test_manifest_expired_unsigned_and_valid(spark):
    domains = spark.createDataFrame([("a.x.com",), ("x.com",), ("ax.com",), ("y.com",), ("z.com",)], "domain string")
    postures = domains.withColumn("posture", F.lit("adversarial_commercial"))
    manifests = spark.createDataFrame(
        [(["x.com"], T0 + timedelta(days=9), True), (["y.com"], T0 - timedelta(days=1), True), (["z.com"], T0 + timedelta(days=9), False)],
        "authorized_domains array<string>, expiration_date timestamp, signature_ok boolean",
    )
    out = compliance.effective_posture(domains, postures, manifests, F.lit(T0)).collect()
    assert {r["domain"] for r in out if r["posture"] == "adversarial_commercial"} == {"a.x.com", "x.com"}


def test_redirects(spark):
    hops = [(1, i, u) for i, u in enumerate(["http://a.com/", "http://u:p@a.com/", "http://10.0.0.1/", "http://93.1.1.1/", "http://a.com/4", "http://a.com/5", "http://a.com/6"])]
    out = network.audit_redirects(spark.createDataFrame(hops, "chain_id int, hop int, url string")).orderBy("hop").collect()
    assert [r["verdict"] for r in out] == ["unresolved", "unresolved", "blocked_ip", "ok", "unresolved", "unresolved", "too_many_hops"]
    assert out[1]["shown_url"] == "http://a.com/" and out[1]["cross_origin"] and not out[5]["cross_origin"]


def _bucket_by_loop(requests):
    """(allowed, tokens left) of (time in microseconds, capacity, rate, asked), in fractions."""
    tokens, last, out = None, None, []
    for now, capacity, rate, asked in requests:
        capacity, rate, asked = (Fraction(x).limit_denominator(10**9) for x in (capacity, rate, asked))
        tokens = capacity if tokens is None else min(capacity, tokens + (now - last) * rate / 10**6)
        ok = tokens >= asked
        tokens -= asked if ok else 0
        last = now
        out.append((ok, float(tokens)))
    return out


@pytest.mark.parametrize("partitions", [1, 4])
def test_token_bucket_within_limit_exhausted_and_bound(spark, partitions):
    seconds = [0, 0, 0, 0, 1, 1.5, 2, 30, 30.1, 30.2, 30.3, 30.4]
    rows = [("d", T0 + timedelta(seconds=s), i) for i, s in enumerate(seconds)]
    df = spark.createDataFrame(rows, "domain string, ts timestamp, id long")
    rates = spark.createDataFrame([("d", 3.0, 0.5)], "domain string, capacity double, rate double")
    out = ratelimit.admit(df, rates, partitions=partitions).orderBy("id").collect()
    assert [(r["allowed"], r["tokens_left"]) for r in out] == _bucket_by_loop([(round(s * 1e6), 3.0, 0.5, 1.0) for s in seconds])
    assert sum(r["allowed"] for r in out) <= 3 + 0.5 * 30.4
    assert all(r["wait_seconds"] > 0 for r in out if not r["allowed"])


@pytest.mark.parametrize("partitions", [1, 7, 30])
def test_a_domain_that_never_pauses_is_spread(spark, partitions):
    """Asked tokens, rates that change on the way, and neighbours in the order of domains."""
    rng = random.Random(5)
    rows, at = [], 0
    for i in range(1500):
        at += rng.choice([0, 40_000, 100_000, 333_333, 1_000_000])
        domain = "hot" if i % 60 else rng.choice(["a", "z", "hot0"])
        rows.append((domain, T0 + timedelta(microseconds=at), i, rng.choice([1.0, 1.0, 2.0, 0.5, 11.0])))
    df = spark.createDataFrame(rows, "domain string, ts timestamp, id long, tokens double")
    change = T0 + timedelta(microseconds=at // 2)
    rates = spark.createDataFrame(
        [("hot", 6.0, 1 / 3.0, None), ("hot", 4.0, 0.7, change), ("a", 2.5, 1 / 60.0, None), ("z", 1.0, 5.0, change)],
        "domain string, capacity double, rate double, valid_from timestamp",
    )
    in_force = lambda d, t: {"hot": (4.0, 0.7) if t >= change else (6.0, 1 / 3.0), "a": (2.5, 1 / 60.0), "z": (1.0, 5.0) if t >= change else (10.0, 1.0)}.get(d, (10.0, 1.0))
    want = {}
    for d in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == d]
        told = _bucket_by_loop([((t - T0) // timedelta(microseconds=1), *in_force(d, t), asked) for _, t, _, asked in own])
        want |= {r[2]: v for r, v in zip(own, told)}
    out = ratelimit.admit(df, rates, partitions=partitions)
    assert {r["id"]: (r["allowed"], r["tokens_left"]) for r in out.collect()} == want
    if partitions == 30:
        reports = ratelimit.reported(ratelimit.with_terms(df, rates, None, "ts").withColumn("_at", F.unix_micros("ts")).withColumn("_part", F.lit(0)).where("domain = 'hot'").coalesce(1).sortWithinPartitions("ts", "id"))
        assert len(json.loads(reports.first()["transfer"])[0]["starts"]) < 40


def test_a_transfer_is_the_bucket_for_every_level():
    rng = random.Random(3)
    for _ in range(40):
        run, at = [], 0
        for _ in range(rng.randint(1, 40)):
            at += rng.choice([0, 100_000, 250_000, 5_000_000])
            run.append((at, rng.choice([3.0, 5.0]), rng.choice([0.5, 1 / 3.0, 0.0]), rng.choice([1.0, 2.0, 0.25, 9.0])))
        whole = bucket.Transfer()
        for r in run:
            whole.step(*r)
        for _ in range(20):
            level = Fraction(rng.randint(0, 3000), 1000)
            own = bucket.Bucket.at(str(level), -rng.choice([0, 700_000]))
            start = own.last
            for r in run:
                own.take(*r)
            assert whole.after(level, start, *run[0][1:3]) == Fraction(own.level, own.unit)


def test_expired_manifest_is_refused_with_minus_one(spark):
    df = spark.createDataFrame([("d", T0, 1), ("d", T0 + timedelta(days=2), 2)], "domain string, ts timestamp, id long")
    m = spark.createDataFrame([("d", T0 + timedelta(days=1))], "domain string, expires_at timestamp")
    out = {r["id"]: (r["allowed"], r["wait_seconds"]) for r in ratelimit.admit(df, manifests=m).collect()}
    assert out == {1: (True, 0.0), 2: (False, -1.0)}


def test_calibration_picks_the_lowest_threshold(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, True), (0.6, False), (0.5, True), (0.2, False)], "confidence double, correct boolean")
    chosen = metrics.calibrate_threshold(df, 0.75).where("chosen").collect()
    assert [(r["threshold"], r["precision"]) for r in chosen] == [(0.5, 0.75)]


def test_cidr_join(spark):
    lo, hi = urls.cidr_bounds("172.16.0.0/12")
    hosts = spark.createDataFrame([("172.20.1.1",), ("172.32.0.1",), ("x",)], "ip string")
    ranges = spark.createDataFrame([(lo, hi, "private")], "lo long, hi long, label string")
    assert [r["ip"] for r in network.cidr_join(hosts, ranges).collect()] == ["172.20.1.1"]


def test_assembled_response_maps(spark):
    df = spark.createDataFrame([(1, "b", "x", False), (1, "a", None, True)], "page_id long, field_name string, value string, quarantined boolean")
    row = reports.assemble_response(df, ["page_id"]).first()
    assert row["fields"] == {"a": None, "b": "x"} and row["quarantined_fields"] == ["a"]


def test_hot_keys_are_not_read_by_one_task(spark, sf):
    """The only exchange of event rows is on key and chunk, never on the key alone."""
    plan = stats.rolling_zscore(inputs.events(spark, sf), ["event_type"], F.lit(2.0))._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    row_windows = [w for w in windows if "ts#" in w]
    assert row_windows and all("_chunk#" in w for w in row_windows)


def test_site_run_outputs_fit_together(spark, sf):
    from driftloom.plans import catalogue

    run = catalogue.site_outputs(spark, sf)
    approved = run.decisions.where("outcome = 'auto_approved'").count()
    assert run.registry_updates().count() == run.repair_log().count() == approved
    held = run.decisions.where("outcome = 'quarantined'").count()
    assert run.quarantine().count() == held
    assert run.snapshots().count() == run.extractions.where("success").count()
    assert run.responses().count() == run.pages.count()
    assert run.global_failures().where("pass_count > 0").isEmpty()


HOSTILE = [
    "<h1>Plain</h1>",
    "<h1>Unclosed",
    '<h1 title="x>y">Quoted</h1>',
    "<h1 title='a>b' class=c>Quoted</h1>",
    "<textarea><h1>no</h1></textarea><h1>real</h1>",
    "<iframe><h1>no</h1></iframe><h1>real</h1>",
    "<!-- <h1>no</h1> --><h1 class=\"k\">real &amp; true</h1>",
    "<script>'<h1>no</h1>'</script><h1>real</h1>",
    "<h2>other</h2></h1><h1>x",
    "<template><h1>no</h1></template><h1>real</h1>",
    '<p title="<h1>no</h1>">t</p><h1>real</h1>',
    "",
]


def _hostile(spark):
    pages = spark.createDataFrame([(i, f"https://d.com/{i}", "d.com", h) for i, h in enumerate(HOSTILE)], "page_id long, url string, domain string, html string")
    h1 = spark.createDataFrame([("d.com", 0, "title", "h1", "css", "string", "low", True)], "domain string, position int, name string, selector string, strategy string, field_type string, volatility string, required boolean")
    return pages, h1


def test_engines_agree_on_hostile_pages(spark):
    pages, h1 = _hostile(spark)
    rows = lambda engine: sorted((r["page_id"], r["value"], r["error"]) for r in extract.extract_fields(pages, h1, engine).collect())
    assert [tuple(map(str, r)) for r in rows("auto")] == [tuple(map(str, r)) for r in rows("parser")] and len(rows("auto")) == len(HOSTILE)


def test_what_stands_beside_a_field_does_not_change_it(spark):
    pages, h1 = _hostile(spark)
    beside = h1.union(h1.selectExpr("domain", "1", "'zz'", "'.zz p'", "strategy", "field_type", "volatility", "required"))
    alone, both = (extract.extract_fields(pages, f).where("field_name = 'title'").select("page_id", "value", "error") for f in (h1, beside))
    assert alone.exceptAll(both).isEmpty() and both.exceptAll(alone).isEmpty()


def test_oversize_pages_get_error_rows(spark, monkeypatch):
    monkeypatch.setattr(extract, "MAX_PAGE_BYTES", 30)
    pages, h1 = _hostile(spark)
    rows = {r["page_id"]: r for r in extract.extract_fields(pages, h1).collect()}
    assert len(rows) == len(HOSTILE)
    assert all((rows[i]["error"] == "response_too_large") == (len(h) > 30) and rows[i]["success"] <= (len(h) <= 30) for i, h in enumerate(HOSTILE))


def test_lkg_as_of_reads_the_whole_history(spark):
    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    samples = spark.createDataFrame([("d", "f", at(m), m) for m in range(0, 600, 10)], "domain string, field_name string, snapshot_at string, snapshot_id long").withColumn("snapshot_at", F.col("snapshot_at").cast("timestamp"))
    moments = spark.createDataFrame([(m, "d", "f", at(m)) for m in range(0, 700, 7)] + [(9000, "d", None, at(5)), (9001, "d", "f", None)], "k long, domain string, field_name string, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = {r["k"]: r["lkg"] and r["lkg"]["snapshot_id"] for r in latest.lkg_as_of(moments, samples, "at", "k").collect()}
    assert got == {m: min(m // 10 * 10, 590) for m in range(0, 700, 7)} | {9000: None, 9001: None}


def test_networks_of_any_length_by_brute_force(spark):
    rng = random.Random(1)
    nets = []
    for _ in range(50):
        v4 = rng.random() < 0.5
        start = rng.getrandbits(32) & 0x0F0000FF | 0x0A000000 if v4 else 0x20010DB8 << 96 | rng.getrandbits(20) << rng.choice([0, 60, 76])
        nets.append(str(ipaddress.ip_network((start, rng.randint(0, 32 if v4 else 128)), strict=False)))
    ips = []
    for _ in range(120):
        n = ipaddress.ip_network(rng.choice(nets))
        ips.append(str(n[rng.randrange(min(n.num_addresses, 2**60))]))
    nets += ["bad", "1.2.3.4/33", "::/129", "1.2.3.4", "::1.2.3.4/-1", None]
    ips += ["1.2.3.4", "1.2.3.4", "x", "::ffff:1.2.3.4", None]
    want = []
    for i in ips:
        for n in nets:
            try:
                a, net = ipaddress.ip_address(i), ipaddress.ip_network(n)
            except ValueError:
                continue
            a = getattr(a, "ipv4_mapped", None) or a
            if a in net or (net.version == 6 and a.version == 4 and ipaddress.ip_address(f"::ffff:{a}") in net):
                want.append((i, n))
    hosts = spark.createDataFrame([(i, "x") for i in ips], "ip string, cidr_ string")
    got = network.cidr_prefix_join(hosts, spark.createDataFrame([(n,) for n in nets], "cidr string"))
    assert sorted((r.ip, r.cidr) for r in got.collect()) == sorted(want)
    assert network.cidr_prefix_join(hosts, spark.createDataFrame([], "cidr string")).count() == 0


def _robots_by_pattern(rules, agent, host, path):
    """The longest rule whose pattern matches; rules are (host, agent, allow, path, delay)."""
    own = [r for r in rules if r[0] == host and r[1].lower() == agent] or [r for r in rules if r[0] == host and r[1] == "*"]
    found = []
    for _, _, allow, rule, _ in own:
        body = rule[:-1] if rule.endswith("$") else rule
        pattern = ".*".join(re.escape(p) for p in body.split("*")) + ("$" if rule.endswith("$") else "")
        if rule and re.match("(?s)" + pattern.replace("$", r"\Z") if rule.endswith("$") else "(?s)" + pattern, path):
            found.append((len(rule), allow))
    return max(found)[1] if found else True


@pytest.mark.parametrize("agent", ["*", "bot"])
def test_robots_by_brute_force(spark, agent):
    rng = random.Random(7)
    piece = lambda: "".join(rng.choice("ab/.") for _ in range(rng.randint(0, 3)))
    rules = []
    for h in range(4):
        for _ in range(25):
            path = rng.choice(["", "/", "/", "*", "/a"]) + piece() + rng.choice(["", "*", "**", "*" + piece(), "$", "*$", piece() + "*" + piece() + "$", "?q=*a"])
            rules.append((f"h{h}.com", rng.choice(["*", "Bot"] if h else ["*"]), rng.random() < 0.5, path, float(h)))
    rules += [("empty.com", "*", False, "", 3.0), ("big.com", "*", False, "/", None), ("big.com", "*", True, "/", None)]
    paths = ["/" + "".join(rng.choice("ab/.?q=") for _ in range(rng.randint(0, 9))) for _ in range(80)]
    rows = [(i, f"https://{h}{p}", "kept") for i, (h, p) in enumerate((h, p) for h in ("h0.com", "h1.com", "h2.com", "h3.com", "empty.com", "big.com", "none.com") for p in paths)]
    df = spark.createDataFrame(rows, "id long, url string, rules string")
    fetches = spark.createDataFrame([(h, 200) for h in ("h0.com", "h1.com", "h2.com", "h3.com", "empty.com", "big.com", "none.com")], "host string, status int")
    table = spark.createDataFrame(rules, "host string, user_agent string, allow boolean, path string, crawl_delay double")
    out = compliance.robots_filter(df, compliance.robots_index(table, agent), fetches)
    assert out.columns == ["id", "url", "rules", "robots_allowed", "crawl_delay"]
    got = {r["id"]: r["robots_allowed"] for r in out.collect()}
    want = {i: _robots_by_pattern(rules, agent, u.split("/")[2], "/" + u.split("/", 3)[3]) for i, u, _ in rows}
    assert got == want and {r["crawl_delay"] for r in out.where("url like '%empty%'").collect()} == {3.0}


def test_a_host_with_very_many_rules(spark):
    many = spark.range(100_000).select(
        F.lit("big.com").alias("host"), F.lit("*").alias("user_agent"), (F.col("id") % 2 == 0).alias("allow"),
        F.concat(F.lit("/shop/"), F.col("id"), F.lit("/")).alias("path"), F.lit(1.0).alias("crawl_delay"),
    )
    extra = spark.createDataFrame([("big.com", "*", False, "/shop/", 1.0), ("big.com", "*", True, "/*.png$", 1.0)], many.schema)
    urls_ = spark.range(20_000).select("id", F.concat(F.lit("http://big.com/shop/"), F.col("id") * 7, F.lit("/x"), F.when(F.col("id") % 10 == 0, F.lit(".png")).otherwise(F.lit(""))).alias("url"))
    fetches = spark.createDataFrame([("big.com", 200)], "host string, status int")
    out = compliance.robots_filter(urls_, compliance.robots_index(many.union(extra)), fetches)
    # The numbered rule is the longest; without one the image rule, then the folder.
    n = F.col("id") * 7
    want = F.when(n < 100_000, n % 2 == 0).otherwise(F.col("id") % 10 == 0)
    assert out.where(F.col("robots_allowed") != want).isEmpty() and out.count() == 20_000


def test_locators_in_force_by_brute_force(spark):
    rng = random.Random(4)
    fields = [("d", 0, "title", "c0"), ("d", 1, "price", "c1"), ("e", 0, "title", "c2")]
    reloads = [(rng.choice("de"), rng.choice(["title", "price", "gone"]), f"s{k}", "css", T0 + timedelta(hours=rng.randint(-3, 60)), k) for k in range(25)]
    reloads += [("d", "title", "old", "css", datetime(1960, 1, 1), 99), ("none", "title", "x", "css", T0, 100)]
    shape = "domain string, position int, name string, selector string"
    table = spark.createDataFrame(fields, shape).selectExpr("*", "'css' strategy", "'string' field_type", "'low' volatility", "true required")
    log = spark.createDataFrame(reloads, "domain string, field_name string, selector string, strategy string, updated_at timestamp, seq long")
    versions = latest.locator_versions(table, log).collect()
    for hour in range(-4, 62):
        at = T0 + timedelta(hours=hour, minutes=30)
        for d, _, name, configured in fields:
            past = [(t, k, sel) for dd, f, sel, _, t, k in reloads if (dd, f) == (d, name) and t <= at]
            own = [v for v in versions if (v["domain"], v["name"]) == (d, name) and v["valid_from"] <= at and (v["valid_to"] is None or at < v["valid_to"])]
            assert [v["selector"] for v in own] == [max(past)[2] if past else configured]


def test_pages_are_read_with_the_locators_of_their_moment(spark):
    html = "<h1>one</h1><h2>two</h2><h3>three</h3>"
    pages = spark.createDataFrame([(i, "http://d/", "d", html, T0 + timedelta(hours=i)) for i in range(48)] + [(99, "http://d/", "d", html, None)], "page_id long, url string, domain string, html string, requested_at timestamp")
    fields = spark.createDataFrame([("d", 0, "title", "h1", "css", "string", "low", True)], "domain string, position int, name string, selector string, strategy string, field_type string, volatility string, required boolean")
    log = spark.createDataFrame([("d", "title", "h2", "css", T0 + timedelta(hours=10), 1), ("d", "title", "h3", "css", T0 + timedelta(hours=30), 2)], "domain string, field_name string, selector string, strategy string, updated_at timestamp, seq long")
    for chunk in (3600, 86400, 10**7):
        out = extract.extract_at(pages, latest.locator_versions(fields, log), chunk_seconds=chunk).collect()
        assert {r["page_id"]: r["value"] for r in out} == {i: "one" if i < 10 else "two" if i < 30 else "three" for i in range(48)}


def test_an_approved_repair_reaches_the_next_run(spark):
    html = "<html><head><title>t</title></head><body><main><h2 class='name'>Lamp</h2><p>about</p></main></body></html>"
    pages = spark.createDataFrame([(i, f"http://shop.example/{i}", "shop.example", html, T0 + timedelta(hours=i)) for i in range(4)], "page_id long, url string, domain string, html string, requested_at timestamp")
    fields = spark.createDataFrame(
        [("shop.example", p, n, s, "css", "string", "low", True) for p, (n, s) in enumerate((("name", "h1.name"), ("page", "title"), ("about", "p")))],
        "domain string, position int, name string, selector string, strategy string, field_type string, volatility string, required boolean",
    )
    empty = lambda schema: spark.createDataFrame([], schema)
    rest = dict(
        postures=empty("domain string, posture string"), manifests=empty("authorized_domains array<string>, expiration_date timestamp, signature_ok boolean"),
        robots=compliance.robots_index(empty("host string, user_agent string, allow boolean, path string, crawl_delay double")),
        fetches=spark.createDataFrame([("shop.example", 404)], "host string, status int"), responses=pages.selectExpr("page_id", "200 status"),
        rates=empty("domain string, capacity double, rate double"), open_breakers=empty("domain string"),
        candidates=pages.selectExpr("page_id", "domain", "'name' field_name", "'h2.name' selector", "'css' strategy", "cast(null as string) role_name", "cast(null as string) role_type"),
        holdouts=pages.select("domain", "url", "html"),
        lkg=spark.createDataFrame([("shop.example", "name", "h1.name", "css", '- heading "Lamp" [level=2]', "Lamp", "Lamp", "u", T0, 1)], "domain string, field_name string, selector string, strategy string, outline string, text_signature string, sample_value string, page_url string, snapshot_at timestamp, snapshot_id long"),
        locks=empty("domain string, field_name string"), threshold=0.0,
    )
    first = run.run_site(pages, fields, F.lit(T0 + timedelta(days=1)), **rest)
    updates = reliable_checkpoint(first.registry_updates())
    assert {r["selector"] for r in updates.collect()} == {"h2.name"}
    later = pages.withColumn("requested_at", F.col("requested_at") + F.expr("INTERVAL 2 DAYS"))
    again = run.run_site(pages.union(later.withColumn("page_id", F.col("page_id") + 100)), fields, F.lit(T0 + timedelta(days=3)), reloads=updates, **{**rest, "responses": empty("page_id long, status int")})
    got = {(r["page_id"] >= 100, r["success"], r["selector_used"]) for r in again.extractions.where("field_name = 'name'").collect()}
    assert got == {(False, False, "h1.name"), (True, True, "h2.name")}


def test_every_listing_page_has_an_outcome(spark, monkeypatch):
    monkeypatch.setattr(extract, "MAX_PAGE_BYTES", 300)
    card = '<div class="card"><h2>Lamp</h2></div>'
    html = {1: card, 2: "<p>none</p>", 3: None, 4: "", 5: card + " " * 300, 6: '<div class="card"> </div>', 7: card + card + '<div class="card"><h2>Sofa</h2></div>'}
    pages = spark.createDataFrame([(i, f"https://e.com/{i}", "e.com", h) for i, h in html.items()] + [(9, "u", "other", card)], "page_id long, url string, domain string, html string")
    domains = spark.createDataFrame([("e.com", ".card", [("title", "h2", "css", "string")])], "domain string, item_container string, fields array<struct<name:string,selector:string,strategy:string,field_type:string>>")
    got = {r["page_id"]: (r["n_cards"], r["n_items"], r["error"]) for r in items.listing_outcomes(pages, domains).collect()}
    assert got == {1: (1, 1, None), 2: (0, 0, "no_container"), 3: (0, 0, "no_content"), 4: (0, 0, "no_content"), 5: (0, 0, "response_too_large"), 6: (1, 0, "no_items"), 7: (3, 2, None)}


def test_a_constant_field_name_still_meets_its_rules_by_key(spark):
    rows = spark.range(5).selectExpr("id", "'title' field_name", "'x' value", "'string' field_type", "true required", "'low' volatility", "cast(null as map<string,string>) context")
    checked = validate.check_values(rows, inputs.rules(spark))
    assert "NestedLoop" not in checked._jdf.queryExecution().toString()
    assert {len(r["checks"]) for r in checked.collect()} == {3}


def test_scores_read_the_samples_from_the_extractions_given(spark, tmp_path):
    made = [(i, f"https://{d}/{i}", f"<title>{d} {i}</title><h2>part {i}</h2>" if i % 5 else None) for i, d in enumerate(["a.example", "b.example"] * 6)]
    pages = spark.createDataFrame([(1, "https://a.example/1", "<title>again</title>"), *made], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    folder = str(tmp_path)
    found = reliable_checkpoint(inputs.extractions(spark, folder))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(inputs.snapshots_of(found)) == rows(inputs.snapshots(spark, folder))
    scored = catalogue._scored(spark, folder, found)
    # Pages are read for the proposals alone, and outlines are not shuffled to meet a domain's sample.
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and "strategy=broadcast" in plan
    assert {r["field_name"] for r in scored.collect()} >= {"title", "price"}
