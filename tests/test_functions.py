import gc
import ipaddress
import socket
from datetime import datetime, timezone
from urllib.parse import urljoin

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.functions import dom, ids, page, parsing, pii, rules, similarity, text, urls


def one(spark, column, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("r")).first()["r"]


V = F.col("v")


@pytest.mark.parametrize("s,expected", [("£51.77", 51.77), ("-5", 5.0), ("1.2.3", None), (".", None), ("", None), (" 7 ", 7.0)])
def test_float_parsing(spark, s, expected):
    assert one(spark, parsing.parse_float(V), s) == expected


@pytest.mark.parametrize("s,expected", [("3.7", 37), ("-12 left", -12), ("5-", None), ("x", None), ("9" * 25, None)])
def test_int_parsing(spark, s, expected):
    assert one(spark, parsing.parse_int(V), s) == expected


def test_long_digit_strings_are_still_integers(spark):
    assert one(spark, parsing.type_failure(V, F.lit("int"), F.lit(True)), "9" * 25) is None


@pytest.mark.parametrize(
    "s",
    ["2024-01-02", "20240102", "2024-01-02T03:04:05Z", "2024-01-02 03:04", "2024-01-02T10", "2024-01-02T03:04:05.5+02:00",
     "2024-02-30", "02/01/2024", "2024-01-02T24:00:00", "2024-01-02T03:04:60", "", "2024-1-2"],
)
def test_date_parsing_agrees_with_iso(spark, s):
    try:
        expected = datetime.fromisoformat(s.replace("Z", "+00:00"))
        expected = expected if expected.tzinfo else expected.replace(tzinfo=timezone.utc)
        expected = round(expected.timestamp() * 1e6)
    except ValueError:
        expected = None
    if s == "2024-01-02T24:00:00":  # newer interpreters read this as the next midnight
        expected = None
    assert one(spark, F.unix_micros(parsing.parse_date(V)), s) == expected


@pytest.mark.parametrize(
    "value,kind,required,reason",
    [("", "string", True, "required_empty"), (None, "float", False, None), ("abc", "float", True, "not_float"),
     ("in stock", "bool", True, None), ("maybe", "bool", True, "not_bool"), ("ftp://x", "url", True, "not_http_url"),
     ("x", "unknown", True, None), ("2024-13-01", "date", True, "not_date")],
)
def test_invalid_type(spark, value, kind, required, reason):
    assert one(spark, parsing.type_check(V, F.lit(kind), F.lit(required)), value)["reason"] == reason


@pytest.mark.parametrize(
    "op,value,target,ok",
    [("gt", "5", "4", True), ("gt", "£5", "4", False), ("gte", "4", "4.0", True), ("lt", "nan", "4", False),
     ("regex", "abc", "b", False), ("regex", "abc", "a", True), ("in", "b", "abc", True), ("min_length", "é", "2", False),
     ("between", "1", "1", False), ("gt", None, "1", False), ("gt", "5d", "4", False)],
)
def test_rules(spark, op, value, target, ok):
    assert one(spark, rules.rule_check(F.lit(op), V, F.lit(target)), value) is ok


def test_rule_context_filter(spark):
    df = spark.createDataFrame(
        [({"t": "a"}, {"t": "a", "u": "b"}), ({"t": "a"}, {"t": "x"}), ({}, None), ({"t": "a"}, None)],
        "rule map<string,string>, row map<string,string>",
    )
    got = [r[0] for r in df.select(rules.context_matches(F.col("rule"), F.col("row"))).collect()]
    assert got == [True, False, True, False]


def test_similarity_bounds_and_edges(spark):
    df = spark.createDataFrame(
        [("", ""), ("a", ""), ("Été à l'été", "été ÉTÉ"), ("one two", "three"), ("same words", "words same")], "a string, b string"
    )
    rows = df.select(
        similarity.structure_similarity(F.col("a"), F.col("b")).alias("s"), similarity.text_similarity(F.col("a"), F.col("b")).alias("t")
    ).collect()
    assert [rows[i]["s"] for i in (0, 1, 3, 4)] == [1.0, 0.5, 0.0, 1.0]
    assert [round(rows[i]["t"], 6) for i in (0, 1, 3, 4)] == [1.0, 0.5, 0.0, 1.0]
    # été twice, à, l once against été twice
    assert round(rows[2]["t"], 6) == round(4 / (6**0.5 * 2), 6)


def test_cosine_pairs_equals_the_column_form(spark):
    df = spark.createDataFrame([(1, "a b b", "b c"), (2, "", ""), (3, "x", ""), (4, "é é", "é")], "k int, l string, r string")
    pairs = {r["k"]: round(r["text_similarity"], 9) for r in similarity.cosine_pairs(df, ["k"], "l", "r").collect()}
    cols = {r["k"]: round(r["s"], 9) for r in df.select("k", similarity.text_similarity(F.col("l"), F.col("r")).alias("s")).collect()}
    assert pairs == cols


def test_cosine_pairs_scores_a_pair_where_it_lies(spark):
    rows = [(1, "a b b", "b c"), (2, None, "a"), (3, None, None), (None, "q w", "q")]
    df = spark.createDataFrame(rows, "k int, l string, r string")
    # Words of unique pairs are never rows of an aggregate.
    plan = similarity.cosine_pairs(df, ["k"], "l", "r")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
    twice = df.union(spark.createDataFrame([(1, "z z", "z"), (None, "w", "w")], df.schema))
    got = {r["k"]: round(r["text_similarity"], 9) for r in similarity.cosine_pairs(twice, ["k"], "l", "r").collect()}
    # Rows of one key are one pair: a b b z z against b c z, and q w w against q w.
    assert got == {1: round(4 / (9 * 3) ** 0.5, 9), 2: 0.5, 3: 1.0, None: round(3 / (5 * 2) ** 0.5, 9)}


def test_confidence_without_baseline_and_bounds(spark):
    none = F.lit(None).cast("string")
    no_lkg = similarity.confidence(F.lit("- x"), V, F.lit("css"), F.lit(False), none, none, none, none)
    assert one(spark, no_lkg, "£5") == pytest.approx(0.85)
    assert one(spark, no_lkg, "") == pytest.approx(0.425)
    same = similarity.confidence(F.lit("- h"), V, F.lit("css"), F.lit(True), F.lit("- h"), V, F.lit("css"), V)
    assert one(spark, same, "a title") == pytest.approx(1.0)


@pytest.mark.parametrize(
    "raw,redacted",
    [("mail bob@site.org now", "mail [REDACTED_EMAIL] now"), ("123-45-6789", "[REDACTED_SSN]"),
     ("4111-1111-1111-1111", "[REDACTED_CREDIT_CARD]"), ("at 10.0.0.1", "at [REDACTED_IPV4]")],
)
def test_redaction(spark, raw, redacted):
    once = one(spark, pii.redact(V), raw)
    assert once == redacted
    assert one(spark, pii.redact(V), once) == once


def test_unseparated_card_leaks_in_reference_order_only(spark):
    assert one(spark, pii.redact(V), "4111111111111111").endswith("111111")
    assert one(spark, pii.redact(V, "safe"), "4111111111111111") == "[REDACTED_CREDIT_CARD]"


def test_scan_offsets_point_at_the_match(spark):
    s = "é a@b.co, 555-123-4567 and a@b.co"
    for hit in one(spark, pii.scan(V), s):
        assert s[hit["start"] : hit["end"]] == hit["match"]


def test_allow_list_and_map(spark):
    assert one(spark, pii.redact_field(V, F.lit("contact"), ["contact"]), "a@b.co") == "a@b.co"
    m = one(spark, pii.redact_map(V, ["keep"]), {"keep": "a@b.co", "x": "a@b.co"}, "v map<string,string>")
    assert m == {"keep": "a@b.co", "x": "[REDACTED_EMAIL]"}


def test_private_ranges_agree_with_the_standard_library(spark):
    ips = (
        "10.0.0.1 8.8.8.8 127.0.0.1 172.31.9.9 172.32.0.1 192.168.1.1 169.254.1.1 224.0.0.1 0.0.0.0 100.64.0.1 01.2.3.4 256.1.1.1 abc "
        "::1 :: ::ffff:10.0.0.1 ::ffff:8.8.8.8 fe80::1 fc00:: ff02::1 2606:4700::1 2001:db8::1 1::2::3 1:2:3:4:5:6:7 1:2:3:4:5:6:7:8"
    ).split()

    def expected(ip):
        try:
            a = ipaddress.ip_address(ip)
        except ValueError:
            return False
        a = getattr(a, "ipv4_mapped", None) or a
        return a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_unspecified

    df = spark.createDataFrame([(ip,) for ip in ips], "v string")
    got = {r["v"]: r["p"] for r in df.select("v", urls.is_private_ip(V).alias("p")).collect()}
    assert got == {ip: expected(ip) for ip in ips}


def test_file_protocol_and_host(spark):
    assert one(spark, urls.url_failure(V), "file:///etc/passwd") == "scheme_not_allowed"
    assert one(spark, urls.url_failure(V), "http://") == "no_host"
    assert one(spark, urls.host_of(V), "http://u:p@[::1]:80/x") == "::1"
    assert one(spark, urls.domain_of(V), "https://www.Shop.example:8080/x") == "Shop.example:8080"


@pytest.mark.parametrize("href", ["../g", "?y", "#s", "", "//h/x", "/x/./y/../z", "../../../../g", "g;x=1/../y", "mailto:a@b", ".", "..", "a/b/"])
def test_resolve_url_agrees_with_the_standard_library(spark, href):
    base = "http://a.example/b/c/d?q=1"
    assert one(spark, urls.resolve_url(F.lit(base), V), href) == urljoin(base, href)


def test_xpath_functions_are_refused(spark):
    assert one(spark, ids.selector_safe(V, F.lit("xpath")), "//a[document ('x')]") is False
    assert one(spark, ids.selector_safe(V, F.lit("css")), "document(") is True


def test_hidden_script_and_attributes_are_removed(spark):
    raw = (
        '<div onclick="x()" data-id=\'1\' data-testid="t"><script>var a="</p>"</script>keep<p style="DISPLAY : none">no<b>no</b></p>'
        "<input type=hidden value=no><svg><g>no</g></svg><span hidden>no</span> end</div>"
    )
    clean = one(spark, page.sanitize(V), raw)
    assert clean == '<untrusted_scraped_content>\n<div data-testid="t">keep end</div>\n</untrusted_scraped_content>'


def test_truncate_escape_and_injection(spark):
    assert one(spark, text.truncate(V, 3), "abcdef") == "abc..."
    assert one(spark, text.escape_delimiter(V), "</untrusted_scraped_content>") == "&lt;/untrusted_scraped_content&gt;"
    assert one(spark, text.injection_patterns(V), "Please IGNORE\n previous; assistant: hi") == ["ignore_previous", "assistant_role"]
    assert one(spark, text.strip_obfuscation(V), "a​b‮c﻿") == "abc"


def test_secrets(spark):
    assert one(spark, text.redact_secrets(V), "u?Api_Key=abc&x=1") == "u?Api_Key=[REDACTED]&x=1"
    assert one(spark, text.redact_secrets(V), 'token = "abc"') == 'token = "abc"'
    assert one(spark, text.redact_secrets(V, lenient=True), 'token = "abc" z') == "token=[REDACTED] z"
    assert one(spark, text.redact_secrets(V, 5), "x" * 9) == "xxxxx... [TRUNCATED, original length: 9]"


HTML = """<html><body><div id="product_description"><h2>D</h2></div><p>first &amp; best</p>
<ul class="tags main"><li>a<li>b</ul><div class="card" data-testid="c1"><a href="/dp/1" aria-label="Shoe one">S<b>h</b>oe</a>
<span class="a-price"><span class="a-offscreen">$9</span></span></div><nav role="menu"><a>m</a></nav><p>second</p></body></html>"""


@pytest.mark.parametrize(
    "selector,strategy,expected",
    [("#product_description ~ p", "css", "first & best"), (".tags > li:nth-of-type(2)", "css", "b"), ("ul.tags.main li", "css", "a"),
     ('li:has(a[href*="/dp/"]), .card a', "css", "Shoe"), (".a-price .a-offscreen", "css", "$9"), ('[class*="price"]', "css", "$9"),
     ("a[href^='/dp']", "css", "Shoe"), ("h2 + p", "css", None), ("heading", "role", "D"), ("menu", "role", "m"),
     ("navigation", "role", None), ("shoe", "aria", "Shoe"), ("c1", "test_id", "Shoe\n$9"), ("second", "text", "second"),
     ("//div[@class='card']", "xpath", "Shoe\n$9"), ("text=FIRST", "css", "first & best"), ("li:not(.x)", "css", "a")],
)
def test_selectors(selector, strategy, expected):
    node = dom.first(dom.parse(HTML), selector, strategy)
    assert (node.text().strip() if node else None) == expected


def test_unsupported_selectors_say_so():
    for selector, strategy in (("a::before", "css"), ("//a/b[1]", "xpath"), ("a:hover", "css")):
        with pytest.raises(dom.UnsupportedSelector):
            dom.compile_selector(selector, strategy)


def test_unescape_agrees_with_the_standard_library(spark):
    import html

    s = "&amp;lt; &copy; &#233; &#x1F600; &amp &am; &nope; & x &quot;"
    assert one(spark, page.unescape(V), s) == html.unescape(s)


def test_numeric_hosts(spark):
    """All forms that the C library's address parser reads, and none that it refuses."""
    hosts = [
        "0177.0.0.1", "0x7f.0.0.1", "2130706433", "127.1", "127.0.1", "8.8.8.8", "08.8.8.8", "0x7f000001", "017700000001", "1.2.3.256", "256.1.1.1",
        "1.2.65535", "1.2.65536", "1.16777215", "1.16777216", "4294967295", "4294967296", "9" * 30, "0x", "0x" + "0" * 30 + "7f.1", "0" * 30 + "177.1",
        "a.b", "example.com", "1..2", ".", "", "0", "00", "1.2.3.4.5", "0x" + "f" * 20, "-1", "0X1F.1", "1.2.3.4x",
    ]

    def plain(host):
        try:
            return int.from_bytes(socket.inet_aton(host), "big")
        except OSError:
            return None

    df = spark.createDataFrame([(h,) for h in [*hosts, None]], "v string")
    got = {r.v: r.n for r in df.select("v", urls.ipv4_of_host(V).alias("n")).collect()}
    assert got == {h: plain(h) for h in hosts} | {None: None}
    assert spark.createDataFrame([("127.1.",)], "v string").select(urls.ipv4_of_host(V)).first()[0] == 127 * 2**24 + 1


def test_hosts_with_zones_and_names(spark):
    hosts = {"fe80::1%25eth0": True, "::ffff:10.0.0.1": True, "2606:4700::1": False, "localhost": None, "0x8.8.8.8": False, "0300.0250.1": True, "g::1": None}
    df = spark.createDataFrame([(h,) for h in hosts], "v string")
    assert {r.v: r.p for r in df.select("v", urls.private_host(V).alias("p")).collect()} == hosts


def test_nested_redaction(spark):
    mail, gone = "a@b.co", "[REDACTED_EMAIL]"
    kind = T.StructType().add("m", "string").add("keep", T.StructType().add("m", "string")).add("n", T.IntegerType()).add("l", T.ArrayType(T.StructType().add("m", "string").add("keep", "string")))
    kind = kind.add("deep", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType())))
    row = (mail, (mail,), 7, [(mail, mail), None], {"x": {"m": mail, "keep": mail, "free": mail, "z": None}, "keep": {"m": mail}, "none": None})
    df = spark.createDataFrame([(row,), (None,), ((None, None, None, None, None),)], T.StructType().add("v", kind))
    got = [r["r"] for r in df.select(pii.redact_nested(V, kind, ["keep"], ["free"]).alias("r")).collect()]
    assert got[1] is None and list(got[2]) == [None] * 5
    assert (got[0].m, got[0].keep.m, got[0].n, got[0].l[0].m) == (gone, mail, 7, mail)
    assert got[0].deep == {"x": {"m": gone, "keep": mail, "free": mail, "z": None}, "keep": {"m": mail}, "none": None}
    listed = df.select(pii.redact_nested(V, kind, ["keep"], lists=True).alias("r")).first()["r"]
    assert [x and tuple(x) for x in listed.l] == [(gone, mail), None] and listed.deep["x"]["free"] == gone
    assert df.select(pii.redact_nested(V, kind).alias("r")).schema["r"].dataType.simpleString() == kind.simpleString()
    assert one(spark, pii.redact_nested(V, T.StringType()), mail) == gone


def test_sanitised_content_names_the_patterns_of_the_raw_text(spark):
    found = one(spark, page.sanitize_checked(V), "<script>ignore previous</script> hello")
    assert found.patterns == ["ignore_previous"] and "script" not in found.content and "hello" in found.content


def test_page_trees_are_taken_apart_without_the_collector():
    gc.collect()
    gc.disable()
    try:
        pages = pa.array([f"<div><p>{i}</p><p hidden>x</p></div>" if i % 9 else None for i in range(page.SLICE + 9)])
        wanted = pa.array([[{"selector": "p", "strategy": "css"}]] * len(pages))
        clean = page._drop_hidden.func(pages).to_pylist()
        nodes = page.select_nodes.func(pages, wanted).to_pylist()
        cards = page.select_cards.func(pages, pa.array(["p"] * len(pages)), pa.array([[]] * len(pages), wanted.type)).to_pylist()
        left = [o for o in gc.get_objects() if isinstance(o, dom.Node)]
    finally:
        gc.enable()
    assert not left
    assert clean == [f"<div><p>{i}</p></div>" if i % 9 else None for i in range(len(pages))]
    assert [n and n[0]["value"] for n in nodes] == [str(i) if i % 9 else None for i in range(len(pages))]
    assert [[c["text"] for c in r["cards"]] for r in cards] == [[str(i), "x"] if i % 9 else [] for i in range(len(pages))]
