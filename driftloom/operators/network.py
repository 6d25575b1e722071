"""URL and redirect screening against private networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.functions import urls
from driftloom.functions.let import let
from driftloom.operators.once import with_once
from driftloom.operators.sized import join_small

MAX_HOPS = 5


def ip_key(ip: Column) -> Column:
    """An address as 32 hex digits, IPv4 as mapped IPv6; null when it is none."""
    v4 = F.concat(F.lit("0" * 20 + "ffff"), F.lower(F.lpad(F.hex(urls.ipv4_number(ip)), 8, "0")))
    return F.when(F.contains(ip, F.lit(":")), urls.ipv6_hex(ip)).otherwise(v4)


def _cidr_keys(cidr: Column) -> Column:
    """The prefix length in bits of 128 and the network's digits of a CIDR text, as a struct; null for a malformed one."""
    net = F.split(cidr, "/", -1)
    v4 = ~F.contains(cidr, F.lit(":"))
    given = F.get(net, F.lit(1)).try_cast("int")
    bits = F.coalesce(given, F.when(F.size(net) == 1, F.when(v4, 32).otherwise(128))) + F.when(v4, 96).otherwise(0)
    both = F.struct(bits.alias("bits"), ip_key(F.get(net, F.lit(0))).alias("key"))
    good = lambda r: r["key"].isNotNull() & r["bits"].between(F.when(v4, 96).otherwise(0), 128)
    return let(both, lambda r: F.when(good(r), r))


def cidr_prefix_join(hosts: DataFrame, ranges: DataFrame, ip: str = "ip") -> DataFrame:
    """Join IPv4 and IPv6 addresses with the networks (cidr, label) that hold them.

    A network is listed once, under its own prefix cut to a whole number of hex digits; an address carries its prefix of every length
    that occurs among the networks (33 at most, usually a few). So the join is an equi-join on (length, prefix), whatever the sizes of
    the ranges, and the up to three bits that a digit leaves open are a residual test.
    Networks that are malformed hold nothing. A mapped IPv4 address (``::ffff:10.0.0.1``) is in IPv4 networks.
    """
    listed = with_once(ranges, "_net", _cidr_keys(F.col("cidr"))).where("_net is not null").select(
        *[c for c in ranges.columns],
        F.floor(F.col("_net.bits") / 4).cast("int").alias("_digits"),
        F.expr("substring(_net.key, 1, cast(_net.bits div 4 as int))").alias("_prefix"),
        (F.col("_net.bits") % 4).alias("_open"),
        F.conv(F.expr("substring(_net.key, cast(_net.bits div 4 as int) + 1, 1)"), 16, 10).cast("int").alias("_digit"),
    )
    lengths = sorted(r[0] for r in listed.select("_digits").distinct().collect())
    keyed = with_once(hosts.withColumn("_row", F.struct(*hosts.columns)), "_key", ip_key(F.col(ip)))
    prefixes = F.array(*[F.struct(F.lit(n).alias("_digits"), F.expr(f"substring(_key, 1, {n})").alias("_prefix")) for n in lengths])
    wide = keyed.select("_row", "_key", F.inline_outer(prefixes if lengths else F.array().cast("array<struct<_digits:int,_prefix:string>>")))
    own = F.conv(F.expr("substring(_key, _digits + 1, 1)"), 16, 10).cast("int")
    near = join_small(wide.withColumn("_own", own), listed, ["_digits", "_prefix"])
    step = F.when(F.col("_open") == 0, 16).when(F.col("_open") == 1, 8).when(F.col("_open") == 2, 4).otherwise(2)
    inside = F.col("_open").eqNullSafe(0) | (F.floor(F.col("_own") / step) == F.floor(F.col("_digit") / step))
    return near.where(inside).select("_row.*", *ranges.columns)


def cidr_join(hosts: DataFrame, ranges: DataFrame, ip: str = "ip") -> DataFrame:
    """Range join of IPv4 addresses with ``ranges(lo, hi, label)`` given as numbers.

    Each range is listed under the /16 blocks it touches, so the join is an equi-join on the
    block with the bounds as a residual test, however many ranges there are.
    """
    block = 1 << 16
    listed = ranges.withColumn(
        "_block",
        F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor(F.col("hi") / block))),
    )
    numbered = with_once(hosts, "ip_number", urls.ipv4_number(F.col(ip))).withColumn(
        "_block", F.floor(F.col("ip_number") / block)
    )
    joined = join_small(numbered, listed, ["_block"])
    return joined.where(F.col("ip_number").between(F.col("lo"), F.col("hi"))).drop("_block")


def url_verdict(url: Column) -> Column:
    """``ok`` never comes from a hostname: names cannot be resolved offline. Numeric hosts are judged in every form that an
    address parser reads, such as ``0x7f.1`` or ``2130706433``."""

    def verdict(private: Column) -> Column:
        return (
            F.when(urls.url_failure(url).isNotNull(), urls.url_failure(url))
            .when(private, F.lit("blocked_ip"))
            .when(~private, F.lit("ok"))
            .otherwise(F.lit("unresolved"))
        )

    return let(urls.private_host(urls.host_of(url)), verdict)


def audit_urls(df: DataFrame, url: str = "url") -> DataFrame:
    verdict = url_verdict(F.col(url))
    return df.withColumn("verdict", verdict).withColumn(
        "blocked", ~F.col("verdict").isin("ok", "unresolved")
    )


def audit_redirects(hops: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """Each hop screened again. ``hops``: chain_id, hop (0 is the request), url.

    A chain is one request's redirects, so its window is as short as the client allowed.
    """
    chain = W.partitionBy("chain_id").orderBy("hop")
    netloc = urls.netloc_of(F.col("url"))
    rows = audit_urls(hops).withColumns(
        {"_number": F.row_number().over(chain) - 1, "_netloc": netloc, "_before": F.lag(netloc).over(chain)}
    )
    too_many = F.col("_number") > max_hops
    return (
        rows.withColumn("verdict", F.when(too_many, F.lit("too_many_hops")).otherwise(F.col("verdict")))
        .withColumn("blocked", too_many | F.col("blocked"))
        .withColumn("cross_origin", F.coalesce(F.col("_netloc") != F.col("_before"), F.lit(False)))
        .withColumn("shown_url", urls.without_credentials(F.col("url")))
        .drop("_number", "_netloc", "_before")
    )
