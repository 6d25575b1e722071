"""URL parts, screening and resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftloom.functions.let import let

_SPLIT = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _piece(url: Column, i: int) -> Column:
    return F.regexp_extract(url, "(?s)" + _SPLIT, i)


def scheme_of(url: Column) -> Column:
    return F.lower(_piece(url, 1))


def netloc_of(url: Column) -> Column:
    """Authority as written: credentials, host and port."""
    return _piece(url, 2)


def path_of(url: Column) -> Column:
    """Path with query, as robots rules see it; an empty path is ``/``."""
    path = F.concat(_piece(url, 3), _piece(url, 4))
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))


def domain_of(url: Column) -> Column:
    """Authority with every ``www.`` removed."""
    return F.replace(netloc_of(url), F.lit("www."), F.lit(""))


def host_of(url: Column) -> Column:
    """Lower-case host without credentials, port and IPv6 brackets."""
    bare = F.regexp_replace(netloc_of(url), r"^.*@", "")
    host = F.when(
        F.startswith(bare, F.lit("[")), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)
    ).otherwise(F.regexp_replace(bare, r":[^:]*$", ""))
    return F.lower(host)


def without_credentials(url: Column) -> Column:
    return F.regexp_replace(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://)[^/?#]*@", "$1")


def url_failure(url: Column) -> Column:
    """Null for an http(s) URL with a host, else ``scheme_not_allowed`` or ``no_host``."""
    allowed = F.coalesce(scheme_of(url).isin("http", "https"), F.lit(False))
    return F.when(~allowed, F.lit("scheme_not_allowed")).when(host_of(url) == "", F.lit("no_host"))


def url_eligible(url: Column) -> Column:
    return url_failure(url).isNull()


# Fixed private, loopback, link-local, reserved, multicast and unspecified IPv4 ranges.
IPV4_BLOCKED = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
    "224.0.0.0/4", "240.0.0.0/4",
)

# The two globally reachable anycast addresses inside 192.0.0.0/24.
IPV4_OPEN = ("192.0.0.9/32", "192.0.0.10/32")

# Fixed IPv6 ranges of the same kinds; mapped IPv4 addresses are unwrapped before the test.
IPV6_BLOCKED = (
    "::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16",
    "3fff::/20", "fc00::/7", "fe80::/10", "ff00::/8",
)

# Globally reachable parts of 2001::/23.
IPV6_OPEN = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")

IPV4 = r"^(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})$"


def ipv4_number(ip: Column) -> Column:
    """Dotted quad as long; null when it is not one (leading zeros are refused)."""
    quad = F.split(ip, r"\.")
    octet = [F.get(quad, F.lit(i)).try_cast("bigint") for i in range(4)]
    number = ((octet[0] * 256 + octet[1]) * 256 + octet[2]) * 256 + octet[3]
    return F.when(ip.rlike(IPV4) & (F.greatest(*octet) <= 255), number)


# One part of a numeric host: hexadecimal, octal or decimal.
HOST_PART = r"(?:0[xX][0-9a-fA-F]+|0[0-7]*|[1-9][0-9]*)"


def ipv4_of_host(host: Column) -> Column:
    """The IPv4 address that address parsers read from a host: one to four parts, each decimal, octal (``0177``) or hexadecimal
    (``0x7f``), the last one filling the bytes that are left, as in ``127.1`` or ``2130706433``. Null when it is none: a part that is
    no number or too large, or a name. One dot may end it."""

    def value(part: Column) -> Column:
        is_hex = part.rlike("^0[xX]")
        digits = F.regexp_replace(part, "^0[xX]?0*", "")
        base = F.when(is_hex, 16).when(F.startswith(part, F.lit("0")), 8).otherwise(10)
        # Longer digits are beyond 32 bits in every base.
        number = F.when(is_hex, F.conv(digits, 16, 10)).when(base == 8, F.conv(digits, 8, 10)).otherwise(digits)
        return F.when(digits == "", F.lit(0)).when(F.length(digits) <= F.when(base == 16, 8).when(base == 8, 11).otherwise(10), number.cast("bigint"))

    def number(parts: Column) -> Column:
        values = F.transform(parts, value)

        def combined(v: Column) -> Column:
            size, last = F.size(v), F.element_at(v, -1)
            leading = F.slice(v, F.lit(1), size - 1)
            room = F.element_at(F.array(*[F.lit(256**k) for k in (4, 3, 2, 1)]), size)
            high = F.aggregate(leading, F.lit(0).cast("bigint"), lambda n, x: n * 256 + x)
            return F.when(F.forall(leading, lambda x: x <= 255) & (last < room), high * room + last)

        return let(values, combined)

    bare = F.regexp_replace(host, r"\.$", "")
    numeric = bare.rlike(rf"^{HOST_PART}(?:\.{HOST_PART}){{0,3}}$")
    return F.when(numeric, let(F.split(bare, r"\.", -1), number))


def ipv6_hex(ip: Column) -> Column:
    """IPv6 text as 32 hex digits; null when it is not one."""

    def undotted(ip: Column) -> Column:
        tail = ipv4_number(F.regexp_extract(ip, r":([0-9.]+)$", 1))
        as_hex = F.lower(F.lpad(F.hex(tail), 8, "0"))
        head = F.regexp_replace(ip, r"[0-9.]+$", "")
        joined = F.concat(head, F.substring(as_hex, 1, 4), F.lit(":"), F.substring(as_hex, 5, 4))
        return F.lower(F.coalesce(joined, ip))

    def groups(halves: Column, i: int) -> Column:
        half = F.coalesce(F.get(halves, F.lit(i)), F.lit(""))
        return F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":", -1))

    def filled(h: Column) -> Column:
        missing = 8 - F.size(h["head"]) - F.size(h["rest"])
        valid = F.when(h["n"] == 2, missing >= 1).otherwise((h["n"] == 1) & (missing == 0))
        zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))
        return F.when(valid, F.concat(h["head"], zeros, h["rest"]))

    def packed(full: Column) -> Column:
        valid = F.forall(full, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(valid, F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))

    halves = let(undotted(ip), lambda t: F.split(t, "::", -1))
    split = let(
        halves,
        lambda h: F.struct(F.size(h).alias("n"), groups(h, 0).alias("head"), groups(h, 1).alias("rest")),
    )
    return let(let(split, filled), packed)


def cidr_bounds(cidr: str) -> tuple[int, int]:
    import ipaddress

    net = ipaddress.ip_network(cidr)
    return int(net.network_address), int(net.broadcast_address)


def _any_range(value: Column, cidrs: tuple[str, ...], as_literal) -> Column:
    test = F.lit(False)
    for lo, hi in map(cidr_bounds, cidrs):
        test = test | value.between(as_literal(lo), as_literal(hi))
    return test


def ipv4_blocked(number: Column) -> Column:
    return _any_range(number, IPV4_BLOCKED, F.lit) & ~_any_range(number, IPV4_OPEN, F.lit)


def ipv6_blocked(v6: Column) -> Column:
    """The same for 32 hex digits."""

    def as_hex(n: int) -> Column:
        return F.lit(f"{n:032x}")

    mapped = F.conv(F.substring(v6, 25, 8), 16, 10).cast("bigint")
    blocked = _any_range(v6, IPV6_BLOCKED, as_hex) & ~_any_range(v6, IPV6_OPEN, as_hex)
    return F.when(F.startswith(v6, F.lit("0" * 20 + "ffff")), let(mapped, ipv4_blocked)).otherwise(blocked)


def is_private_ip(ip: Column) -> Column:
    """Literal address in a blocked range; anything that is not an address is false."""
    v4_verdict = let(ipv4_number(ip), ipv4_blocked)
    verdict = F.when(F.contains(ip, F.lit(":")), let(ipv6_hex(ip), ipv6_blocked)).otherwise(v4_verdict)
    return F.coalesce(verdict, F.lit(False))


def private_host(host: Column) -> Column:
    """Whether a host stands for an address in a blocked range, in any form an address parser reads; null for a name.

    A zone (``%eth0``) is no part of an IPv6 address.
    """
    v6 = let(ipv6_hex(F.regexp_replace(host, "%.*$", "")), ipv6_blocked)
    return F.when(F.contains(host, F.lit(":")), v6).otherwise(let(ipv4_of_host(host), ipv4_blocked))


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` seen on ``base``, with ``.`` and ``..`` segments folded."""
    parts = F.struct(
        base.alias("base"), href.alias("href"),
        _piece(base, 1).alias("scheme"), _piece(base, 2).alias("netloc"),
        _piece(base, 3).alias("base_path"), _piece(base, 4).alias("base_query"),
        _piece(href, 1).alias("own_scheme"), _piece(href, 2).alias("own_netloc"),
        _piece(href, 3).alias("path"), _piece(href, 4).alias("query"), _piece(href, 5).alias("fragment"),
    )
    return let(parts, _resolved)


def _resolved(p: Column) -> Column:
    has_netloc = F.startswith(p["href"], F.lit("//"))
    folder = F.regexp_extract(p["base_path"], "^(.*/)", 1)
    joined = F.when(F.startswith(p["path"], F.lit("/")) | has_netloc, p["path"]).otherwise(
        F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), p["path"])
    )
    own_path = (p["path"] != "") | has_netloc
    # Without a path of its own a reference keeps the base path as written.
    path = F.when(own_path, fold_dots(joined)).otherwise(p["base_path"])
    query = F.when(own_path | (p["query"] != ""), p["query"]).otherwise(p["base_query"])
    netloc = F.when(has_netloc, p["own_netloc"]).otherwise(p["netloc"])
    absolute = F.concat(p["scheme"], F.lit("://"), netloc, path, query, p["fragment"])
    return F.when(p["own_scheme"] != "", p["href"]).when(p["href"] == "", p["base"]).otherwise(absolute)


def fold_dots(path: Column) -> Column:
    """Remove dot segments: each ``..`` takes the segment before it, never the root."""
    nothing = F.array().cast("array<string>")

    def step(kept: Column, segment: Column) -> Column:
        popped = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))
        return (
            F.when(segment == "..", popped)
            .when(segment == ".", kept)
            .otherwise(F.concat(kept, F.array(segment)))
        )

    def folded(p: Column) -> Column:
        kept = F.array_join(F.aggregate(F.split(p, "/", -1), nothing, step), "/")
        ends_in_dots = p.rlike(r"(^|/)\.{1,2}$")
        return (
            F.when(ends_in_dots, F.concat(kept, F.lit("/")))
            .when(p.rlike(r"(^|/)\.{1,2}/"), kept)
            .otherwise(p)
        )

    return let(path, folded)
