"""Columns over a page's HTML: native where a pattern is exact, one parse otherwise."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.functions import dom, text
from driftloom.functions.let import let


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _LIST = T.StringType(), T.ArrayType(T.StringType())
NODES = T.ArrayType(_struct(tag=_S, value=_S, href=_S, error=_S))
CARDS = _struct(
    container=_S,
    cards=T.ArrayType(_struct(text=_S, link=_S, label=_S, values=_LIST, hrefs=_LIST)),
)

# Elements that cannot contain themselves, so the first end tag is theirs.
FLAT_TAGS = ("title", "h1", "h2", "h3", "h4", "h5", "h6", "button", "label")

# Fixed list: containers tried in order when the configured one matches nothing.
FALLBACK_CONTAINERS = (
    '[role="listitem"]',
    "article",
    "li:has(a[href])",
    "li",
    '[class*="card"]',
    '[class*="item"]',
    '[class*="result"]',
    '[class*="product"]',
    '[class*="listing"]',
)


#: Rows of a batch that are Python objects at a time. A batch may hold ten thousand pages.
SLICE = 64

_TEXT, _TEXTS = pa.string(), pa.list_(pa.string())
_NODES = pa.list_(pa.struct([(name, _TEXT) for name in ("tag", "value", "href", "error")]))
_CARD = pa.struct([("text", _TEXT), ("link", _TEXT), ("label", _TEXT), ("values", _TEXTS), ("hrefs", _TEXTS)])
_CARDS = pa.struct([("container", _TEXT), ("cards", pa.list_(_CARD))])


def by_slices(one: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``one`` of each row; beside the batch and its result only a slice's rows and one page's tree are in memory."""
    parts = [pa.array([], kind)]
    for at in range(0, len(columns[0]), SLICE):
        parts.append(pa.array([one(*row) for row in zip(*(c.slice(at, SLICE).to_pylist() for c in columns))], kind))
    return pa.concat_arrays(parts)


@F.arrow_udf(NODES)
def select_nodes(html: pa.Array, wanted: pa.Array) -> pa.Array:
    """First match of each ``struct<selector,strategy>``; a null page is not parsed."""

    def one(page_html, selectors):
        if page_html is None:
            return None
        page, out = dom.parse(page_html), []
        for s in selectors:
            try:
                node = dom.first(page, s["selector"], s["strategy"])
            except dom.UnsupportedSelector:
                out.append((None, None, None, "unsupported_selector"))
                continue
            if node is None:
                out.append((None, None, None, "no_match"))
            else:
                out.append((node.tag, node.text().strip(), node.attrs.get("href"), None))
        page.close()
        return out

    return by_slices(one, _NODES, html, wanted)


@F.arrow_udf(CARDS)
def select_cards(html: pa.Array, container: pa.Array, wanted: pa.Array) -> pa.Array:
    """The repeated containers of a listing page and each field's match inside them.

    ``container`` in the result is the selector that matched: the configured one or the first
    fallback with a match. The literal selector ``text`` asks for no node.
    """

    def one(page_html, own, selectors):
        if page_html is None:
            return None, []
        page = dom.parse(page_html)
        out = cards_of(page, own, selectors)
        page.close()
        return out

    def cards_of(page, own, selectors):
        for candidate in ([own] if own else []) + list(FALLBACK_CONTAINERS):
            try:
                test = dom.compile_selector(candidate, "css")
            except dom.UnsupportedSelector:
                continue
            found = [n for n in page.nodes if test(n)]
            if found:
                return candidate, [card(n, selectors) for n in found]
        return None, []

    link_test = dom.compile_selector("a[href]", "css")

    def card(node, selectors):
        inside = list(dom.descendants(node))
        link = next((n for n in inside if link_test(n)), None)
        values, hrefs = [], []
        for s in selectors:
            hit = None
            if s["selector"] and s["selector"] != "text":
                try:
                    test = dom.compile_selector(s["selector"], "css")
                    hit = next((n for n in inside if test(n)), None)
                except dom.UnsupportedSelector:
                    hit = None
            values.append(hit.text().strip() or None if hit is not None else None)
            hrefs.append(hit.attrs.get("href") or None if hit is not None else None)
        return {
            "text": node.text(),
            "link": (link.attrs.get("href") or None) if link is not None else None,
            "label": link.attrs.get("aria-label") if link is not None else None,
            "values": values,
            "hrefs": hrefs,
        }

    return by_slices(one, _CARDS, html, container, wanted)


@F.arrow_udf(_S)
def _drop_hidden(html: pa.Array) -> pa.Array:
    return by_slices(lambda h: None if h is None else dom.drop_hidden(h), _TEXT, html)


def selector_pattern(selector: Column, strategy: Column) -> Column:
    """Regex that finds the selector's element exactly, or null when a parse is needed."""
    tag = F.lower(F.trim(selector))
    pattern = F.concat(F.lit("(?is)<"), tag, F.lit(r"(?:\s[^>]*)?>.*?</"), tag, F.lit(r"\s*>"))
    return F.when((strategy == "css") & tag.isin(*FLAT_TAGS), pattern)


def plain(html: Column) -> Column:
    """Whether a pattern reads the page as a parser does: no ``>`` inside a quoted attribute, no raw-text element but scripts and
    styles, and each start tag of an element that patterns look for has its end tag behind it."""
    quoted = html.rlike(r"""(?s)<[a-zA-Z][^<>"']*(?:"[^"<>]*"[^<>"']*|'[^'<>]*'[^<>"']*)*(?:"[^"]*[<>]|'[^']*[<>])""")
    raw = html.rlike(r"(?i)<(?:textarea|iframe|xmp|noembed|noframes|noscript|template|plaintext|svg|math|select)\b|<!\[CDATA")
    tags = "|".join(FLAT_TAGS)
    rest = F.regexp_replace(without_code(html), rf"(?is)<({tags})(?=[\s/>])[^>]*>.*?</\1\s*>", "")
    return ~quoted & ~raw & ~rest.rlike(rf"(?i)</?(?:{tags})(?=[\s/>])")


def failed_node(error: str) -> Column:
    """A node as ``select_nodes`` gives it where there is nothing to find."""
    none = F.lit(None).cast("string")
    return F.struct(none.alias("tag"), none.alias("value"), none.alias("href"), F.lit(error).alias("error"))


def without_code(html: Column) -> Column:
    """Comments, scripts and styles blanked, so tags quoted inside them cannot match."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", "")


def unescape(s: Column) -> Column:
    """Decode character references in one left-to-right pass."""
    return let(s, _unescaped)


def _unescaped(s: Column) -> Column:
    named = F.from_json(F.lit(json.dumps({k: v for k, v in html5.items()})), "map<string,string>")
    tokens = F.regexp_extract_all(
        s, F.lit(r"(?s)&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[A-Za-z][A-Za-z0-9]*;?|[^&]+|&"), F.lit(0)
    )

    def decode(token: Column) -> Column:
        digits = F.regexp_extract(token, "^&#([0-9]+)", 1)
        hexed = F.regexp_extract(token, "^&#[xX]([0-9a-fA-F]+)", 1)
        code = F.coalesce(F.nullif(digits, F.lit("")).try_cast("bigint"), F.conv(F.nullif(hexed, F.lit("")), 16, 10).try_cast("bigint"))
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return (
            F.when(~F.startswith(token, F.lit("&")), token)
            .when(F.startswith(token, F.lit("&#")), F.when(valid, char).otherwise(F.lit("\ufffd")))
            .otherwise(F.coalesce(named[F.substring(token, 2, 64)], token))
        )

    return F.when(F.contains(s, F.lit("&")), F.array_join(F.transform(tokens, decode), "")).otherwise(s)


def strip_space(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def fragment_text(fragment: Column) -> Column:
    """Text of one element's source."""
    return strip_space(unescape(F.regexp_replace(fragment, "(?s)<[^>]*>", "")))


def native_nodes(clean_html: Column, wanted: Column) -> Column:
    """Same shape as ``select_nodes``, for selectors that carry a ``pattern``."""

    def one(s: Column) -> Column:
        def node(source: Column) -> Column:
            return F.struct(
                F.when(source.isNotNull(), F.lower(F.trim(s["selector"]))).alias("tag"),
                fragment_text(source).alias("value"),
                F.lit(None).cast("string").alias("href"),
                F.when(source.isNull(), F.lit("no_match")).alias("error"),
            )

        return let(F.regexp_substr(clean_html, s["pattern"]), node)

    return F.transform(wanted, one)


def element_outline(tag: Column, value: Column) -> Column:
    """One accessibility-style line for an element."""
    level = F.regexp_extract(tag, "^h([1-6])$", 1)
    role = (
        F.when(level != "", F.lit("heading"))
        .when(tag == "a", F.lit("link"))
        .when(tag == "li", F.lit("listitem"))
        .when(tag == "nav", F.lit("navigation"))
        .when(tag == "footer", F.lit("contentinfo"))
        .when(tag == "p", F.lit("paragraph"))
        .otherwise(tag)
    )
    suffix = F.when(level != "", F.concat(F.lit(" [level="), level, F.lit("]"))).otherwise(F.lit(""))
    return F.concat(F.lit("- "), role, F.lit(' "'), F.regexp_replace(value, r"\s+", " "), F.lit('"'), suffix)


def page_outline(html: Column) -> Column:
    """Tag and text outline of a page body, one line per structural element."""
    body = without_code(html)
    marked = F.regexp_replace(body, r"(?i)<(h[1-6]|a|li|p|nav|article|footer|header|main|button|td|th|div)\b[^>]*>", "\n- $1 ")
    plain = F.regexp_replace(marked, "(?s)<[^>]*>", " ")
    return strip_space(unescape(F.regexp_replace(plain, r"[ \t]+", " ")))


def strip_hidden(html: Column) -> Column:
    """Only pages that carry a hiding marker are parsed."""
    suspect = html.rlike(r"(?i)hidden|display|opacity")
    return F.when(suspect, _drop_hidden(F.when(suspect, html))).otherwise(html)


def sanitize(raw: Column, limit: int = 500) -> Column:
    """Clean untrusted content and fence it, in the fixed order of the steps below."""
    clean = strip_hidden(text.strip_executable(text.strip_obfuscation(raw)))
    clean = text.strip_data_attributes(text.strip_event_handlers(clean))
    return text.wrap_untrusted(text.escape_delimiter(text.truncate(clean, limit)))


def sanitize_checked(raw: Column, limit: int = 500) -> Column:
    """``content`` as ``sanitize`` gives it, and ``patterns``: the injection patterns found in the raw text, before anything is cut."""
    return F.struct(sanitize(raw, limit).alias("content"), text.injection_patterns(raw).alias("patterns"))
