"""Cleaning and screening of untrusted page content; everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed list: zero-width space, byte-order mark, bidirectional controls.
OBFUSCATION = "\u200b\ufeff\u202a\u202b\u202c\u202d\u202e"

# Fixed injection patterns, by name.
INJECTION = {
    "ignore_previous": r"(?i)ignore\s+previous",
    "system_override": r"(?i)system\s+override",
    "you_are_now": r"(?i)you\s+are\s+now",
    "dan_mode": r"(?i)dan\s+mode",
    "system_role": r"(?i)system:",
    "assistant_role": r"(?i)assistant:",
}

# Fixed list of subtrees that never carry data.
EXECUTABLE_TAGS = ("script", "style", "iframe", "noscript", "object", "embed", "svg")

# Fixed fence and patterns.
FENCE = "untrusted_scraped_content"
SECRET = r"((?:token|key|authorization|api_key|password|secret)[^=]*)=([^&\s]+)"
SECRET_LENIENT = r"((?:token|key|authorization|api_key|password|secret)[^=]*?)\s*=\s*[\"']?([^&\s\"']+)[\"']?"


def strip_obfuscation(s: Column) -> Column:
    return F.translate(s, OBFUSCATION, "")


def strip_executable(html: Column) -> Column:
    """Drop script-like subtrees. A subtree without an end tag runs to the end of the text."""
    tags = "|".join(t for t in EXECUTABLE_TAGS if t != "embed")
    without = F.regexp_replace(html, rf"(?is)<({tags})\b[^>]*>.*?(?:</\1\s*>|\z)", "")
    return F.regexp_replace(without, r"(?is)<embed\b[^>]*>(?:\s*</embed\s*>)?", "")


def strip_event_handlers(html: Column) -> Column:
    return F.regexp_replace(html, r"""(?i)\s+on[a-z]+\s*=\s*(["']).*?\1""", "")


def strip_data_attributes(html: Column) -> Column:
    """``data-testid`` survives."""
    return F.regexp_replace(html, r"""(?i)\s+data-(?!testid=)[a-z0-9\-]+\s*=\s*(["']).*?\1""", "")


def truncate(s: Column, limit: int = 500) -> Column:
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit("..."))).otherwise(s)


def escape_delimiter(s: Column) -> Column:
    return F.replace(s, F.lit(f"</{FENCE}>"), F.lit(f"&lt;/{FENCE}&gt;"))


def wrap_untrusted(s: Column) -> Column:
    return F.concat(F.lit(f"<{FENCE}>\n"), s, F.lit(f"\n</{FENCE}>"))


def injection_patterns(s: Column) -> Column:
    """Names of the patterns that occur anywhere in the text."""
    found = F.array(*[F.when(s.rlike(p), F.lit(name)) for name, p in INJECTION.items()])
    return F.array_compact(found)


def redact_secrets(s: Column, limit: int = 1000, lenient: bool = False) -> Column:
    """Shorten a log value (noting its length), then blank the value of ``key=value`` credentials.

    ``lenient`` also catches blanks and quotes around the equals sign.
    """
    short = F.when(
        F.length(s) > limit,
        F.concat(
            F.substring(s, 1, limit),
            F.lit("... [TRUNCATED, original length: "),
            F.length(s).cast("string"),
            F.lit("]"),
        ),
    ).otherwise(s)
    pattern = SECRET_LENIENT if lenient else SECRET
    return F.regexp_replace(short, "(?i)" + pattern, "$1=[REDACTED]")


def text_signature(s: Column, limit: int = 200) -> Column:
    return F.substring(F.trim(s), 1, limit)
