"""Personal-data detection and redaction over whole texts, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.functions.let import let

# Fixed patterns, applied one after the other.
PATTERNS = {
    "EMAIL": r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+",
    "PHONE": r"(?:\+\d{1,3}[- ]?)?\(?\d{3}\)?[- ]?\d{3}[- ]?\d{4}",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "CREDIT_CARD": r"\b(?:\d(?:[ -]*\d){12,15})\b",
    "IPV4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}

# A text without this cannot match, and most texts are ruled out by it in one cheap pass.
MARKS = {"EMAIL": "@", "PHONE": "[0-9]{3}", "SSN": "[0-9]-[0-9]", "CREDIT_CARD": "[0-9][ -]*[0-9]", "IPV4": r"[0-9]\.[0-9]"}

ORDERS = {
    # Parity order: an unseparated card number is half eaten by PHONE.
    "reference": ("EMAIL", "PHONE", "SSN", "CREDIT_CARD", "IPV4"),
    # Longest digit runs first, so no card digits are left behind.
    "safe": ("CREDIT_CARD", "SSN", "EMAIL", "IPV4", "PHONE"),
}

# Unicode noncharacters: reserved for internal use, so no interchange text carries them.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"


def suspect(text: Column, kind: str) -> Column:
    mark = MARKS[kind]
    return F.contains(text, F.lit(mark)) if mark == "@" else text.rlike(mark)


def redact(text: Column, order: str = "reference") -> Column:
    for kind in ORDERS[order]:
        text = _redact_kind(text, kind)
    return text


def _redact_kind(text: Column, kind: str) -> Column:
    def replaced(t: Column) -> Column:
        hit = F.regexp_replace(t, PATTERNS[kind], f"[REDACTED_{kind}]")
        return F.when(suspect(t, kind), hit).otherwise(t)

    return let(text, replaced)


def redact_field(text: Column, field: Column, allow_fields: list[str], order: str = "reference") -> Column:
    """``redact`` unless the field is on the allow list."""
    if not allow_fields:
        return redact(text, order)
    return F.when(F.coalesce(field.isin(*allow_fields), F.lit(False)), text).otherwise(redact(text, order))


def redact_map(values: Column, skip_fields: list[str] = (), order: str = "reference") -> Column:
    """Redact every value of a string map whose key is not skipped."""
    skip = F.array(*[F.lit(f) for f in skip_fields]).cast("array<string>")
    return F.transform_values(
        values, lambda k, v: F.when(F.array_contains(skip, k), v).otherwise(redact(v, order))
    )


def redact_nested(value: Column, kind: T.DataType, skip_fields: list[str] = (), allow_fields: list[str] = (), lists: bool = False, order: str = "reference") -> Column:
    """Redact every string of a nested value, at any depth; the type stays as it is.

    The schema is walked once, when the expression is built: structs and maps are rebuilt field by field, and parts without strings pass
    as they are. A field or map key in ``skip_fields`` keeps its whole value, whatever lies below; one in ``allow_fields`` keeps its
    own string only. Lists are kept, unless ``lists``: then their members are redacted as well, under the name of the list.
    Nulls stay null at every level; map keys are never changed.
    """

    def has_text(t: T.DataType) -> bool:
        if isinstance(t, T.StructType):
            return any(f.name not in skip_fields and has_text(f.dataType) for f in t)
        if isinstance(t, T.MapType):
            return has_text(t.valueType)
        if isinstance(t, T.ArrayType):
            return lists and has_text(t.elementType)
        return isinstance(t, T.StringType)

    def named(name: Column | str, v: Column, t: T.DataType) -> Column:
        """A value under a name: a field's, or a map key that is known only at run time."""
        if not has_text(t):
            return v
        inner = walk(v, t)
        plain = isinstance(t, T.StringType)
        if isinstance(name, str):
            return v if name in skip_fields or (plain and name in allow_fields) else inner
        kept = [*skip_fields, *(allow_fields if plain else ())]
        return F.when(F.coalesce(name.isin(*kept), F.lit(False)), v).otherwise(inner) if kept else inner

    def walk(v: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            return F.when(v.isNotNull(), F.struct(*[named(f.name, v.getField(f.name), f.dataType).alias(f.name) for f in t]))
        if isinstance(t, T.MapType):
            return F.transform_values(v, lambda k, x: named(k, x, t.valueType))
        if isinstance(t, T.ArrayType):
            return F.transform(v, lambda x: walk(x, t.elementType))
        return redact(v, order)

    return walk(value, kind) if has_text(kind) else value


def matches(text: Column, kind: str) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))


def spans(text: Column, kind: str) -> Column:
    """``array<struct<start,end,match>>`` of one kind, zero-based and end-exclusive.

    Matches are fenced by noncharacters and split out; running lengths of the pieces are the offsets.
    """
    fenced = F.when(suspect(text, kind), F.regexp_replace(text, f"({PATTERNS[kind]})", f"{_OPEN}$1{_CLOSE}"))
    pieces = F.split(fenced, f"[{_OPEN}{_CLOSE}]", -1)
    start = F.struct(
        F.lit(0).alias("at"),
        F.array().cast("array<struct<start:int,end:int,match:string>>").alias("found"),
        F.lit(False).alias("inside"),
    )

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        hit = F.struct(acc["at"].alias("start"), end.alias("end"), piece.alias("match"))
        return F.struct(
            end.alias("at"),
            F.when(acc["inside"], F.concat(acc["found"], F.array(hit))).otherwise(acc["found"]).alias("found"),
            (~acc["inside"]).alias("inside"),
        )

    return F.coalesce(F.aggregate(pieces, start, step, lambda acc: acc["found"]), start["found"])


def scan(text: Column) -> Column:
    """``array<struct<type,start,end,match>>`` over the unredacted text, all kinds."""
    return F.flatten(F.array(*[_typed_spans(text, kind) for kind in PATTERNS]))


def _typed_spans(text: Column, kind: str) -> Column:
    return F.transform(
        spans(text, kind),
        lambda s: F.struct(
            F.lit(kind).alias("type"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match")
        ),
    )
