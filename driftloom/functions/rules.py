"""Business-rule predicates over a scraped string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftloom.functions.parsing import to_number

# Fixed rule vocabulary.
OPS = ("gt", "gte", "lt", "lte", "eq", "ne", "min_length", "max_length", "regex", "in")


def rule_check(op: Column, value: Column, target: Column, targets: Column | None = None) -> Column:
    """Does ``value`` satisfy ``op target``? Null values, unreadable numbers and unknown ops fail.

    ``targets`` is the list form of an ``in`` rule; without it ``in`` is a substring test.
    """
    op = F.lower(op)
    left, right = to_number(value), to_number(target)
    size = target.try_cast("int")
    inside = F.contains(target, value)
    if targets is not None:
        inside = F.when(targets.isNotNull(), F.array_contains(targets, value)).otherwise(inside)
    verdict = (
        F.when(op == "gt", left > right)
        .when(op == "gte", left >= right)
        .when(op == "lt", left < right)
        .when(op == "lte", left <= right)
        .when(op == "eq", value == target)
        .when(op == "ne", value != target)
        .when(op == "min_length", F.length(value) >= size)
        .when(op == "max_length", F.length(value) <= size)
        .when(op == "regex", F.regexp_like(value, F.concat(F.lit("^(?:"), target, F.lit(")"))))
        .when(op == "in", inside)
    )
    return F.coalesce(verdict, F.lit(False))


def context_matches(rule_context: Column, row_context: Column) -> Column:
    """Every pair of the rule's context is present in the row's; an empty rule context always applies."""
    unconditional = rule_context.isNull() | (F.size(rule_context) == 0)
    contained = F.forall(
        F.map_entries(rule_context), lambda e: row_context[e["key"]].eqNullSafe(e["value"])
    )
    return unconditional | (row_context.isNotNull() & F.coalesce(contained, F.lit(False)))
