"""Expensive values, evaluated once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters and joins read instead of repeating its expression.

    Catalyst pushes a filter on a computed column below the projection, with the expression in
    it, and infers such filters for join keys and plain generators. The output of an outer
    generator is an attribute of its own, so it stays where it is. For the same reason computed
    arrays are exploded with the outer generators throughout.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))
