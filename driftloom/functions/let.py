"""Bind a value once inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A Python-side composition repeats its input at every use, so nested compositions grow
    exponentially; a one-element ``transform`` keeps the expression as small as it reads.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
