"""Joins of a wide table with a table that is usually, but not surely, small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 20_000
MAX_BROADCAST_IDS = 1_000_000
#: A broadcast table's size as JSON text, which is more than it takes in memory.
MAX_BROADCAST_BYTES = 64_000_000


def proven_small(side: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether a table has at most so many rows and bytes. The measuring job stops at the row limit."""
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*side.columns)))), F.lit(0))
    rows, size = side.limit(max_rows + 1).agg(F.count(F.lit(1)), size).first()
    return rows <= max_rows and size <= max_bytes


def join_small(wide: DataFrame, side: DataFrame, on: list[str], how: str = "inner", max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``side`` when its rows and bytes, measured, prove it small; else a plain join. The rows are the same.

    Configuration derived from large tables carries no usable size estimate, and without the
    broadcast the wide side would be shuffled whole.
    """
    return wide.join(F.broadcast(side) if proven_small(side, max_rows) else side, on, how)
