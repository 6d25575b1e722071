"""Wide rows meet a narrow table of keys; names that clash with none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of (key and a few numbers) that are broadcast at most: some 20 MB.
BROADCAST_ROWS = 500_000


def meet(docs: DataFrame, narrow: DataFrame, key: str, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join texts with a narrow table whose keys stand once each. Up to ``most`` rows, counted, the texts stay where they lie; more
    rows meet them in a shuffle, hashed on the narrow side so that texts are not sorted."""
    small = narrow.limit(most + 1).count() <= most
    return docs.join(F.broadcast(narrow) if small else narrow.hint("shuffle_hash"), key, how)


def unused(columns: list[str], name: str) -> str:
    """``name``, made longer until no column has it (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
