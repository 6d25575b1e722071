"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to ``2**bits`` cells each, by approximate quantiles, so that every cell holds about as many
rows however values are spread; strings are read as numbers by their first bytes, which keeps their order. Rows are sorted by the
index of their cell on the Hilbert curve, whose neighbours are neighbours in every dimension, and the order is cut into runs of equal
numbers of rows. Files of a run then have narrow ranges in all dimensions at once, and a reader's minima and maxima prune them.

Sorting is a range partitioning on (index, checksum, id), so a cell that holds a third of all rows is spread over many tasks. Places are
partition offsets plus row numbers within partitions: only one count per partition is put in order in one place. Texts are read once
for size and checksum and are not shuffled; ``write_shards`` moves whole rows once.

Null values of a dimension are cell 0, with the least. Null texts have size 1 and the checksum of the empty text. Repeated rows and
ties stand side by side. Other columns are not read by ``assign``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.ordering import with_places
from driftloom.session import reliable_checkpoint

BITS, SHARDS = 5, 16


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """The Hilbert index of each row of cell numbers (rows x dimensions): Gray code of the axes after undoing each level's turn."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for d in range(dims):
            turned = (x[d] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[d]) & below)
            x[0] ^= np.where(turned, below, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | ((x[d] >> level) & 1)
    return out


def number_of(column: Column, kind: str) -> Column:
    """A dimension as a number: strings by their first six bytes, the rest as they are."""
    if kind != "string":
        return column.cast("double")
    head = F.rpad(F.hex(F.substring(column.cast("binary"), 1, 6)), 12, "0")
    return F.conv(head, 16, 10).cast("double")


def cell(value: Column, bounds: list[float]) -> Column:
    """How many bounds a value reaches; null is 0."""
    found = sum(((value >= b).cast("int") for b in bounds), F.lit(0))
    return F.coalesce(found, F.lit(0))


def with_index(rows: DataFrame, dimensions: list[str], bits: int = BITS, column: str = "curve") -> DataFrame:
    """Add the Hilbert index of each row."""
    kinds = dict(rows.dtypes)
    numbers = {d: number_of(F.col(d), kinds[d]) for d in dimensions}
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = rows.agg(*(F.percentile_approx(v, steps, 1000).alias(d) for d, v in numbers.items())).first()
    cells = [cell(v, sorted(set(found[d] or []))) for d, v in numbers.items()]

    @F.pandas_udf("long")
    def index(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(curve_index(np.stack([s.to_numpy() for s in batch], axis=1), bits))

    return rows.withColumn(column, index(*cells))


def assign(docs: DataFrame, dimensions: tuple[str, ...] = ("lang", "source", "size"), shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """(doc_id, size, text_crc32, curve, place, shard, slot): rows along the curve, cut into ``shards`` runs whose numbers of rows are
    at most one apart. ``size`` is the text's bytes in UTF-8 and one."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", *(d for d in dimensions if d != "size"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    keyed = with_index(reliable_checkpoint(rows), list(dimensions), bits).select("doc_id", "size", "text_crc32", "curve")
    order = ["curve", "text_crc32", "doc_id"]
    cut = with_places(keyed, order).withColumn("shard", F.expr(f"CAST(place * {shards} DIV total AS INT)"))
    return cut.select("doc_id", "size", "text_crc32", "curve", "place", "shard", F.expr(f"place - (shard * total + {shards - 1}) DIV {shards}").alias("slot"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, files: int = 1) -> None:
    """Write whole rows in the order of the curve, a folder per shard. ``docs`` must have one row per id."""
    rows = docs.join(assigned.select("doc_id", "shard", "slot"), "doc_id")
    size = assigned.groupBy("shard").count().agg(F.max("count")).first()[0] or 1
    rows = rows.withColumn("_file", F.expr(f"CAST(slot * {files} DIV {size} AS INT)"))
    rows.repartition("shard", "_file").sortWithinPartitions("shard", "slot").drop("_file").write.partitionBy("shard").parquet(path)
