"""Places in a total order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.session import reliable_checkpoint


def with_places(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``place`` (from 0) in the order of the columns ``order``, and ``total``, the number of rows.

    Rows are range-partitioned, checkpointed and numbered within their partition; one count per partition is summed up. Ties stand
    side by side in no set order.
    """
    parts = reliable_checkpoint(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("_part").agg(F.count("*").alias("rows"))
    before = counts.select("_part", (F.sum("rows").over(Window.orderBy("_part")) - F.col("rows")).alias("_before"), F.sum("rows").over(Window.partitionBy()).alias("total"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    placed = parts.withColumn("_own", own).join(F.broadcast(before), "_part")
    return placed.withColumn("place", F.col("_before") + F.col("_own")).select(*rows.columns, "place", "total")
