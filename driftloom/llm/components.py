"""Connected components by label spreading and pointer jumping, for graphs that Spark holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.session import reliable_checkpoint


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every linked node; a component's name is its smallest node.

    A round gives each node the smallest label among itself and its neighbours, and then the label of its label, so paths halve:
    rounds grow with the logarithm of the longest path. Only (node, label) rows are shuffled, minima are combined before that, and
    each round is checkpointed to the shared folder. Loops and repeated links are harmless; nulls are no nodes.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    both = reliable_checkpoint(links.union(links.select("b", "a")).distinct().toDF("node", "next"))
    labels = reliable_checkpoint(both.groupBy("node").agg(F.least("node", F.min("next")).alias("label")))
    while True:
        near = both.join(labels.toDF("next", "label"), "next").groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("low"), F.col("label").alias("was"))
        jump = lower.join(labels.toDF("low", "further"), "low", "left")
        new = reliable_checkpoint(jump.select("node", F.least("low", F.coalesce("further", "low")).alias("label"), "was"))
        changed = new.filter("label <> was").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels.toDF("node", "component")
