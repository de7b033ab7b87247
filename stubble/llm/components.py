"""Connected components of a links table by smallest labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stubble.operators.staging import staged


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; the component is its smallest node.

    Each round a node takes the smallest label among its own and its neighbours', then the
    label of its label, which halves the rounds of a long chain. Labels are partial minima,
    so a node with very many links is no task of its own. Rounds are written tables.
    An empty links table gives an empty result; repeated and reversed links do no harm.
    """
    both = staged(
        links.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .union(links.select(F.col(b).alias("u"), F.col(a).alias("v")))
        .distinct()
    )
    labels = staged(
        both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select(
            "node", F.least("node", "v").alias("component")
        )
    )
    while True:
        near = (
            both.join(labels, F.col("v") == F.col("node"))
            .groupBy("u")
            .agg(F.min("component").alias("least"))
        )
        closer = labels.join(near, F.col("node") == F.col("u")).select(
            "node", "component", F.least("component", "least").alias("next")
        )
        closer = staged(closer)
        jump = closer.select(F.col("node").alias("__n"), F.col("next").alias("__next"))
        moved = staged(
            closer.join(jump, F.col("next") == F.col("__n")).select(
                "node", F.least("next", "__next").alias("component"), F.col("component").alias("was")
            )
        )
        changed = moved.where("component <> was").limit(1).count()
        labels = moved.select("node", "component")
        if not changed:
            return labels
