"""Connected components of a table of links, by contraction.

Every round hooks each node to its smallest neighbour, follows one further
step, and replaces the ends of all links by their new labels; links inside a
component vanish.  What is left is written to the shared folder each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.common import stored


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b of one orderable type); the root is a node of the component.

    The minimum per node is taken with partial aggregation, so a node with
    very many links is one row per task; the joins that follow are plain
    joins whose large partitions adaptive execution splits.
    """
    links = stored(links.filter("a <> b").select("a", "b").distinct(), "links")
    labels = None
    for _ in range(most_rounds):
        if links.isEmpty():
            break
        ends = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        near = ends.select("e.a", "e.b").groupBy("a").agg(F.min("b").alias("b"))
        hooked = near.select(F.col("a").alias("node"), F.least("a", "b").alias("up"))
        further = hooked.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
        parent = stored(
            hooked.join(further, F.col("up") == F.col("_n"), "left").select("node", F.coalesce("_u", "up").alias("up")), "parents"
        )
        if labels is None:
            labels = parent.select("node", F.col("up").alias("root"))
        else:
            step = parent.select(F.col("node").alias("_n"), "up")
            labels = stored(labels.join(step, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
        first = parent.select(F.col("node").alias("a"), F.col("up").alias("_a"))
        second = parent.select(F.col("node").alias("b"), F.col("up").alias("_b"))
        moved = links.join(first, "a").join(second, "b").filter("_a <> _b")
        links = stored(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "links")
    else:
        raise RuntimeError("the links did not contract")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
