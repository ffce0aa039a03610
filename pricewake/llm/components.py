"""Connected components by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewake.llm.common import cut, join_split


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Node and the smallest node it is connected with, for every node of an edge.

    Any orderable node type. Edges with a null end, loops and repeats are
    ignored; no edge gives no row.

    Every edge leads from a node to a smaller one, its parent. A round hooks a
    node's other parents under the smallest one, and then replaces every parent
    by that parent's own parent, if it has one. That keeps components, halves
    paths, and ends with every node under the smallest node of its component.
    Stars are final after one round; rounds grow with the logarithm of the
    longest path.

    Only nodes with a parent are grouped on, so that a centre with very many
    nodes is never one group; it is a hot value of one join, which adaptive
    execution may split. Each round is checkpointed; one flag comes to the driver.
    """
    a, b = F.col(left), F.col(right)
    # A comparison with null is not true, so edges with a null end go, too.
    current = cut(edges.where(a != b).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("parent")).distinct())
    while True:
        lowest = current.groupBy("node").agg(F.min("parent").alias("low"))
        other = F.col("parent") != F.col("low")
        hooked = current.join(lowest, "node").select(
            F.when(other, F.col("parent")).otherwise(F.col("node")).alias("node"),
            F.col("low").alias("parent"),
            other.alias("moved"),
        )
        above = hooked.groupBy("node").agg(F.min("parent").alias("above")).withColumnRenamed("node", "parent")
        jumped = join_split(hooked, above, "parent", "left")
        current = cut(
            jumped.groupBy("node", F.coalesce("above", "parent").alias("parent"))
            .agg(F.max(F.col("moved") | F.col("above").isNotNull()).alias("moved"))
        )
        if not current.agg(F.max("moved")).first()[0]:
            break
    nodes = current.select("node", F.col("parent").alias("component"))
    smallest = current.select(F.col("parent").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return nodes.unionByName(smallest)
