"""Phylogenies as edge tables (node_name, parent_name, branch_length, postorder)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exonia.session import discard, stored

#: Nodes of a tree at most; trees are sent to all tasks.
MAX_NODES = 100_000


def collected(edges: DataFrame) -> list[tuple[str, str | None]]:
    """(node, parent) in post-order; a tree of more than MAX_NODES nodes fails."""
    rows = edges.select("node_name", "parent_name", "postorder").limit(MAX_NODES + 1).collect()
    if len(rows) > MAX_NODES:
        raise ValueError("a tree of too many nodes")
    return [(r.node_name, r.parent_name) for r in sorted(rows, key=lambda r: r.postorder)]


def rooted(edges: DataFrame) -> DataFrame:
    """(node_name, parent_name, depth, root_distance, is_leaf). Nodes that no root leads to are left out.

    Each round doubles the way that every node has gone up, so a tree of any depth takes as many rounds as its depth has
    binary digits; a table is stored after each."""
    length = F.coalesce("branch_length", F.lit(0.0))
    state = stored(edges.select("node_name", "parent_name", F.col("parent_name").alias("_up"), F.when(F.col("parent_name").isNull(), 0).otherwise(1).alias("depth"), length.alias("root_distance")), "climbed")
    most = state.count().bit_length() + 1
    # Who is still on the way after that many rounds goes round in a circle.
    for _ in range(most):
        on = state.where("_up is not null")
        if on.isEmpty():
            break
        above = state.select(F.col("node_name").alias("_up"), F.col("_up").alias("_next"), F.col("depth").alias("_d"), F.col("root_distance").alias("_r"))
        further = on.join(above, "_up").select("node_name", "parent_name", F.col("_next").alias("_up"), (F.col("depth") + F.col("_d")).alias("depth"), (F.col("root_distance") + F.col("_r")).alias("root_distance"))
        after = stored(state.where("_up is null").unionByName(further), "climbed")
        discard(state)
        state = after
    out = state.where("_up is null").drop("_up")
    parents = edges.where(F.col("parent_name").isNotNull()).select(F.col("parent_name").alias("_p")).distinct()
    return out.join(parents, out["node_name"] == parents["_p"], "left").withColumn("is_leaf", F.col("_p").isNull()).drop("_p")
