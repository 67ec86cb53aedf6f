"""Connected components by randomised contraction.

Every round maps each node to the neighbour (or itself) whose hash under that round's salt is smallest, renames the
edges and drops loops. A constant share of the nodes disappears per round whatever the shape of the graph, so a chain
of n links takes O(log n) rounds and the total work is linear. The renamings are composed backwards at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import settle


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node that has an edge, from edges (a, b) of any one type.

    Loops, repeats and either direction are allowed, edges with a null end are ignored. `root` is one node of the
    component, the same for all its nodes; which one depends only on the edges. Nodes and links stay in tables below
    spark.checkpoint.dir; the driver sees one row count per round. Empty edges give an empty result.
    """
    edges = settle(
        edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        label,
    )
    renamings = []
    while not edges.isEmpty():
        salt = F.lit(len(renamings))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(salt, F.col(c)).alias("h"), F.col(c).alias("n"))
        best = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("best"))
        to = settle(
            best.select("node", F.least("best", rank("node"))["n"].alias("root")).where("node is not null"), label
        )
        renamings.append(to)
        for end in ("a", "b"):
            edges = edges.join(to.select(F.col("node").alias(end), F.col("root").alias(f"{end}_to")), end)
        edges = settle(
            edges.where("a_to <> b_to")
            .select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
            .distinct(),
            label,
        )
    if not renamings:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root"))
    result = renamings.pop()
    while renamings:
        # A root of an earlier round that no later round renamed keeps its name.
        later = result.select(F.col("node").alias("root"), F.col("root").alias("last"))
        result = settle(
            renamings.pop().join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root")), label
        )
    return result
