"""Connected components of links that are never gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tieline.llm.common import stored


def roots(edges: DataFrame) -> DataFrame:
    """(a, b) longs -> (node, root) for every node of an edge; the root is the smallest node reachable, in signed order.

    Each round points every node at its smallest neighbour, follows these pointers to their ends by doubling, and contracts the
    edges to the ends. Every component with an edge loses at least half of its nodes a round, so the rounds grow with the logarithm
    of the longest chain. All state is a stored table; the driver sees counts only. No edges give an empty table."""
    edges = stored(edges.select("a", "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        at = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
        at = stored(at, "pointers")
        while True:
            up = at.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = stored(at.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("root")).alias("moved")), "pointers")
            at = jumped.select("node", "root")
            if jumped.filter("moved").isEmpty():
                break
        if found is None:
            found = at
        else:
            found = stored(found.join(at.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        a = at.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = at.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = edges.join(a, "a").join(b, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).filter("a <> b").distinct()
        edges = stored(edges, "links")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
