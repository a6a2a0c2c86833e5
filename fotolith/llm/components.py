"""Connected components of a distributed graph by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolith.llm.common import Scratch

#: Rounds after which the loop gives up; each round about halves the depth.
MAX_ROUNDS = 60


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root``: each node of ``edges(a, b)`` (longs) that has a smaller reachable node.

    Large stars link a node's greater neighbours to its least neighbour, small
    stars its lesser ones; repeated, every component becomes a star around its
    least node. Each round is written to the shared folder, so lineage stays
    one round deep, and edges never exceed those given. A node that is the
    least of its component, or has no edge, gives no row.
    """
    edges = scratch.write(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges0"
    )
    before = None
    for k in range(1, MAX_ROUNDS + 1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = scratch.write(small, f"edges{k}")
        scratch.drop(f"edges{k - 1}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components: not settled after {MAX_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
