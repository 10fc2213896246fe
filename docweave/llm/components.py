"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for edges (a, b): root is the smallest node reachable.

    Each round hooks every root to the smallest root next to it and then follows pointers twice, so the number of
    rounds grows with the logarithm of the longest chain.  Every join and minimum is by node, with map-side
    combination, and each round ends in a written table.
    """
    both = edges.select("a", "b").where("a <> b")
    both = stored(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    roots = stored(roots, "roots")
    while True:
        a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        crossing = both.join(a, "a").join(b, "b").where("ra <> rb")
        hooks = crossing.groupBy(F.greatest("ra", "rb").alias("root")).agg(F.min(F.least("ra", "rb")).alias("to"))
        hooks = stored(hooks, "hooks")
        if hooks.isEmpty():
            return roots
        for _ in range(2):
            up = hooks.select(F.col("root").alias("to"), F.col("to").alias("upper"))
            hooks = hooks.join(up, "to", "left").select("root", F.coalesce("upper", "to").alias("to"))
        roots = stored(roots.join(hooks, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
