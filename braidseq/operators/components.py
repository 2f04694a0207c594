"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and a join.  Minima are pre-aggregated before
they are shuffled, and a hub, whose edges all need the hub's minimum, gets it by
broadcast (``skew.join_named``): no task sees all edges of a large component.
The rounds needed grow with the logarithm of the longest chain, not with its
length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import join_named


def connected_components(edges: DataFrame, left: str, right: str, pin, max_rounds: int = 100) -> DataFrame:
    """``node, component`` for every node of an edge; the component is named after its smallest node.

    ``pin`` writes a DataFrame to reliable storage and returns it; every round
    is pinned.  Loops, repeated edges and edges with a null end add nothing.
    """
    c = F.col
    proper = edges.where(c(left) != c(right))
    now = pin(proper.select(F.least(left, right).alias("lo"), F.greatest(left, right).alias("hi")).distinct())
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = now.select(c("hi").alias("u"), c("lo").alias("v")).unionByName(now.select(c("lo").alias("u"), c("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        met = join_named(both, least, "u", "n", 2 * mark[0])
        large = pin(met.where(c("v") > c("u")).select(c("v").alias("u"), c("m").alias("v")).where("u != v").distinct())
        small_min = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        met = join_named(large, small_min, "u", "n", 2 * mark[0])
        small = (
            met.where("v != m").select(c("m").alias("lo"), c("v").alias("hi"))
            .unionByName(small_min.select(c("m").alias("lo"), c("u").alias("hi"))).distinct()
        )
        now = pin(small)
        after = _mark(now)
        if after == mark:
            break
        mark = after
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = now.select("lo").distinct()
    return now.select(c("hi").alias("node"), c("lo").alias("component")).unionByName(roots.select(c("lo").alias("node"), c("lo").alias("component")))


def _mark(pairs: DataFrame) -> tuple:
    """Count and order-free digest of a set of pairs."""
    row = pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("lo", "hi")).alias("x"), F.sum(F.xxhash64("hi", "lo") % 1_000_003).alias("s")).first()
    return row["n"], row["x"], row["s"]
