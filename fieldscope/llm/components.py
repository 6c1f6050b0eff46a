"""Connected components of an edge table by alternating star contractions.

Each round rewrites the edges twice (neighbours hang onto the smallest node of their
neighbourhood) until nothing changes; the number of rounds grows with the logarithm of the
longest path.  Only tables move: no node list, edge list or component reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscope.llm.common import stored


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"] or 0


def _hang(pairs: DataFrame) -> DataFrame:
    """(u, v, m): every pair with the smallest node m of u's neighbourhood, u included.

    The minima are pre-aggregated and written, so that a node with very many neighbours meets
    them in an ordinary join, whose large side can be split at run time.
    """
    least = stored(pairs.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m")), "star")
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of comparable ids -> (node, root), root being the component's smallest node.

    Loops, repeated edges and nulls are allowed (edges with a null end are no edges); nodes
    without an edge to another node do not appear.  An empty table gives an empty one.
    """
    current = stored(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(current)
    while state[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large")
        small = _hang(large)
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        current = stored(small.distinct(), "small")
        last, state = state, _state(current)
        if state == last:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
