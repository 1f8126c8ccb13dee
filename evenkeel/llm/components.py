"""Connected components by alternating small-star and large-star rounds on DataFrames.

No node's neighbours are gathered in one place: each round takes a minimum per node (pre-aggregated before the shuffle)
and joins it back, for nodes of very many neighbours by sending their minima to all workers.  Rounds are cut by written
tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import Scratch, join_hot


def _ordered(edges: DataFrame) -> DataFrame:
    u, v = F.col("u"), F.col("v")
    return edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v"))).first())


def components(scratch: Scratch, edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node of its component.

    edges has two columns of one ordered type, each row an undirected link.  Null ends and loops are ignored; repeated
    edges count once; no edges give no rows.
    """
    a, b = edges.columns
    now = scratch.keep(_ordered(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()), f"{label}-0")
    mark, k = _mark(now), 0
    while mark[0]:
        # Smaller neighbours first: that leaves about one edge a node, so that the step that needs both directions is small.
        low = now.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_hot(now, low, "u", "n", mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        small = scratch.keep(_ordered(small), f"{label}-small-{k}")
        both = small.unionByName(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_hot(both, low, "u", "n", 2 * mark[0]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        k += 1
        then, now = f"{label}-{k - 1}", scratch.keep(_ordered(large), f"{label}-{k}")
        scratch.drop(then, f"{label}-small-{k - 1}")
        last, mark = mark, _mark(now)
        if last == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
