"""Connected components of a graph of links, by alternating star contractions.

Each round hangs every node's larger neighbours on its smallest neighbour (large star),
then every node and its smaller neighbours on the smallest of them (small star).  Rounds
go on until only stars are left, which takes about the logarithm of the longest chain.  Each
round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrec.storage import stored

LINKS_PER_TASK = 200_000


def _done(edges: DataFrame) -> bool:
    """Whether every larger end has one smaller end, which itself has none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    each = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not each.where("up > 1 or (up > 0 and down > 0)").limit(1).count()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node in ``links``; the label is the component's smallest node.

    Null ends and links of a node with itself are left out.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    edges = links.select(u.alias("u"), v.alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    edges = stored(edges.distinct(), "links")
    # Never more links than at first, so no more tasks than these need write them.
    tasks = max(8, -(-edges.count() // LINKS_PER_TASK))
    while not _done(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
        large = stored(large.distinct().coalesce(tasks), "large_star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").where("v <> m")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        edges = stored(small.distinct().coalesce(tasks), "small_star")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
