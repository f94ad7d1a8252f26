"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.runtime import cut


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return row["n"], row["h"] or 0


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: each node links its larger (large) or smaller (small) neighbours to the least one."""
    # no union here: Spark 4.1 fails to carry a checkpoint's own constraints through one
    ways = F.inline(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = edges.select(ways) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    near = both.join(least, both["a"] == least["u"])
    out = near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: longs); root is the least node that can be reached.

    Self links and null ends are ignored; repeated links count once. Each round is kept in the shared folder,
    so a lost executor costs one round at most; the number of rounds grows as the logarithm of the longest chain.
    """
    edges = cut(edges.where("a != b").distinct())
    mark = _mark(edges)
    while mark[0]:
        edges = cut(_star(_star(edges, True), False))
        after = _mark(edges)
        if after == mark:
            break
        mark = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
