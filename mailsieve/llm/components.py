"""Connected components of large graphs by alternating star rewrites, every half round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.plans.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are joined to the least of it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are joined to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    near = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return near.unionByName(least.select("a", F.col("least").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node it is connected to) for every node of the edges (a, b) but the roots.

    A round costs two aggregations and two joins of the edges; the number of rounds grows with the logarithm of the
    number of nodes. What ends the loop is a count and two sums of hashes, no list of nodes."""
    def state(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())

    now = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges")
    before = state(now)
    while True:
        now = materialize(_small_star(materialize(_large_star(now), "edges")), "edges")
        after = state(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
