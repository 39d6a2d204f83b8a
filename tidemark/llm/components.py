"""Connected components of a link table, by alternating star contraction.

Each round re-hangs every node's neighbours on the smallest one (first the larger
neighbours, then the smaller), which ends in one star per component after a
number of rounds that grows with the logarithm of the links. All steps are joins
and pre-aggregated groupings; each round is cut in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable


def _hang(links: DataFrame, smaller_only: bool) -> DataFrame:
    """One star step on links (a > b): every neighbour of a node is hung on the node's least neighbour."""
    seen = links if smaller_only else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = seen.join(least, "a")
    if smaller_only:
        hung = joined.select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m"))
    else:
        hung = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("x"), "m")
    return hung.where(F.col("x") != F.col("m")).select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node reachable) for each node that has a link.

    ``links`` has two whole-number columns ``a`` and ``b``, in any order, repeats
    and self-links allowed, null-free. No links give an empty result.
    """
    now = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, state = durable(now), None
    while True:
        got = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (got["n"], got["h"]) == state or got["n"] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = (got["n"], got["h"])
        now = durable(_hang(_hang(now, smaller_only=False), smaller_only=True))
