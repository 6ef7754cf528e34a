"""Connected components of links between long ids, without collecting them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornbeam.llm.common import cut, skewed_join


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the smallest node that is reachable.

    Alternating large and small stars (Kiveris et al., 2014): the number of rounds grows with the logarithm of the
    longest chain, each round keeps at most as many links, and each is cut off by a reliable checkpoint; nodes with very many links are
    joined apart. Self links
    and nulls are left out; no links give no rows."""
    e = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, before = cut(e), None
    n = e.count()
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = skewed_join(both, least, "a", "n", 2 * n).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = skewed_join(large, least, "a", "n", 2 * n).filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, n = state, state[0]
