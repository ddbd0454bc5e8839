"""Connected components of links between long ids, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import write_table


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links -> (node, root) for every linked node, root the smallest node reachable.

    Large star: each node links its larger neighbours to the smallest of its
    neighbourhood; small star: its smaller neighbours likewise. Each round is a
    table in the shared folder; rounds grow with the logarithm of the longest chain.
    Links are never gathered on a node: only minima by node are, with map-side
    combine, and the join back has one row per node on the other side."""
    edges = write_table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .filter("u != v").distinct(), "links")
    for _ in range(max_rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = write_table(large.filter("u != v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .union(low.select("u", F.col("m").alias("v")))
        new = write_table(small.filter("u != v").distinct(), "small")
        if not new.exceptAll(edges).isEmpty() or new.count() != edges.count():
            edges = new
            continue
        return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
