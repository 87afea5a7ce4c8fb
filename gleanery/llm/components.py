"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleanery.operators.storage import settle


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the least node that it hangs together with.

    ``links`` is read in both directions, so it has to give the same rows each time: a written table.
    Each round takes the least root among a node and its neighbours, then the root of that
    root, so long chains halve. Rounds are written tables; only a count reaches the driver.
    """
    both = settle(links.select("a", "b").union(links.select("b", "a")).distinct())
    roots = settle(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
    while True:
        near = both.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("best"))
        lower = settle(roots.join(near, F.col("node") == F.col("a")).select("node", "root", F.least("root", "best").alias("lower")))
        over = lower.select(F.col("node").alias("at"), F.col("lower").alias("lowest"))
        moved = settle(lower.join(over, F.col("lower") == F.col("at")).select("node", "root", "lowest"))
        roots = moved.select("node", F.col("lowest").alias("root"))
        if moved.filter("root <> lowest").isEmpty():
            return roots
