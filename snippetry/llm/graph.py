"""Connected components of a table of links, by passing on the smallest number and jumping to its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from snippetry.session import stage


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b); root is the smallest node reachable. Every round is written, so rounds
    don't pile up and a lost executor costs the current one. Rounds grow with the logarithm of the longest chain."""
    both = stage(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    roots = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        heard = both.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("heard"))
        passed = roots.join(heard, F.col("node") == F.col("a")).select("node", F.least("root", "heard").alias("next"), "root")
        jump = passed.select(F.col("node").alias("via"), F.col("next").alias("far"))
        moved = passed.join(jump, F.col("next") == F.col("via"), "left")
        moved = moved.select("node", F.least("next", F.coalesce("far", "next")).alias("next"), "root")
        moved = stage(moved, "roots")
        if not moved.where("next <> root").head(1):
            return moved.select("node", "root")
        roots = moved.select("node", F.col("next").alias("root"))
