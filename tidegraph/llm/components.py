"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node it reaches, for every node of the edges (columns u and v, long).

    Each round moves edges to ever smaller ends; the number of rounds grows with the logarithm of the longest
    path. Only narrow rows move, sums per node are made before they are exchanged, and each round is written, so
    a lost executor costs one round at most. Loops and repeated edges do no harm; no edges give no rows.
    """
    edges = written(edges.select("u", "v"), "links")
    loops = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        small = large.join(low, F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.union(low.select("c", "m")).distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = e.select(F.col("u").alias("c"), F.col("v").alias("root"))
    return loops.join(roots, F.col("node") == F.col("c"), "left").select("node", F.coalesce("root", "node").alias("root"))
