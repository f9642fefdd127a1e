"""Connected components of an undirected graph, by star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.plans.workspace import Workspace


def components(edges: DataFrame, work: Workspace, a: str = "a", b: str = "b") -> DataFrame:
    """``no`` and ``grupo`` (the least node of its component) of every node of ``edges``.

    Large stars and small stars alternate: each round links a node's neighbours to the least of them, which halves the
    depth or better, so the rounds grow with the logarithm of a chain's length.  Every round is two aggregations and two
    joins on the node, written to the shared folder; nothing is collected but a count and a checksum.  Loops and repeated
    edges are allowed; without edges the result is empty.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = work.save(now, "cc0")
    before, step = None, 0
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before, step = mark, step + 1
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = work.save(large.where("u <> v").distinct(), f"cc{step}a")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = work.save(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), f"cc{step}b")
    roots = now.select(F.col("v").alias("no")).distinct().withColumn("grupo", F.col("no"))
    return now.select(F.col("u").alias("no"), F.col("v").alias("grupo")).union(roots)
