"""Connected components of a graph of integer ids, as Spark jobs.

Alternating large-star and small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond"): each round re-hangs every node on the
smallest node it sees, in map-side-combined aggregates and equi-joins, until
the edges stop changing.  No task sees the neighbours of a node as a list, and
each round is a written table, so a lost executor restarts from files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm._common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge, the component being its
    smallest node.  Loops and repeated edges are allowed."""
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc")
    seen = None
    while True:
        stamp = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if stamp == seen:
            return (now.select(F.col("u").alias("node"), F.col("v").alias("component"))
                    .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
        seen = stamp
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (down.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))))
        now = written(small.distinct(), "cc")
