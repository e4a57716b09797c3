"""Connected components of a graph that lives in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, written


def components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node reaches: rows (node, label), for the nodes of edges (u, v) of longs only.

    Alternates large-star (link the larger neighbours of a node to its smallest) and small-star (link the smaller ones
    to their smallest) until nothing changes; then each node hangs on its component's smallest. Every step is an
    aggregate with map-side minima and a join on the node; edges stay in written tables, none come to the driver.
    An edge from a node to itself, repeated edges and nulls are left out.
    """
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, seen = written(now, "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark[0] == 0 or mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v").distinct())
        seen = mark
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        before, now = now, written(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct(), "edges")
        discard(before)
