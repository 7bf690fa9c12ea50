"""Connected components of an edge table, by alternating stars, each round kept in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of an edge the smallest node that it reaches; no edges, no rows.

    Edges with a null end, loops and repeated edges count for nothing more.

    Each round links every node's larger neighbours, then its smaller ones, to the
    smallest neighbour, which shortens paths geometrically and keeps the table no
    longer than the input.  Groups are reduced by a partial minimum before any
    shuffle, so that a hub with a third of all edges costs no task more than the
    rows dealt to it.
    """
    with Scratch(edges.sparkSession) as scratch:
        e = scratch.keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` is not null and `{b}` is not null and u <> v").distinct())
        before = None
        while True:
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u")
            small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
            done, e = e, scratch.keep(small)
            scratch.drop(done)
            now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
            if now == before:
                break
            before = now
        # every edge now leads to its component's smallest node
        return scratch.result(e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
