"""Connected components by alternating star contractions, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.plans.scratch import written


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 40)).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for the nodes of ``edges`` (two columns), root being the smallest node reachable.

    Every round links each node's neighbours to the smallest of them, first the larger ones, then
    the smaller ones, until nothing changes. Rounds are saved in the shared folder; only counts
    reach the driver. Rows with a null end and loops are left out.
    """
    a, b = edges.columns
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where((F.col(a).isNotNull()) & (F.col(b).isNotNull()))
    edges = written(edges.where("a > b").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        turned = large.join(small, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(turned.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
