"""Connected components over an edge table by alternating large and small stars.

A star is an aggregation over (node, neighbour) rows and a join with the least of each
node's own, in which nodes with very many neighbours are broadcast instead of shuffled.
Its result is written to the shared folder, which cuts the lineage and survives lost
executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import scratch
from larkspur.operators.skew import join_counted


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One star on at most ``total`` rows (u, v), u > v: link neighbours to the least of each
    node's own."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    joined = join_counted(both, least, ["u"], 2 * total if large else total)
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: long), where component
    is its least reachable node.  Nulls and self-loops are ignored."""
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    spark = edges.sparkSession
    before = scratch.scratch_path(spark, name)
    current = scratch.written_at(ordered, before)
    total = current.count()
    state = None
    while True:
        for large in (True, False):  # a star has no more edges than it is given
            path = scratch.scratch_path(spark, name)
            current = scratch.written_at(_star(current, large, total), path)
            scratch.discard(spark, before)
            before = path
        row = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == state:
            break
        state = (row.n, row.h)
    roots = current.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
