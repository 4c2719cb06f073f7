"""The co-occurrence graph: nodes, edges, bounded traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def items(memories: DataFrame) -> DataFrame:
    """(id, name, type, created_minute) from arrays ``topics`` and ``entities``; a name is
    taken once for a memory, as a topic if it is both."""
    topic = F.transform("topics", lambda t: F.struct(t.alias("name"), F.lit("topic").alias("type")))
    entity = F.transform(F.array_except("entities", "topics"), lambda t: F.struct(t.alias("name"), F.lit("entity").alias("type")))
    every = memories.withColumn("topics", F.array_distinct("topics")).withColumn("entities", F.array_distinct("entities"))
    return every.select("id", "created_minute", F.explode(F.concat(topic, entity)).alias("x")).select("id", "x.name", "x.type", "created_minute")


def nodes(items_: DataFrame) -> DataFrame:
    """Per name: count, type at first appearance, first and last time."""
    return items_.groupBy("name").agg(
        F.count("*").alias("n"),
        F.min_by("type", F.struct("created_minute", "id")).alias("type"),
        F.min("created_minute").alias("first_seen"),
        F.max("created_minute").alias("last_seen"),
    )


def edges(memories: DataFrame) -> DataFrame:
    """(a, b, weight), a < b: pairs inside the short item array of one memory, so nothing
    is joined and pairs are summed before the shuffle."""
    names = F.array_sort(F.array_distinct(F.concat("topics", "entities")))
    pair = memories.select(names.alias("names")).select("names", F.explode("names").alias("a"))
    pair = pair.select("a", F.explode(F.filter("names", lambda b: b > F.col("a"))).alias("b"))
    return pair.groupBy("a", "b").agg(F.count("*").alias("weight"))


def neighbours(edges_: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(name, depth): names reached from ``start`` (name) in at most ``depth`` steps, the
    start excluded, by one join for each step."""
    both = edges_.select("a", "b").unionByName(edges_.select(F.col("b").alias("a"), F.col("a").alias("b")))
    reached = start.select("name", F.lit(0).alias("depth"))
    frontier = start.select("name")
    for d in range(1, depth + 1):
        step = frontier.join(both, frontier["name"] == both["a"]).select(F.col("b").alias("name")).distinct()
        frontier = step.join(reached, "name", "left_anti")
        reached = reached.unionByName(frontier.select("name", F.lit(d).alias("depth")))
    return reached.where("depth > 0")


def found_neighbours(edges_: DataFrame, nodes_: DataFrame, start: str, depth: int) -> DataFrame:
    """(start, name, depth, n, place, found): what is reached from one name, most frequent
    first; one row that is not found where the graph does not hold the name."""
    spark = edges_.sparkSession
    one = spark.createDataFrame([(start,)], "name string")
    reached = neighbours(edges_, one, depth).join(nodes_.select("name", "n"), "name")
    place = F.row_number().over(Window.orderBy(F.desc("n"), "name")).cast("long")
    rows = reached.select(F.lit(start).alias("start"), "name", F.col("depth").cast("int").alias("depth"), "n", place.alias("place"), F.lit(True).alias("found"))
    absent = one.join(nodes_.select("name"), "name", "left_anti")
    blank = absent.select(F.col("name").alias("start"), *[F.lit(None).cast(t).alias(c) for c, t in (("name", "string"), ("depth", "int"), ("n", "bigint"), ("place", "bigint"))], F.lit(False).alias("found"))
    return rows.unionByName(blank)


def near_memories(memories: DataFrame, terms: list[str]) -> DataFrame:
    """Ids of memories that hold a direct neighbour of one of the terms."""
    pairs = edges(memories)
    both = pairs.select(F.col("a").alias("term"), F.col("b").alias("name")).unionByName(pairs.select(F.col("b").alias("term"), F.col("a").alias("name")))
    names = both.where(F.col("term").isin(terms)).select("name").distinct()
    return items(memories).join(names, "name", "left_semi").select("id").distinct()
