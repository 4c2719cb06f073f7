"""Places in long lists without bringing a list to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.scratch import written

_LOW = (1 << 33) - 1


def numbered(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """``rows`` with their place from 1 in the order given: a row's place in its range of the order
    plus the sizes of the ranges before, which is one row for each range.  Equal rows are placed
    one after the other."""
    order = tuple(F.col(c) if isinstance(c, str) else c for c in order)
    spread = rows.withColumn("_n", F.monotonically_increasing_id())
    placed = spread.repartitionByRange(*order, "_n").sortWithinPartitions(*order, "_n").drop("_n").withColumn("_m", F.monotonically_increasing_id())
    placed = written(placed.withColumn("_part", F.shiftright("_m", 33)).withColumn("_at", F.col("_m").bitwiseAND(F.lit(_LOW))).drop("_m"), "numbered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")
