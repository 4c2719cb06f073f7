"""Counts kept up to date from changes, with retractions, in place of recomputation.

A view is a function from rows to the keys they count under (none, one or several).  A change is
a row before and after, either null: what it was is taken away, what it is added.  A refresh sums
the changes by key, adds them to the newest version, drops keys that reach zero, writes the
next version and publishes it.  It reads the changes and the counts, never the rows themselves.
Counts of distinct values are numbers of keys, so they follow too.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.manifests import Manifests

COUNTS = "view string, key array<string>, n long"
#: From a column of rows to an array of keys, each an array of strings.
Keys = Callable[[Column], Column]


def key(*parts: Column) -> Column:
    return F.array(*[p.cast("string") for p in parts])


def where(condition: Column, keys: Column) -> Column:
    """The keys of rows that fulfil the condition."""
    return F.when(condition, keys).otherwise(F.array().cast("array<array<string>>"))


def changes(before: DataFrame | None, after: DataFrame | None, by: str = "id") -> DataFrame:
    """(before, after): rows of two states of a table, or of what a batch touched, matched by id."""
    if before is None:
        return after.select(F.lit(None).alias("before"), F.struct("*").alias("after"))
    if after is None:
        return before.select(F.struct("*").alias("before"), F.lit(None).alias("after"))
    a, b = before.select(F.col(by).alias("_a"), F.struct("*").alias("before")), after.select(F.col(by).alias("_b"), F.struct("*").alias("after"))
    return a.join(b, F.col("_a") == F.col("_b"), "full").select("before", "after")


class MaintainedViews:
    def __init__(self, spark: SparkSession, path: str, views: dict[str, Keys]):
        self.spark, self.path, self.views = spark, path.rstrip("/"), views
        self.manifests = Manifests(spark, self.path)

    def counts(self) -> DataFrame:
        newest = self.manifests.newest()
        return self.spark.read.schema(COUNTS).parquet(newest["counts"]) if newest else self.spark.createDataFrame([], COUNTS)

    def view(self, name: str) -> DataFrame:
        return self.counts().where(F.col("view") == name).select("key", "n")

    def refresh(self, changed: DataFrame, applied: str | None = None) -> int:
        """Take in rows (before, after); returns the version.  A batch named ``applied`` that the
        newest version already holds is not taken twice."""
        newest = self.manifests.newest() or {"version": 0, "applied": []}
        if applied is not None and applied in newest["applied"]:
            return newest["version"]
        deltas = []
        for side, sign in (("before", -1), ("after", 1)):
            if changed.schema[side].dataType.typeName() == "void":
                continue
            present = changed.where(F.col(side).isNotNull())
            every = F.array(*[F.struct(F.lit(n).alias("view"), keys(F.col(side)).alias("keys")) for n, keys in self.views.items()])
            rows = present.select(F.explode(every).alias("v")).select("v.view", F.explode("v.keys").alias("key"))
            deltas.append(rows.groupBy("view", "key").agg((F.count("*") * sign).alias("n")))
        path = f"{self.path}/counts-{uuid.uuid4().hex}"
        merged = reduce(DataFrame.unionByName, deltas, self.counts()).groupBy("view", "key").agg(F.sum("n").alias("n"))
        merged.where("n <> 0").write.parquet(path)
        kept = [*newest["applied"][-99:], applied] if applied is not None else newest["applied"]
        self.manifests.publish(newest["version"] + 1, {"counts": path, "applied": kept})
        return newest["version"] + 1


class Refresher:
    """Runs a refresh only when something changed and ``least_seconds`` have passed since the
    last; ``clock`` gives the seconds."""

    def __init__(self, refresh: Callable[[], object], clock: Callable[[], float], least_seconds: float = 60.0):
        self.run, self.clock, self.least = refresh, clock, least_seconds
        self.dirty, self.last = False, None

    def mark(self) -> None:
        self.dirty = True

    def tick(self) -> bool:
        """True if it refreshed.  A change during the refresh leaves it dirty."""
        now = self.clock()
        if not self.dirty or (self.last is not None and now - self.last < self.least):
            return False
        self.dirty, self.last = False, now
        self.run()
        return True
