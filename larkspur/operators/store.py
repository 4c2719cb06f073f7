"""The memory store: filters, paging, upserts and mutations, DataFrame to DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SessionFilter:
    """AND of its parts; an empty part filters nothing."""

    include_sources: list[str] = field(default_factory=list)
    exclude_sources: list[str] = field(default_factory=list)
    include_types: list[str] = field(default_factory=list)
    min_confidence: float = 0.0
    user_id: str = ""

    def overridden(self, **given) -> SessionFilter:
        """Fields given for one call replace those of the session."""
        return SessionFilter(**{k: given[k] if given.get(k) else getattr(self, k) for k in self.__dataclass_fields__})

    def apply(self, df: DataFrame) -> DataFrame:
        if self.include_sources:
            df = df.where(F.col("platform").isin(self.include_sources))
        if self.exclude_sources:
            df = df.where(~F.col("platform").isin(self.exclude_sources))
        if self.include_types:
            df = df.where(F.col("content_type").isin(self.include_types))
        if self.min_confidence > 0:
            df = df.where(F.col("confidence") >= self.min_confidence)
        if self.user_id:
            df = df.where(F.col("user_id") == self.user_id)
        return df


def active(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "active")


def newest(df: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    ordered = df.orderBy(F.desc("created_minute"), "id")
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def page_with_total(df: DataFrame, page: int, size: int) -> DataFrame:
    """A page, newest first, with the count of all rows."""
    total = df.agg(F.count("*").alias("total"))
    return newest(df, size, (page - 1) * size).join(F.broadcast(total))


def batch_get(requested: DataFrame, df: DataFrame) -> DataFrame:
    """A row for every requested id, null where there is none."""
    return requested.join(df, "id", "left")


def unprocessed(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose path and hash the ledger does not hold."""
    return files.join(ledger.select("path", "hash"), ["path", "hash"], "left_anti")


def upsert(base: DataFrame, changes: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The row of the highest version for each key."""
    both = base.unionByName(changes)
    names = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*names), F.col(version)).alias("_x")).select(key, *[F.col(f"_x.{c}").alias(c) for c in names])


def delete(base: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return base.join(ids.select(key), key, "left_anti")


def patched(df: DataFrame, hit: Column, **values: Column) -> DataFrame:
    """New values in the rows hit."""
    return df.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in values.items()})


def access_counts(df: DataFrame, log: DataFrame) -> DataFrame:
    """Counts and last access from an append-only log (id, at) added to each row."""
    seen = log.groupBy("id").agg(F.count("*").alias("_n"), F.max("at").alias("last_accessed"))
    return df.join(seen, "id", "left").withColumn("access_count", F.col("access_count") + F.coalesce("_n", F.lit(0))).drop("_n")


def coalesced(base: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """``base`` with one change for each key at most: fields that a change leaves null keep their
    value, keys that are new are added."""
    names = [c for c in base.columns if c != key]
    new = changes.select(F.col(key), *[(F.col(c) if c in changes.columns else F.lit(None).cast(base.schema[c].dataType)).alias(f"_{c}") for c in names])
    return base.join(new, key, "full").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in names])


def members_added(members: DataFrame, new: DataFrame) -> DataFrame:
    """Members (collection, id, position) with new ones (collection, id) behind the last of their
    collection in order of id; one that is present stays where it is."""
    absent = new.select("collection", "id").distinct().join(members.select("collection", "id"), ["collection", "id"], "left_anti")
    last = members.groupBy("collection").agg(F.max("position").alias("_last"))
    order = Window.partitionBy("collection").orderBy("id")
    placed = absent.join(last, "collection", "left").select("collection", "id", (F.coalesce("_last", F.lit(-1)) + F.row_number().over(order)).alias("position"))
    return members.select("collection", "id", "position").unionByName(placed)


def members_removed(members: DataFrame, gone: DataFrame) -> DataFrame:
    return members.join(gone.select("collection", "id"), ["collection", "id"], "left_anti")


def facet(df: DataFrame, column: str) -> DataFrame:
    """Counts and percentage of all rows, one decimal."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 1))


def topic_facet(df: DataFrame, topics: Column) -> DataFrame:
    return df.select(F.explode(topics).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


def imported(items: DataFrame, types: list[str], known: Column) -> DataFrame:
    """(id, content_type, platform) of items (id, text, kind, place): a type that is not in
    ``types`` becomes a fact, a place not ``known`` is unknown, an item without text an error."""
    good = F.coalesce(F.trim("text") != "", F.lit(False))
    kind = F.when(~good, "error").when(F.col("kind").isin(types), F.col("kind")).otherwise("fact")
    return items.select("id", kind.alias("content_type"), F.when(known, F.col("place")).otherwise("unknown").alias("platform"))
