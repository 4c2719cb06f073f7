"""The fact store: triples with validity windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_at(day: Column) -> Column:
    """Open or covering windows; both ends belong to a window."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day))


def about(triples: DataFrame, entity: str, day: str, status: str = "accepted", side: str = "both") -> DataFrame:
    """Facts of an entity that hold on a day, newest window first."""
    hit = {"subject": F.col("subject") == entity, "object": F.col("object") == entity}
    of = hit["subject"] | hit["object"] if side == "both" else hit[side]
    return triples.where(of & (F.col("status") == status) & valid_at(F.lit(day).cast("date")))


def as_of(points: DataFrame, triples: DataFrame) -> DataFrame:
    """Facts for many (subject, day) points: an equi-join on the subject, then the window."""
    return points.join(triples, "subject").where(valid_at(F.col("day")))


def timeline(triples: DataFrame, limit: int = 500) -> DataFrame:
    return triples.orderBy(F.coalesce("valid_from", F.lit("1970-01-01").cast("date")), "created", "triple").limit(limit)


def upserted(base: DataFrame, new: DataFrame) -> DataFrame:
    """By triple id: greater confidence, newest source, proposed becomes accepted when
    the new one is, and a new end replaces the old."""
    n = new.select("triple", *[F.col(c).alias(f"_{c}") for c in new.columns if c != "triple"], F.lit(True).alias("_new"))
    j = base.join(n, "triple", "full_outer")
    fresh = F.col("subject").isNull()
    status = F.when(fresh, F.col("_status")).when((F.col("status") == "proposed") & (F.col("_status") == "accepted"), "accepted").otherwise(F.col("status"))
    out = {c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in base.columns if c not in ("triple", "confidence", "valid_to", "status", "source")}
    return j.select(
        "triple",
        *[v.alias(k) for k, v in out.items()],
        F.greatest("confidence", "_confidence").alias("confidence"),
        F.coalesce("_valid_to", "valid_to").alias("valid_to"),
        status.alias("status"),
        *([F.coalesce("_source", "source").alias("source")] if "source" in base.columns else []),
    )


def invalidated(triples: DataFrame, hit: Column, day: str) -> DataFrame:
    """Open windows of the facts hit end on a day."""
    return triples.withColumn("valid_to", F.when(hit & F.col("valid_to").isNull(), F.lit(day).cast("date")).otherwise(F.col("valid_to")))


def decided(triples: DataFrame, accept: Column, reject: Column) -> DataFrame:
    """Accepted facts get confidence 1 at least; rejected ones keep theirs."""
    return triples.withColumn("confidence", F.when(accept, F.greatest(F.col("confidence"), F.lit(1.0))).otherwise(F.col("confidence"))).withColumn("status", F.when(accept, "accepted").when(reject, "rejected").otherwise(F.col("status")))


def entities_merged(base: DataFrame, new: DataFrame) -> DataFrame:
    """By id: aliases united in order, properties overlaid by new ones, type kept."""
    n = new.select("id", F.col("type").alias("_type"), F.col("aliases").alias("_aliases"), F.col("properties").alias("_properties"))
    j = base.join(n, "id", "full_outer")
    none, no_map = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    old, add = F.coalesce("properties", no_map), F.coalesce("_properties", no_map)
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(F.coalesce("_properties", no_map), k))
    return j.select("id", F.coalesce("type", "_type").alias("type"), F.array_union(F.coalesce("aliases", none), F.coalesce("_aliases", none)).alias("aliases"), F.map_concat(kept, add).alias("properties"))


def edited(triples: DataFrame, identity: Column, replaced: dict[str, Column], patch: Column, patched: dict[str, Column]) -> DataFrame:
    """Where ``identity`` holds the fact goes and one with the ``replaced`` values and status
    edited stands in; where ``patch`` holds the ``patched`` values are set."""
    kept = triples.where(~identity).withColumns({k: F.when(patch, v).otherwise(F.col(k)) for k, v in patched.items()})
    new = triples.where(identity).withColumns({**replaced, "status": F.lit("edited")})
    return kept.unionByName(new)
