"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Within each source, rows are ordered by a seeded hash; row k of n gets the
fraction (k + 1/2) / n.  All rows sorted by fraction mix the sources in
proportion at every point, so cutting that order evenly gives shards that hold
each source to within a row or so of its share, and counts at most one apart.

Ranks come from range partitions: a row's rank is its place in its partition plus
the sizes of the partitions before, so a source with a third of all rows spreads
over many tasks.

Rules: null text counts no bytes; null source is a source of its own; null or
repeated ``doc_id`` rows are placed each, in order of their text's checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm import common

PART_BITS = 33  # monotonically_increasing_id: partition above, row below


def _placed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` in range order of ``keys``, with its partition ``_part`` and place ``_at`` therein."""
    numbered = df.withColumn("_n", common.row_number())
    ordered = numbered.repartitionByRange(*keys, "_n").sortWithinPartitions(*keys, "_n").drop("_n").withColumn("_m", F.monotonically_increasing_id())
    ordered = ordered.withColumn("_part", F.shiftright("_m", PART_BITS)).withColumn("_at", F.col("_m").bitwiseAND(F.lit((1 << PART_BITS) - 1))).drop("_m")
    return common.written(ordered, name)


def _by_source(docs: DataFrame, seed: int, keep: list[str] = ()) -> DataFrame:
    """What is needed of every row, placed by source and seeded hash, with the columns in
    ``keep`` as ``_kept_<name>``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.col("source").alias("source"),
        *[F.col(c).alias(f"_kept_{c}") for c in keep],
    ).withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32"))
    return _placed(rows, ["source", "_h", "doc_id", "text_crc32"], "by-source")


def _interleaved(placed: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, source, row, position): ``row`` (partition and place) is
    the row's own in ``placed``, ``position`` numbers all rows from 0."""
    # Per partition and source: a row for each source, and one more for each partition at most.
    held = placed.groupBy("source", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    of_source = Window.partitionBy("source")
    held = held.select(
        F.col("source").alias("_s"),
        F.col("_part").alias("_p"),
        (F.sum("_n").over(of_source.orderBy("_part")) - F.col("_n") - F.col("_from")).alias("_base"),
        F.sum("_n").over(of_source).alias("_all"),
    )
    rows = placed.join(held, (F.col("source").eqNullSafe(F.col("_s"))) & (F.col("_part") == F.col("_p")))
    rows = rows.withColumn("_f", (F.col("_base") + F.col("_at") + 0.5) / F.col("_all")).withColumn("row", _row())
    rows = _placed(rows.select("doc_id", "size", "text_crc32", "source", "row", "_h", "_f"), ["_f", "source", "_h", "doc_id", "text_crc32"], "interleaved")
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    parts = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.join(parts, "_part").select("doc_id", "size", "text_crc32", "source", "row", (F.col("_before") + F.col("_at")).alias("position"))


def _row():
    return F.shiftleft("_part", PART_BITS) + F.col("_at")


def interleave(docs: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, size, text_crc32, source, position): ``position`` numbers all rows from 0."""
    return _interleaved(_by_source(docs, seed)).drop("row")


def _assigned(rows: DataFrame, shards: int, total: int) -> DataFrame:
    """``rows``, ``total`` of them, with their shard and slot in place of their position."""
    shard = F.expr(f"position * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return rows.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("position") - first).drop("position")


def assign(docs: DataFrame, shards: int, seed: int = 17) -> DataFrame:
    """(doc_id, size, text_crc32, source, shard, slot); shard counts differ by one at most."""
    return _assigned(interleave(docs, seed), shards, docs.count())


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 17) -> None:
    """Write every row of ``docs`` to ``path``, one folder per shard, rows in slot order
    within files; repeated rows are written each to its own slot, kept as ``slot``."""
    placed = _by_source(docs, seed, docs.columns)
    named = _assigned(_interleaved(placed), shards, placed.count()).select("row", "shard", "slot")
    rows = placed.select(_row().alias("row"), *[F.col(f"_kept_{c}").alias(f"_kept_{c}") for c in docs.columns]).join(named, "row")
    rows = rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.select("shard", "slot", *[F.col(f"_kept_{c}").alias(c) for c in docs.columns if c not in ("shard", "slot")]).write.partitionBy("shard").parquet(path)
