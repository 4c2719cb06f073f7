"""The tables that queries read, derived from the given ones, as DataFrames and as SQL.

``MEMORIES`` and the other texts are common table expressions of the same views in
ANSI SQL, used by the comparison queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import fixed

NOW_MINUTES = 31 * 24 * 60  # 2024-02-01, in minutes after 2024-01-01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The central table over ``documents``; columns that a query leaves out are pruned."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        i.alias("id"),
        F.coalesce("text", F.lit("")).alias("content"),
        F.col("source").alias("platform"),
        _pick(fixed.CONTENT_TYPES, i % 9).alias("content_type"),
        F.floor(i / 10).alias("session_id"),
        F.concat(F.lit("user"), (i % 3).cast("string")).alias("user_id"),
        i.alias("created_minute"),
        (F.lit(0.5) + (i % 51) / F.lit(100.0)).alias("confidence"),
        F.when(i % 17 == 0, "archived").when(i % 19 == 0, "superseded").otherwise("active").alias("status"),
        ((i % 101) / F.lit(100.0)).alias("importance"),
        (i % 37).alias("access_count"),
        (i % 41 == 0).alias("is_pinned"),
        ((F.lit(NOW_MINUTES) - i) / F.lit(1440.0)).alias("age_days"),
    )


MEMORIES = f"""memories AS (SELECT doc_id AS id, coalesce(text, '') AS content, source AS platform,
 list_extract([{", ".join(f"'{t}'" for t in fixed.CONTENT_TYPES)}], CAST(doc_id % 9 + 1 AS BIGINT)) AS content_type,
 doc_id // 10 AS session_id, 'user' || CAST(doc_id % 3 AS VARCHAR) AS user_id, doc_id AS created_minute,
 CAST(0.5 AS DOUBLE) + CAST(doc_id % 51 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
 CASE WHEN doc_id % 17 = 0 THEN 'archived' WHEN doc_id % 19 = 0 THEN 'superseded' ELSE 'active' END AS status,
 CAST(doc_id % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS importance, doc_id % 37 AS access_count, doc_id % 41 = 0 AS is_pinned,
 CAST({NOW_MINUTES} - doc_id AS DOUBLE) / CAST(1440 AS DOUBLE) AS age_days FROM documents)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of memories, with the metadata that filters and joins need."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return e.select(
        "id",
        "vector",
        F.concat(F.lit("src"), (F.col("id") % 20).cast("string")).alias("platform"),
        (F.lit(0.5) + (F.col("id") % 51) / F.lit(100.0)).alias("confidence"),
        F.when(F.col("id") % 17 == 0, "archived").when(F.col("id") % 19 == 0, "superseded").otherwise("active").alias("status"),
    )


VECTORS = """vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, 'src' || CAST(vec_id % 20 AS VARCHAR) AS platform,
 CAST(0.5 AS DOUBLE) + CAST(vec_id % 51 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
 CASE WHEN vec_id % 17 = 0 THEN 'archived' WHEN vec_id % 19 = 0 THEN 'superseded' ELSE 'active' END AS status FROM embeddings)"""


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with validity windows, one for each order."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    start = F.to_date("o_orderdate")
    return o.select(
        k.alias("triple"),
        F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("subject"),
        F.col("o_orderpriority").alias("predicate"),
        F.concat(F.lit("Status "), F.col("o_orderstatus")).alias("object"),
        F.when(k % 11 == 0, None).otherwise(start).alias("valid_from"),
        F.when(k % 3 == 0, F.date_add(start, (k % 400).cast("int"))).alias("valid_to"),
        ((k % 11) / F.lit(10.0)).alias("confidence"),
        _pick(["accepted", "proposed", "rejected", "accepted", "edited"], k % 5).alias("status"),
        k.alias("created"),
    )


TRIPLES = """triples AS (SELECT o_orderkey AS triple, 'customer ' || CAST(o_custkey AS VARCHAR) AS subject, o_orderpriority AS predicate, 'Status ' || o_orderstatus AS object,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS valid_from,
 CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INTEGER) END AS valid_to,
 CAST(o_orderkey % 11 AS DOUBLE) / CAST(10 AS DOUBLE) AS confidence,
 list_extract(['accepted', 'proposed', 'rejected', 'accepted', 'edited'], CAST(o_orderkey % 5 + 1 AS BIGINT)) AS status, o_orderkey AS created FROM orders)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


TURNS = "turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections (nations) and the memories in them."""
    d = table(spark, sf_dir, "documents")
    return d.select((F.col("doc_id") % 23).cast("int").alias("collection"), F.col("doc_id").alias("id"), ((F.col("doc_id") * 7) % 50).alias("position")).where("id % 4 <> 0")


MEMBERS = "members AS (SELECT CAST(doc_id % 23 AS INTEGER) AS collection, doc_id AS id, (doc_id * 7) % 50 AS position FROM documents WHERE doc_id % 4 <> 0)"
