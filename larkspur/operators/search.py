"""Keyword, vector and hybrid search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import fixed, text


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(docs: DataFrame, text: str = "content") -> DataFrame:
    """(id, pos, term): the inverted index, one row for each token."""
    return docs.select("id", F.posexplode(tokens(F.col(text))).alias("pos", "term"))


def keyword(docs: DataFrame, terms: list[str], mode: str = "all", text: str = "content") -> DataFrame:
    """(id, score) by BM25.  ``mode``: 'any' term, 'all' terms, or the exact 'phrase'.

    Term counts are taken where the text is read, so one row per document is
    aggregated rather than one per token; statistics are one row, broadcast.
    """
    words = tokens(F.col(text))
    n = docs.select("id", words.alias("_w")).select("id", F.size("_w").alias("_len"), *[F.size(F.filter("_w", _equals(t))).alias(f"_tf{i}") for i, t in enumerate(terms)], _phrase(terms).alias("_phrase"))
    stats = n.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.sum((F.col(f"_tf{i}") > 0).cast("int")).alias(f"_df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        df, tf = F.coalesce(F.col(f"_df{i}"), F.lit(0)), F.col(f"_tf{i}")
        idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (fixed.BM25_K1 + 1) / (tf + fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * F.col("_len") / F.col("_avg")))
    present = [F.col(f"_tf{i}") > 0 for i in range(len(terms))]
    hit = present[0]
    for p in present[1:]:
        hit = hit | p if mode == "any" else hit & p
    if mode == "phrase":
        hit = F.col("_phrase")
    return n.where(hit).join(F.broadcast(stats)).select("id", score.alias("score"))


def _equals(term: str):
    return lambda w: w == F.lit(term)


def _phrase(terms: list[str]) -> Column:
    return F.contains(F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" ")), F.lit(" " + " ".join(terms) + " "))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero, missing or of another length."""
    size = norm(a) * norm(b)
    return F.when(F.coalesce(F.size(a) == F.size(b), F.lit(False)) & (size > 0), dot(a, b) / size).otherwise(0.0)


def vector_top_k(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """(id, score): the k vectors nearest to the one row of ``query`` (column ``vector``)."""
    one = F.broadcast(query.limit(1).select(F.col("vector").alias("_q")))
    return vectors.join(one).select("id", cosine(F.col("vector"), F.col("_q")).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def ranked(df: DataFrame, k: int) -> DataFrame:
    """(id, rank) of the best k of (id, score)."""
    top = df.orderBy(F.desc("score"), "id").limit(k)
    return top.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))


def normalised(df: DataFrame, score: str = "score") -> DataFrame:
    """Scores divided by the greatest, four decimals."""
    top = F.max(score).over(Window.partitionBy())
    return df.withColumn(score, F.round(F.when(top == 0, F.col(score)).otherwise(F.col(score) / top), 4))


def decay(age_days: Column, half_life: float = fixed.HALF_LIFE_DAYS) -> Column:
    return F.pow(F.lit(0.5), age_days / half_life) if half_life > 0 else F.lit(1.0)


@dataclass(frozen=True)
class Intent:
    """What a question implies: memory types, how many days back, and its words without the phrases
    that said so (the question itself if it implies nothing)."""

    types: list[str]
    days: int | None
    query: str

    @property
    def terms(self) -> list[str]:
        return self.query.lower().split()


def intent(spark: SparkSession, question: str) -> Intent:
    row = spark.range(1).select(F.lit(question).alias("q")).select(text.implied_types(F.col("q")).alias("types"), text.since_days(F.col("q")).alias("days"), text.clean_query(F.col("q")).alias("clean")).first()
    implied = bool(row.types) or row.days is not None
    return Intent(list(row.types), row.days, row.clean if implied else question)


def intended(memories: DataFrame, what: Intent) -> DataFrame:
    """The memories that an intent allows."""
    if what.types:
        memories = memories.where(F.col("content_type").isin(what.types))
    return memories if what.days is None else memories.where(F.col("age_days") <= what.days)


def hybrid(memories: DataFrame, semantic: DataFrame, words: DataFrame, graph: DataFrame, limit: int, half_life: float = fixed.HALF_LIFE_DAYS) -> DataFrame:
    """Reciprocal rank fusion of three legs, weighted by importance and age.

    ``semantic`` and ``words`` hold (id, score), of which the best 2 * limit count;
    ``graph`` holds ids that count as ranked first.  The legs are small, so the join
    with ``memories`` prunes by their ids.
    """
    legs = ranked(semantic, 2 * limit).unionByName(ranked(words, 2 * limit)).unionByName(graph.select("id", F.lit(1).alias("rank")))
    fused = legs.groupBy("id").agg(F.sum(1.0 / (F.lit(fixed.RRF_K) + F.col("rank"))).alias("rrf"))
    scored = fused.join(memories.select("id", "importance", "age_days"), "id", "left")
    weight = F.coalesce(F.col("importance") * decay(F.col("age_days"), half_life), F.lit(1.0))
    top = scored.select("id", (F.col("rrf") * weight).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
    return normalised(top)
