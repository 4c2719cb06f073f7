"""Exchanges: a user turn and what answers it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import distinct_ignoring_case


def exchanges(turns: DataFrame, any_reply: bool = False) -> DataFrame:
    """(conv_id, exchange, text, n_turns, has_user, has_reply) in turn order.  Roles other
    than user and assistant are dropped, or with ``any_reply`` count as replies."""
    if not any_reply:
        turns = turns.where(F.col("role").isin("user", "assistant"))
    user = F.col("role") == "user"
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    numbered = turns.withColumn("exchange", F.sum(F.when(user, 1).otherwise(0)).over(order))
    line = F.concat(F.when(user, "Human: ").otherwise("Assistant: "), F.col("text"))
    grouped = numbered.groupBy("conv_id", "exchange").agg(
        F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"),
        F.count("*").alias("n_turns"),
        F.max(user).alias("has_user"),
        F.max(~user).alias("has_reply"),
    )
    return grouped.select("conv_id", "exchange", F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("text"), "n_turns", "has_user", "has_reply")


def accepted(df: DataFrame, least: int = 51, both: bool = False) -> DataFrame:
    """Exchanges of at least so many characters, and with both sides where asked."""
    df = df.where(F.length("text") >= least)
    return df.where("has_user and has_reply") if both else df


def summaries(chunks: DataFrame, topics: Column, least: int = 3, first: int = 5) -> DataFrame:
    """A row for each conversation of at least ``least`` chunks: previews of the first ones,
    and their topics merged."""
    grouped = chunks.groupBy("conv_id").agg(
        F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.struct("exchange", F.substring("text", 1, 200).alias("head")))).alias("heads"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(topics)))), 1, 15).alias("topics"),
    )
    kept = grouped.where(F.col("n") >= least)
    return kept.select("conv_id", "n", F.array_join(F.transform(F.slice("heads", 1, first), lambda x: x["head"]), "\n").alias("summary"), "topics", F.lit(0.85).alias("confidence"))


def log_summaries(chunks: DataFrame, topics: Column, least: int = 3, first: int = 5) -> DataFrame:
    """The summaries of line-wise session logs: the count, a line of topics, and of each of the
    ``first`` chunks its first line of over 30 characters, cut at 150."""
    line = F.get(F.filter(F.transform(F.split("text", "\n"), lambda s: F.trim(s)), lambda s: F.length(s) > 30), F.lit(0))
    grouped = chunks.groupBy("conv_id").agg(
        F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.struct("exchange", F.substring(line, 1, 150).alias("head")))).alias("heads"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(topics)))), 1, 15).alias("topics"),
    )
    points = F.transform(F.filter(F.slice("heads", 1, first), lambda x: x["head"].isNotNull()), lambda x: F.concat(F.lit("- "), x["head"]))
    parts = F.array(
        F.concat(F.lit("Conversation with "), F.col("n").cast("string"), F.lit(" exchanges.")),
        F.when(F.size("topics") > 0, F.concat(F.lit("Topics: "), F.array_join("topics", ", "))),
        F.when(F.size(points) > 0, F.concat(F.lit("Key points:\n"), F.array_join(points, "\n"))),
    )
    return grouped.where(F.col("n") >= least).select("conv_id", "n", F.array_join(F.array_compact(parts), "\n\n").alias("summary"), "topics", F.lit(0.85).alias("confidence"))


def skills(memories: DataFrame) -> DataFrame:
    """(session_id, name, description, content, tags) of sessions from memories (session_id, place,
    content, topics): topics once each ignoring case, in the order in which they come up."""
    grouped = memories.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("place", "content", "topics"))).alias("m"))
    topics = distinct_ignoring_case(F.flatten(F.transform("m", lambda x: x["topics"])))
    rows = grouped.select("session_id", F.size("m").alias("n"), topics.alias("t"), F.transform("m", lambda x: F.trim(x["content"])).alias("bodies"))
    three = F.slice("t", 1, 3)
    kebab = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.array_join(three, "-"))), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 60)
    about = F.concat(F.lit("Auto-extracted from "), F.col("n").cast("string"), F.lit(" memories"), F.when(F.size("t") > 0, F.concat(F.lit(" covering "), F.array_join(three, ", "))).otherwise(""))
    return rows.select("session_id", F.when(kebab == "", "extracted-skill").otherwise(kebab).alias("name"), F.substring(about, 1, 240).alias("description"), F.array_join(F.filter("bodies", lambda b: b != ""), "\n\n---\n\n").alias("content"), F.slice("t", 1, 10).alias("tags"))


def extractive_summaries(turns: DataFrame, keywords: list[str]) -> DataFrame:
    """(conv_id, summary): of the first 20 sentences of at least five words, the third, three
    to five of them, that score best by place and share of ``keywords``, in their order.
    One turn alone is cut to 200 characters; with under two sentences the first three turns
    stand in; with no text, the count of turns."""
    grouped = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    grouped = grouped.select("conv_id", "n", F.transform("t", lambda x: x["text"]).alias("texts"))
    stripped = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    words = lambda s: F.filter(F.split(s, r"\s+"), lambda w: w != "")
    parts = F.split(F.regexp_replace(F.array_join("texts", " "), r"([.!?])\s+", "$1\u0001"), "\u0001")
    sentences = F.filter(F.transform(parts, stripped), lambda s: F.size(words(s)) >= 5)
    rows = grouped.select("conv_id", "n", F.slice("texts", 1, 3).alias("texts"), F.slice(sentences, 1, 20).alias("first"))
    known = F.array(*[F.lit(k) for k in keywords])

    def scored(s: Column, i: Column) -> Column:
        own = words(F.lower(s))
        density = F.size(F.filter(own, lambda w: F.array_contains(known, w))) / F.greatest(F.size(own), F.lit(1))
        return F.struct((-F.round(1 / (1 + 0.1 * i) + 2 * density, 9)).alias("score"), (-i).alias("i"), s.alias("s"))

    best = F.slice(F.array_sort(F.transform("first", scored)), F.lit(1), F.least(F.lit(5), F.greatest(F.lit(3), F.floor(F.size("first") / 3).cast("int"))))
    in_order = F.array_sort(F.transform(best, lambda x: F.struct((-x["i"]).alias("i"), x["s"].alias("s"))))
    listed = lambda items: F.concat(F.lit("Key points: "), F.array_join(F.transform(items, lambda s: F.rtrim(s, F.lit("."))), ". "), F.lit("."))
    heads = F.filter(F.transform("texts", lambda t: stripped(F.substring(t, 1, 150))), lambda t: t != "")
    out = F.when(F.col("n") < 2, F.substring(F.col("texts")[0], 1, 200)).when(F.size("first") >= 2, listed(F.transform(in_order, lambda x: x["s"])))
    return rows.select("conv_id", out.when(F.size(heads) > 0, listed(heads)).otherwise(F.concat(F.lit("Conversation with "), F.col("n").cast("string"), F.lit(" exchanges."))).alias("summary"))
