"""Briefing tiers as text: one line for a row, one block for a tier, blocks put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text


def two_decimals(score: Column) -> Column:
    cents = F.floor(F.round(score, 6) * 100 + 0.5).cast("long")
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def day(minute: Column) -> Column:
    return F.date_format(F.timestamp_seconds(F.lit(1704067200) + minute * 60), "yyyy-MM-dd")


def memory_line(content: Column, minute: Column, pinned: Column, score: Column | None = None) -> Column:
    """A bullet: the preview, the day, whether pinned, perhaps the score."""
    line = F.concat(F.lit("  - "), text.preview_collapsed(content), F.lit(" — "), day(minute), F.when(pinned, F.lit(", pinned")).otherwise(""))
    return line if score is None else F.concat(line, F.lit(" [score "), two_decimals(score), F.lit("]"))


def recall_line(content: Column, platform: Column, minute: Column, score: Column) -> Column:
    return F.concat(F.lit("  - "), text.preview_collapsed(content), F.lit(" — "), platform, F.lit(", "), day(minute), F.lit(" [score "), two_decimals(score), F.lit("]"))


def neighbour_line(name: Column, kind: Column, depth: Column, n: Column) -> Column:
    return F.concat(F.lit("  - "), name, F.lit(" ("), kind, F.lit(", hops="), depth.cast("string"), F.lit(", seen "), n.cast("string"), F.lit("x)"))


def block(lines: DataFrame, title: str, label: str, empty: str) -> DataFrame:
    """One row (text) of the lines (place, line), few by the tier's limit, under a title; a
    stand-in where there are none."""
    joined = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return joined.select(F.concat_ws("\n", F.lit(title), F.lit(label), F.when(F.col("body") == "", F.lit(f"  - {empty}")).otherwise(F.col("body"))).alias("text"))


def persona(name: str, role: str, people: DataFrame, projects: DataFrame, remember: list[str], avoid: list[str]) -> DataFrame:
    """One row (text): the persona with three people (place, name, relation), two projects
    (place, name, status), and three things each to remember and to avoid."""

    def listed(df: DataFrame, most: int, shown: Column, alias: str) -> DataFrame:
        return df.orderBy("place").limit(most).select("place", shown.alias("s")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "s"))), lambda x: x["s"]), ", ").alias(alias))

    with_people = listed(people, 3, F.concat(F.col("name"), F.when(F.col("relation") != "", F.concat(F.lit(" ("), "relation", F.lit(")"))).otherwise("")), "people")
    with_projects = listed(projects, 2, F.concat(F.col("name"), F.when(F.col("status") != "active", F.concat(F.lit(" ["), "status", F.lit("]"))).otherwise("")), "projects")
    both = with_people.join(F.broadcast(with_projects))
    line = lambda head, c: F.when(c != "", F.concat(F.lit(head), c))
    return both.select(F.concat_ws("\n", F.lit(f"# Persona — {name}"), line("Role: ", F.lit(role)), line("People: ", F.col("people")), line("Projects: ", F.col("projects")), line("Remember: ", F.lit("; ".join(remember[:3]))), line("Avoid: ", F.lit("; ".join(avoid[:3])))).alias("text"))


def assembled(blocks: list[DataFrame]) -> DataFrame:
    """One row (text): blocks of one row each, a blank line between, empty ones left out."""
    rows = None
    for i, b in enumerate(blocks):
        one = b.select(F.lit(i).alias("place"), F.rtrim("text").alias("t"))
        rows = one if rows is None else rows.unionByName(one)
    kept = rows.where("trim(t) <> ''")
    return kept.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "t"))), lambda x: x["t"]), "\n\n").alias("text"))
