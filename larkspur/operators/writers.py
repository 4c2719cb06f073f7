"""Results and context as files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.operators import tiers
from larkspur.operators.manifests import write_text
from larkspur.operators.scratch import written

# Kinds of memories that a context file lists, under their titles, and how many of each.
GROUPS = {"decision": "Decisions", "learning": "Learnings", "preference": "Preferences", "action_item": "Action Items", "fact": "Facts"}
MOST = 5


def write_results(records: DataFrame, path: str) -> None:
    """Records (question_id, question, gold, category, and each scorer's columns) as JSON lines,
    nulls written out, ``gold`` sorted; a file for each partition, whole or absent."""
    gold = {"gold": F.array_sort("gold")} if "gold" in records.columns else {}
    records.withColumns(gold).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def context_lines(memories: DataFrame, since_minute: int) -> DataFrame:
    """(place, line) of a context file over active memories (id, content, content_type, platform,
    created_minute, topics) from ``since_minute`` on: at most ``MOST`` newest of each kind, the ten
    most frequent topics, counts by platform."""
    recent = memories.where(F.col("created_minute") >= since_minute)
    lines = None
    for i, (kind, title) in enumerate(GROUPS.items()):
        newest = recent.where(F.col("content_type") == kind).orderBy(F.desc("created_minute"), "id").limit(MOST)
        rows = newest.select((F.lit((i + 1) * 10**12) - F.col("created_minute")).alias("place"), F.concat(F.lit(f"{title}: "), text.preview(F.col("content"), 200, 100), F.lit(" | "), "platform", F.lit(" | "), tiers.day(F.col("created_minute"))).alias("line"))
        lines = rows if lines is None else lines.unionByName(rows)
    topics = recent.select(F.explode("topics").alias("t")).groupBy("t").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "t").limit(10)
    topics = topics.select((F.lit(10**14) - F.col("n")).alias("place"), F.concat(F.lit("Topic: "), "t", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("line"))
    sources = recent.groupBy("platform").agg(F.count("*").alias("n")).select((F.lit(2 * 10**14) - F.col("n")).alias("place"), F.concat(F.lit("Source: "), "platform", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("line"))
    return lines.unionByName(topics).unionByName(sources)


def skill_markdown(name: Column, description: Column, version: Column, tags: Column, content: Column) -> Column:
    """A skill file: a header of what is set (the first version is not named), then the content."""
    lines = F.array(
        F.lit("---"),
        F.concat(F.lit("name: "), name),
        F.when(description != "", F.concat(F.lit("description: "), description)),
        F.when((version != "") & (version != "1.0.0"), F.concat(F.lit("version: "), version)),
        F.when(F.size(tags) > 0, F.concat(F.lit("tags: ["), F.array_join(tags, ", "), F.lit("]"))),
        F.lit("---"),
        F.lit(""),
        F.coalesce(content, F.lit("")),
    )
    return F.array_join(F.array_compact(lines), "\n")


def write_skills(skills: DataFrame, folders: dict[str, str]) -> DataFrame:
    """Write (name, text) to ``<folder>/<name>/SKILL.md`` for every tool's folder, in tasks, and
    return (name, tool, path) of what was written.  A name that is no plain word with hyphens is
    left out; writing again replaces the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, body in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for tool, folder in folders.items() if name and re.fullmatch(r"[a-z0-9]+(?:-[a-z0-9]+)*", name) else ():
                    files, at = pafs.FileSystem.from_uri(folder) if ":/" in folder else (pafs.LocalFileSystem(), folder)
                    files.create_dir(f"{at}/{name}", recursive=True)
                    with files.open_output_stream(f"{at}/{name}/SKILL.md") as f:
                        f.write((body or "").encode())
                    out.append((name, tool, f"{folder}/{name}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], names=["name", "tool", "path"])

    return written(skills.select("name", "text").mapInArrow(run, "name string, tool string, path string"), "skills-written")


def write_context(lines: DataFrame, path: str) -> bool:
    """The few ``lines`` of a context as one text file; False, and no file, if there are none."""
    found = [r.line for r in lines.orderBy("place", "line").collect()]
    if found:
        write_text(lines.sparkSession, path, "\n".join(found) + "\n", overwrite=True)
    return bool(found)
