"""Retrieval corpora whose records hold whole conversations: (sessions, queries) of each.

Fields are read by name from the JSON text of a record, so other fields, and records of another
shape, do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Capture profiles of an evaluation, and other names they go by.
PROFILES = ["raw", "enriched", "dual"]
PROFILE_ALIASES = {"verbatim": "raw", "llm": "enriched"}


def capture_profile(name: str) -> str:
    """The profile of a name or alias; another one is refused."""
    profile = PROFILE_ALIASES.get(name, name)
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {name!r}: one of {sorted(PROFILES)} is expected")
    return profile


def _field(json: Column | str, *names: str) -> Column:
    """The first of the fields that holds anything."""
    found = [F.get_json_object(json, f"$.{n}") for n in names]
    return F.coalesce(*[F.when(f != "", f) for f in found])


def _list(json: Column) -> Column:
    """The JSON texts of a list's elements; strings as they are.  No list: null."""
    return F.when(F.startswith(F.ltrim(json), F.lit("[")), F.from_json(json, "array<string>"))


def _records(spark: SparkSession, path: str, *envelopes: str) -> DataFrame:
    """(i, r): the records of a list, or of a field of an object that holds one."""
    whole = spark.read.text(path, wholetext=True)
    records = F.coalesce(_list(F.col("value")), *[_list(F.get_json_object("value", f"$.{e}")) for e in envelopes])
    return whole.select(F.posexplode(records).alias("i", "r")).where(F.startswith(F.ltrim("r"), F.lit("{")))


def _chunks(turns: Column) -> Column:
    """Texts of a list of turns, or of strings; others than the user's after their role in brackets."""

    def chunk(turn: Column) -> Column:
        dict_ = F.startswith(F.ltrim(turn), F.lit("{"))
        role = F.when(dict_, F.coalesce(F.get_json_object(turn, "$.role"), F.lit("user"))).otherwise("user")
        content = F.trim(F.when(dict_, F.coalesce(F.get_json_object(turn, "$.content"), F.lit(""))).otherwise(turn))
        return F.when(content != "", F.when(role == "user", content).otherwise(F.concat(F.lit("["), role, F.lit("] "), content)))

    return F.array_compact(F.transform(F.coalesce(turns, F.array().cast("array<string>")), chunk))


def _gold(evidence: Column) -> Column:
    """A list of ids from a list or a single value; empty ones are left out."""
    every = F.coalesce(_list(evidence), F.when(evidence.isNotNull(), F.array(evidence)), F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.filter(every, lambda e: e.isNotNull() & (e != ""))))


def samples_with_sessions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Samples of a conversation of several sessions, keyed ``session...`` or in a list, and their
    questions; ids of sessions and gold are prefixed with the sample's."""
    records = _records(spark, path, "samples", "data").withColumn("sample", F.coalesce(_field("r", "sample_id", "id"), F.col("i").cast("string")))
    conversation = F.get_json_object("r", "$.conversation")
    keyed = F.map_entries(F.from_json(conversation, "map<string, string>"))
    listed = F.transform(_list(conversation), lambda x, i: F.struct(F.concat(F.lit("session_"), (i + 1).cast("string")).alias("key"), x.alias("value")))
    entries = records.select("sample", F.explode(F.coalesce(listed, keyed)).alias("s")).where(F.startswith("s.key", F.lit("session")))
    sessions = entries.select(F.concat_ws("::", "sample", "s.key").alias("session_id"), _chunks(_list(F.col("s.value"))).alias("chunks")).where(F.size("chunks") > 0)
    asked = records.select("sample", F.posexplode(_list(_field("r", "qa", "qas"))).alias("n", "q"))
    text = F.trim(F.coalesce(F.get_json_object("q", "$.question"), F.lit("")))
    gold = F.transform(_gold(_field("q", "evidence", "evidence_sessions")), lambda e: F.concat(F.col("sample"), F.lit("::"), e))
    queries = asked.select(F.concat("sample", F.lit("::qa"), F.col("n").cast("string")).alias("id"), text.alias("text"), gold.alias("gold"), _field("q", "category", "type").alias("category"))
    return sessions, queries.where("text <> ''")


def questions_with_conversation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Questions that carry their conversation; the first record of a session with any turns gives it.
    Gold is the evidence, or else the session."""
    records = _records(spark, path, "data", "records").withColumn("text", F.trim(F.coalesce(F.get_json_object("r", "$.question"), F.lit("")))).where("text <> ''")
    records = records.withColumn("id", F.coalesce(_field("r", "id", "question_id"), F.concat(F.lit("cm-"), F.col("i").cast("string"))))
    records = records.withColumn("session_id", F.coalesce(_field("r", "session_id"), "id"))
    told = records.select("session_id", "i", _chunks(_list(F.get_json_object("r", "$.conversation"))).alias("chunks")).where(F.size("chunks") > 0)
    sessions = told.groupBy("session_id").agg(F.min_by("chunks", "i").alias("chunks"))
    gold = _gold(_field("r", "evidence"))
    queries = records.select("id", "text", F.when(F.size(gold) > 0, gold).otherwise(F.array("session_id")).alias("gold"), _field("r", "category").alias("category"))
    return sessions, queries
