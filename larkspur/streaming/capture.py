"""Incremental capture with Structured Streaming.

Hook events and log files land as JSON lines in a folder; a query takes each file
once (its checkpoint is the ledger), drops events that are invalid or of disabled
tools, forms exchanges, filters noise and appends what is new, decided from keyed state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.functions import text as T
from larkspur.operators import exchanges as ex
from larkspur.sources.readers import embed_hashed
from larkspur.streaming import recent
from larkspur.streaming.changelog import ChangeLog

# Kinds of hook events, and the schema version accepted.
EVENT_TYPES = ["checkpoint", "compact", "session", "delta"]
EVENT_VERSION = 1
EVENT_SCHEMA = "schema int, type string, tool string, session_id string, project_dir string, event_data struct<last_n_messages: array<struct<role: string, content: string>>, session_title: string>, sent_at string, _corrupt_record string"
#: The platform that a tool's captures belong to; others are of an unknown one.
PLATFORMS = {
    "claude_code": "claude_code",
    "codex": "codex_cli",
    "gemini_cli": "gemini_cli",
    "antigravity": "antigravity",
    "aider": "aider",
    "copilot_cli": "copilot_cli",
    "cursor": "cursor",
    "opencode": "custom",
    "chatgpt": "chatgpt",
    "claude_web": "claude_web",
}
#: How each tool is captured.
TOOL_KINDS = {"hook": ["hook"], "watcher": ["watch"], "mcp": ["mcp"], "import": ["import"]}


def hook_events(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """A stream of hook events; a bounded number of files a trigger gives back-pressure."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", per_trigger).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) events."""
    ok = F.coalesce((F.col("schema") == EVENT_VERSION) & F.col("type").isin(EVENT_TYPES) & F.col("session_id").isNotNull() & F.col("_corrupt_record").isNull(), F.lit(False))
    return events.where(ok).drop("_corrupt_record"), events.where(~ok)


def event_exchanges(events: DataFrame, disabled: list[str] = ()) -> DataFrame:
    """(tool, session_id, exchange, text) of valid events of enabled tools; session events
    carry no messages to keep."""
    kept = events.where(~F.col("tool").isin(list(disabled)) & (F.col("type") != "session"))
    once = kept.withColumn("event", F.xxhash64("event_data")).dropDuplicates(["tool", "session_id", "sent_at", "event"])
    turns = once.select("tool", "session_id", "sent_at", "event", F.posexplode("event_data.last_n_messages").alias("turn", "m"))
    conv = F.struct("tool", "session_id", "sent_at", "event").alias("conv_id")
    paired = ex.accepted(ex.exchanges(turns.select(conv, "turn", F.col("m.role").alias("role"), F.col("m.content").alias("text")), any_reply=True), 50)
    return paired.where(~T.is_noise(F.col("text"))).select("conv_id.tool", "conv_id.session_id", "conv_id.sent_at", "exchange", F.sha2("text", 256).alias("hash"), T.scrub(F.col("text")).alias("text"))


EXCHANGE = "tool string, session_id string, sent_at string, exchange long, hash string, text string, captured_at timestamp, batch long"


def platform(tool: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in PLATFORMS.items() for x in pair])[tool], F.lit("unknown"))


def capture(spark: SparkSession, landing: str, store: str, checkpoint: str, disabled: list[str] = (), log: ChangeLog | None = None, embed: Callable[[Column], Column] = embed_hashed, size: int = 64, threshold: float = recent.SKIP_THRESHOLD, keep_seconds: int = 7 * 86400) -> None:
    """Take all files that landed since the last call and append new exchanges to ``store``.

    The first query writes the exchanges of valid events, and invalid events, beside the store.
    The second decides from the recent vectors of each platform and session, its state, which
    exchanges are sent again, so neither reads the store.  With a ``log`` every batch says what it
    took and skipped."""

    def taken(events: DataFrame, number: int) -> None:
        events = events.persist()
        good, bad = split_valid(events)
        rows = event_exchanges(good, disabled).dropDuplicates(["tool", "session_id", "hash"])
        _replace(rows.withColumn("captured_at", F.current_timestamp()), number, f"{store}.exchanges")
        _replace(bad, number, f"{store}.quarantine", "json")
        if log is not None:
            seen = good.where(F.col("tool").isNotNull()).groupBy("tool", "type").agg(F.count("*").alias("n"))
            off = F.col("tool").isin(list(disabled))
            said = F.concat(F.when(off, "ignored ").otherwise("received "), F.col("n").cast("string"), F.lit(" "), "type", F.lit(" events"), F.when(off, " (watcher not enabled)").otherwise(""))
            _log(log, seen, F.when(off, "debug").otherwise("info"), said, f"taken-{number}")
        events.unpersist()

    def decided(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        kept = rows.where("reason <> 'near_duplicate'")
        _replace(kept.select("tool", F.col("session").alias("session_id"), "sent_at", F.col("exchange").cast("long").alias("exchange"), "hash", "text"), number, store)
        if log is not None:
            counts = rows.groupBy("tool", "session").agg(F.count("*").alias("n"), F.count_if(F.col("reason") == "near_duplicate").alias("skipped"))
            _log(log, counts.where("skipped > 0"), F.lit("info"), F.concat(F.lit("dedup skipped "), F.col("skipped").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" chunks in session "), "session"), f"skipped-{number}")
            totals = kept.groupBy("tool").agg(F.count("*").alias("n"))
            _log(log, totals, F.lit("info"), F.concat(F.lit("ingested "), F.col("n").cast("string"), F.lit(" memory/memories")), f"ingested-{number}")
        rows.unpersist()

    hook_events(spark, landing).writeStream.foreachBatch(taken).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if not _exists(spark, f"{store}.exchanges"):
        return
    found = spark.readStream.schema(EXCHANGE).parquet(f"{store}.exchanges")
    chunks = found.select(F.xxhash64("tool", "session_id", "hash").alias("id"), platform(F.col("tool")).alias("platform"), F.col("session_id").alias("session"), F.col("captured_at").alias("at"), embed(F.col("text")).alias("vector"), "tool", "sent_at", F.col("exchange").cast("string").alias("exchange"), "hash", "text")
    told = recent.decisions(chunks, size, threshold, keep_seconds, carry=("tool", "sent_at", "exchange", "hash", "text"))
    told.writeStream.foreachBatch(decided).option("checkpointLocation", f"{checkpoint.rstrip('/')}-decisions").trigger(availableNow=True).start().awaitTermination()


def _replace(rows: DataFrame, number: int, path: str, form: str = "parquet") -> None:
    """Write a batch; one that is run again replaces its own files."""
    rows.withColumn("batch", F.lit(number).cast("long")).write.format(form).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").save(path)


def _log(log: ChangeLog, rows: DataFrame, level: Column, message: Column, name: str) -> None:
    entries = rows.select(F.lit("daemon_status").alias("kind"), F.current_timestamp().alias("at"), "tool", level.alias("level"), message.alias("message"), F.lit("{}").alias("data"))
    if not rows.isEmpty():
        log.append(entries, name)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def new_turns(snapshots: DataFrame) -> DataFrame:
    """Turns not seen before, from a stream of rewritten session files
    (path, turns: array of role and content): the state of a path is its turn count, and
    a file that shrank yields nothing."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        turns = max((list(t) for pdf in pdfs for t in pdf["turns"]), key=len, default=[])
        out = [(key[0], i, t["role"], t["content"]) for i, t in enumerate(turns) if i >= seen]
        state.update((max(seen, len(turns)),))
        yield pd.DataFrame(out, columns=["path", "turn", "role", "content"])

    return snapshots.groupBy("path").applyInPandasWithState(step, "path string, turn long, role string, content string", "seen long", "append", GroupStateTimeout.NoTimeout)


def session_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """A stream of whole session files; those that are no JSON are left for a later version."""
    raw = spark.readStream.schema("value string").option("wholetext", True).format("text").load(path)
    turns = F.from_json(F.get_json_object("value", "$.messages"), "array<struct<role: string, content: string>>")
    key = F.coalesce(F.get_json_object("value", "$.session_id"), F.col("_metadata.file_path"))
    return raw.select(key.alias("path"), turns.alias("turns")).where("turns is not null")


def captured_counts(log: DataFrame) -> DataFrame:
    """Watcher state: events and last time for each tool, from an append-only log."""
    return log.groupBy("tool").agg(F.count("*").alias("captured_count"), F.max("sent_at").alias("last_captured_at"))


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Activity sessions of users over an event stream or table (ts, user_id)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", lateness)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
