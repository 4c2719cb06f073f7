"""An append log of events with a position for each of its consumers.

An append writes its events beside the log and then takes the next number by renaming, which one
of several writers can do, so entries are whole and ordered.  A consumer reads from its own
position and moves it when it has done its work; entries not yet acknowledged are read again
after a restart.  ``ring`` keeps the newest entries of each tool.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from larkspur.operators.manifests import hadoop_path, read_text, rename_new, write_text

# The kinds of events, and how many log rows of a tool are kept.
EVENT_KINDS = [
    "memory_created", "memory_updated", "memory_deleted", "memory_pinned", "import_progress", "daemon_status", "skill_created", "skill_updated",
    "skill_deleted", "ingestion_started", "ingestion_progress", "ingestion_completed", "collection_created", "collection_updated", "collection_deleted",
]
RING = 500
EVENT = "kind string, at timestamp, tool string, level string, message string, data string"


class ChangeLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folders(self, kind: str, prefix: str) -> list[int]:
        fs, home = hadoop_path(self.spark, f"{self.path}/{kind}")
        if not fs.exists(home):
            return []
        return sorted(int(n.removeprefix(prefix)) for n in (s.getPath().getName() for s in fs.listStatus(home)) if n.startswith(prefix))

    def _compacted(self) -> int:
        """The number up to which a compaction stands for the entries."""
        return max(self._folders("compact", "upto="), default=0)

    def _numbers(self) -> list[int]:
        base = self._compacted()
        return [*([base] if base else []), *(n for n in self._folders("entries", "n=") if n > base)]

    def append(self, events: DataFrame, name: str | None = None) -> int:
        """Add rows of ``EVENT`` as one entry; returns its number.  An entry of the same ``name``
        (of a batch that runs again) is not added twice."""
        unknown = events.where(~F.col("kind").isin(EVENT_KINDS) | F.col("kind").isNull())
        if not unknown.isEmpty():
            raise ValueError(f"unknown kind of event: {unknown.first().kind}")
        if name is not None and (done := read_text(self.spark, f"{self.path}/names/{name}")):
            return int(done)
        draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
        events.select(*[x.split()[0] for x in EVENT.split(", ")]).write.parquet(draft)
        fs, home = hadoop_path(self.spark, f"{self.path}/entries")
        fs.mkdirs(home)
        number = max(self._numbers(), default=0) + 1
        while not rename_new(self.spark, draft, f"{self.path}/entries/n={number}"):
            number += 1
        if name is not None:
            write_text(self.spark, f"{self.path}/names/{name}", str(number))
        return number

    def read(self, after: int = 0, upto: int | None = None) -> DataFrame:
        """(n, events) of the entries in (after, upto]."""
        base = self._compacted()
        out = self.spark.createDataFrame([], f"{EVENT}, n long")
        if after < base:
            out = out.unionByName(self.spark.read.schema(f"{EVENT}, n long").parquet(f"{self.path}/compact/upto={base}"))
        paths = [f"{self.path}/entries/n={n}" for n in self._folders("entries", "n=") if n > max(after, base) and (upto is None or n <= upto)]
        if paths:
            out = out.unionByName(self.spark.read.schema(f"{EVENT}, n long").option("basePath", f"{self.path}/entries").parquet(*paths))
        return out.where((F.col("n") > after) & (F.lit(True) if upto is None else F.col("n") <= upto))

    def consumer(self, name: str, kinds: list[str] | None = None) -> Consumer:
        return Consumer(self, name, kinds)

    def captured(self, day: str) -> DataFrame:
        """(tool, captured): memories that log rows of a day say were ingested."""
        n = F.regexp_extract("message", r"^ingested (\d+)", 1).cast("long")
        rows = self.read().where((F.to_date("at") == F.lit(day).cast("date")) & F.col("message").startswith("ingested "))
        return rows.groupBy("tool").agg(F.sum(n).alias("captured"))

    def compact(self, most: int = RING) -> None:
        """Keep the newest ``most`` rows of each tool of the entries that every consumer has read.
        The result takes their place in one step; the entries are deleted after it."""
        fs, home = hadoop_path(self.spark, f"{self.path}/consumers")
        positions = [json.loads(read_text(self.spark, s.getPath().toString()))["at"] for s in fs.listStatus(home) if s.getPath().getName().endswith(".json")] if fs.exists(home) else []
        upto, base = min([*positions, *self._numbers()[-1:]], default=0), self._compacted()
        if upto <= base:
            return
        draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
        ring(self.read(0, upto), most).write.parquet(draft)
        hadoop_path(self.spark, f"{self.path}/compact")[0].mkdirs(hadoop_path(self.spark, f"{self.path}/compact")[1])
        rename_new(self.spark, draft, f"{self.path}/compact/upto={upto}")
        old = [f"entries/n={n}" for n in self._folders("entries", "n=") if n <= upto] + [f"compact/upto={n}" for n in self._folders("compact", "upto=") if n < upto]
        for name in old:
            fs, at = hadoop_path(self.spark, f"{self.path}/{name}")
            fs.delete(at, True)


def ring(log: DataFrame, most: int = RING, parts: int = 64) -> DataFrame:
    """The newest ``most`` rows of each tool: first within parts of a tool, then of all."""
    order = [F.desc("at"), F.desc("n"), F.xxhash64("kind", "message", "data")]
    dealt = log.withColumn("_part", F.pmod(F.xxhash64("n", "at", "kind", "message", "data"), F.lit(parts)))
    first = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("tool", "_part").orderBy(*order))).where(F.col("_r") <= most)
    return first.withColumn("_r", F.row_number().over(Window.partitionBy("tool").orderBy(*order))).where(F.col("_r") <= most).drop("_r", "_part")


@dataclass
class Consumer:
    log: ChangeLog
    name: str
    kinds: list[str] | None = None

    @property
    def _place(self) -> str:
        return f"{self.log.path}/consumers/{self.name}.json"

    def position(self) -> int:
        text = read_text(self.log.spark, self._place)
        return json.loads(text)["at"] if text else 0

    def poll(self) -> tuple[DataFrame, int]:
        """What came after the position, and the position to acknowledge when it is dealt with."""
        upto = max([self.position(), *self.log._numbers()])
        rows = self.log.read(self.position(), upto)
        return rows if self.kinds is None else rows.where(F.col("kind").isin(self.kinds)), upto

    def acknowledge(self, upto: int) -> None:
        if upto < self.position():
            raise ValueError("a position does not move back")
        write_text(self.log.spark, self._place, json.dumps({"at": upto}), overwrite=True)


class ProgressToLog(StreamingQueryListener):
    """Writes a log entry for every batch of a streaming query that had rows, and for its end."""

    def __init__(self, log: ChangeLog, tool: str):
        self.log, self.tool = log, tool

    def _write(self, level: str, message: str, data: dict, name: str | None = None) -> None:
        spark = self.log.spark
        row = spark.range(1).select(F.lit("daemon_status").alias("kind"), F.current_timestamp().alias("at"), F.lit(self.tool).alias("tool"), F.lit(level).alias("level"), F.lit(message).alias("message"), F.lit(json.dumps(data)).alias("data"))
        self.log.append(row, name)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            self._write("info", f"processed {p.numInputRows} rows", {"batch": p.batchId, "rows": p.numInputRows}, f"{p.id}-{p.batchId}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self._write("error", event.exception.splitlines()[0][:500], {"query": str(event.id)})
