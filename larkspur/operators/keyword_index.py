"""A keyword index that follows its table: immutable segments, tombstones, merging.

A commit tokenises the rows it is given and no others, writes them as one segment (postings
sorted by term, so a frequent term spreads over files and a rare one is in one) with the ids
whose earlier rows it replaces or deletes, and then publishes the list of segments: a manifest
file with the next number, which only one writer can create.  A search reads the files whose
range of terms holds one of its own, leaves out rows that a later segment has replaced, and
needs no other table: a posting carries the size of its row, and the manifest the number and
total size of the live rows.  When ``FANOUT`` neighbouring segments of a level have come
together they are merged to one of the next; readers keep the manifest they began with until
``vacuum``.

Rows are (id, content, topics, entities), with one row for each id in a commit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import fixed
from larkspur.operators import scratch
from larkspur.operators.manifests import Manifests, hadoop_path
from larkspur.operators.search import tokens

#: Neighbouring segments of one level that are merged.
FANOUT = 8
FIELDS = ("content", "topics", "entities")
#: The term of the rows that stand for whole memories; tokens are never empty.
WHOLE = ""


def row_hash() -> Column:
    return F.xxhash64("content", "topics", "entities")


def _tokenised(memories: DataFrame) -> DataFrame:
    """Postings (id, field, term, at, size, hash), and a row of the term ``WHOLE`` for each memory."""
    scratch.small_arrow(memories.sparkSession)
    id_type = memories.schema["id"].dataType.simpleString()
    rows = memories.select("id", row_hash().alias("hash"), tokens(F.coalesce("content", F.lit(""))).alias("content"), *[tokens(F.coalesce(F.array_join(c, " "), F.lit(""))).alias(c) for c in FIELDS[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, n = batch.column("id"), batch.column("hash"), batch.num_rows
            lengths = [pc.list_value_length(batch.column(f)).to_numpy(zero_copy_only=False) for f in FIELDS]
            sizes = np.sum(lengths, 0)

            def rows(at: np.ndarray, field: str, term: pa.Array, places: pa.Array, hashed: pa.Array, ids=ids, sizes=sizes) -> pa.RecordBatch:
                columns = {"id": ids.take(pa.array(at)), "field": pa.array([field] * len(at), pa.string()), "term": term, "at": places, "size": pa.array(sizes[at], pa.int64()), "hash": hashed}
                return pa.RecordBatch.from_pydict(columns)

            yield rows(np.arange(n), "", pa.array([WHOLE] * n, pa.string()), pa.array([[]] * n, pa.list_(pa.int32())), hashes)
            for field, length in zip(FIELDS, lengths, strict=True):
                words = batch.column(field).flatten().dictionary_encode()
                if not len(words):
                    continue
                codes, known = words.indices.to_numpy().astype(np.int64), words.dictionary.cast(pa.string())
                row = np.repeat(np.arange(n), length)
                place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
                order = np.argsort(row * len(known) + codes, kind="stable")
                row, codes = row[order], codes[order]
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (codes[1:] != codes[:-1])]))
                places = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(place[order], pa.int32()))
                yield rows(row[first], field, known.take(pa.array(codes[first])), places, pa.nulls(len(first), pa.int64()))

    return rows.mapInArrow(run, f"id {id_type}, field string, term string, at array<int>, size long, hash long")


class KeywordIndex:
    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint"):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Manifests(spark, self.path)
        self.schema = f"id {id_type}, field string, term string, at array<int>, size long, hash long"
        self.id_type = id_type

    def manifest(self) -> dict:
        """The newest published list of segments."""
        return self.manifests.newest() or {"version": 0, "segments": [], "n": 0, "size": 0}

    # Reading ---------------------------------------------------------------------------

    def _postings(self, segments: list[dict], terms: list[str]) -> DataFrame:
        """Rows of the terms, with the number of their segment; dead ones too."""
        out = self.spark.createDataFrame([], f"{self.schema}, seq bigint")
        for s in segments:
            files = [f"{s['path']}/postings/{name}" for name, least, most in s["files"] if any(least <= t <= most for t in terms)]
            if files:
                rows = self.spark.read.schema(self.schema).parquet(*files).where(F.col("term").isin(terms))
                out = out.unionByName(rows.withColumn("seq", F.lit(s["seq"]).cast("bigint")))
        return out

    def _live(self, rows: DataFrame, segments: list[dict]) -> DataFrame:
        """``rows`` (id, seq) that no later segment replaces."""
        gone = [self.spark.read.schema(f"id {self.id_type}").parquet(f"{s['path']}/deletes").withColumn("_gone", F.lit(s["seq"]).cast("bigint")) for s in segments if s["deletes"]]
        if not gone:
            return rows
        every = gone[0]
        for g in gone[1:]:
            every = every.unionByName(g)
        last = every.groupBy("id").agg(F.max("_gone").alias("_gone"))
        return rows.join(last, "id", "left").where(F.coalesce(F.col("_gone") <= F.col("seq"), F.lit(True))).drop("_gone")

    def rows(self) -> DataFrame:
        """(id, size, hash) of every live memory."""
        segments = self.manifest()["segments"]
        return self._live(self._postings(segments, [WHOLE]), segments).select("id", "size", "hash")

    def terms(self, field: str = "content") -> DataFrame:
        """(term, n, docs): occurrences and memories of every term of a field."""
        segments = self.manifest()["segments"]
        out = self.spark.createDataFrame([], f"{self.schema}, seq bigint")
        for s in segments:
            out = out.unionByName(self.spark.read.schema(self.schema).parquet(f"{s['path']}/postings").withColumn("seq", F.lit(s["seq"]).cast("bigint")))
        live = self._live(out.where(F.col("field") == field).select("id", "term", F.size("at").alias("_n"), "seq"), segments)
        return live.groupBy("term").agg(F.sum("_n").alias("n"), F.count("*").alias("docs"))

    def search(self, terms: list[str], mode: str = "all") -> DataFrame:
        """(id, score) by BM25: rows with 'any' term, 'all' of them, or the 'phrase', which stands
        in one field at following places and counts as one term."""
        manifest = self.manifest()
        found = self._live(self._postings(manifest["segments"], terms), manifest["segments"])
        if mode == "phrase":
            lists = [F.max(F.when(F.col("term") == t, F.col("at"))).alias(f"_at{i}") for i, t in enumerate(terms)]
            whole = found.groupBy("id", "field").agg(F.first("size").alias("size"), *lists).where(" and ".join(f"_at{i} is not null" for i in range(len(terms))))
            starts = F.col("_at0")
            for i in range(1, len(terms)):
                starts = F.array_intersect(starts, F.transform(f"_at{i}", _minus(i)))
            counts = whole.groupBy("id").agg(F.first("size").alias("size"), F.sum(F.size(starts)).alias("_tf0")).where("_tf0 > 0")
            names = ["_tf0"]
        else:
            names = [f"_tf{i}" for i in range(len(terms))]
            counts = found.groupBy("id").agg(F.first("size").alias("size"), *[F.sum(F.when(F.col("term") == t, F.size("at")).otherwise(0)).alias(c) for c, t in zip(names, terms, strict=True)])
        df = counts.agg(*[F.count_if(F.col(c) > 0).alias(f"_df{i}") for i, c in enumerate(names)])
        if mode == "all":
            counts = counts.where(" and ".join(f"{c} > 0" for c in names))
        n, average = F.lit(manifest["n"]), F.lit(manifest["size"] / max(1, manifest["n"]))
        score = F.lit(0.0)
        for i, c in enumerate(names):
            idf = F.log(1 + (n - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
            score = score + idf * F.col(c) * (fixed.BM25_K1 + 1) / (F.col(c) + fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * F.col("size") / average))
        return counts.join(F.broadcast(df)).select("id", score.alias("score"))

    # Writing ---------------------------------------------------------------------------

    def upsert(self, memories: DataFrame) -> None:
        """Add rows, or replace those of the same ids."""
        self.commit(memories, None)

    def delete(self, ids: DataFrame) -> None:
        self.commit(None, ids)

    def sync(self, memories: DataFrame) -> None:
        """Bring the index to exactly the rows of ``memories``: only what differs is tokenised."""
        known = self.rows().select("id", F.col("hash").alias("_known"))
        differs = memories.withColumn("_hash", row_hash()).join(known, "id", "left").where("_known is null or _known <> _hash").select("id", *FIELDS)
        self.commit(scratch.written(differs, "changed-rows"), known.select("id").join(memories.select("id"), "id", "left_anti"))

    def commit(self, memories: DataFrame | None, deleted: DataFrame | None) -> None:
        """One new segment with the rows of ``memories``, and without ids in ``deleted``."""
        manifest = self.manifest()
        seq = manifest["version"] + 1
        path = f"{self.path}/segment-{seq:012d}-{uuid.uuid4().hex[:8]}"
        if memories is not None:
            self._write_postings(_tokenised(memories), path)
            own = self.spark.read.schema(self.schema).parquet(f"{path}/postings").where(F.col("term") == WHOLE).select("id", "size")
        else:
            own = self.spark.createDataFrame([], f"id {self.id_type}, size long")
        ids = own.select("id") if deleted is None else own.select("id").unionByName(deleted.select("id"))
        before = self._live(self._postings(manifest["segments"], [WHOLE]), manifest["segments"]).select("id", "size")
        before.join(ids.distinct(), "id", "left_semi").write.parquet(f"{path}/replaced")
        replaced = self.spark.read.schema(f"id {self.id_type}, size long").parquet(f"{path}/replaced")
        replaced.select("id").write.parquet(f"{path}/deletes")
        gone, added = (x.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first() for x in (replaced, own))
        scratch.discard(self.spark, f"{path}/replaced")
        if not gone.n and not added.n:
            scratch.discard(self.spark, path)
            return
        entry = {"seq": seq, "level": 0, "path": path, "files": self._files(path) if added.n else [], "deletes": bool(gone.n)}
        self.manifests.publish(seq, {"segments": [*manifest["segments"], entry], "n": manifest["n"] - gone.n + added.n, "size": manifest["size"] - gone.size + added.size})
        self._merge_full_levels()

    def _write_postings(self, rows: DataFrame, path: str) -> None:
        rows.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.option("compression", "zstd").parquet(f"{path}/postings")

    def _files(self, path: str) -> list[list[str]]:
        """Name, least and greatest term of every file."""
        rows = self.spark.read.schema(self.schema).parquet(f"{path}/postings").groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"))
        return [[r.name, r.least, r.most] for r in rows.agg(F.min("term").alias("least"), F.max("term").alias("most")).collect()]

    def _merge_full_levels(self) -> None:
        while True:
            segments = self.manifest()["segments"]
            full = next((lv for lv in {s["level"] for s in segments} if sum(s["level"] == lv for s in segments) >= FANOUT), None)
            if full is None:
                return
            at = [i for i, s in enumerate(segments) if s["level"] == full]
            self.merge(at[0], at[-1] + 1)

    def merge(self, first: int = 0, end: int | None = None) -> None:
        """Neighbouring segments as one, without what is dead among them."""
        manifest = self.manifest()
        segments = manifest["segments"]
        end = len(segments) if end is None else end
        chosen = segments[first:end]
        if not chosen or (len(chosen) == 1 and first > 0):
            return
        path = f"{self.path}/segment-{manifest['version'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        rows = self.spark.createDataFrame([], f"{self.schema}, seq bigint")
        for s in (s for s in chosen if s["files"]):
            rows = rows.unionByName(self.spark.read.schema(self.schema).parquet(f"{s['path']}/postings").withColumn("seq", F.lit(s["seq"]).cast("bigint")))
        self._write_postings(self._live(rows, chosen).drop("seq"), path)
        gone = [s for s in chosen if s["deletes"]] if first else []  # nothing older is left to delete
        ids = self.spark.createDataFrame([], f"id {self.id_type}")
        for s in gone:
            ids = ids.unionByName(self.spark.read.schema(f"id {self.id_type}").parquet(f"{s['path']}/deletes"))
        ids.distinct().write.parquet(f"{path}/deletes")
        entry = {"seq": chosen[-1]["seq"], "level": max(s["level"] for s in chosen) + 1, "path": path, "files": self._files(path), "deletes": bool(gone)}
        self.manifests.publish(manifest["version"] + 1, manifest | {"segments": [*segments[:first], entry, *segments[end:]]})

    def vacuum(self) -> None:
        """Delete what the newest manifest does not name; nothing may still read or write older ones."""
        named = {s["path"].rsplit("/", 1)[1] for s in self.manifest()["segments"]}
        fs, home = hadoop_path(self.spark, self.path)
        for status in fs.listStatus(home):
            if status.getPath().getName().startswith("segment-") and status.getPath().getName() not in named:
                fs.delete(status.getPath(), True)
        self.manifests.forget_older()


def _minus(i: int):
    return lambda p: p - F.lit(i)
