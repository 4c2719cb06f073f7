"""Importance resampling of documents towards a target collection by hashed n-grams.

Every task runs DuckDB over small Arrow batches: SQL unnests the words of a text, a window
joins them to n-grams, a registered function (zlib's CRC-32) hashes these to buckets, and the
bucket counts of every text are spilled to Parquet in the shared folder.  Spark merges the
counts of both collections, from which a bucket's gain is the logarithm of how much more
often the target holds it, reads the spilled counts again and scores the texts; the greatest
scores, with Gumbel noise seeded by the id, are a draw without replacement.

A batch holds about ``BATCH_BYTES`` of texts and DuckDB spills nothing to local disks, so a
task's memory is bounded by a batch or one longer text.  A text's counts are at most
``buckets`` pairs.  To the driver go the summed counts of ``buckets`` buckets, no more.

Rules: a null or empty text has no words, no features and weight 0; repeated rows are scored
and drawn each; a null id is hashed as an empty one and comes first among ties, and rows alike
in score and id follow their weight and number of features.  An empty table gives an empty
result, and against an empty target all gains follow from the documents alone.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm import common

BATCH_BYTES = 1 << 20
COUNTS = "doc_id long, n_words long, n_features long, buckets array<int>, counts array<int>"
SCORED = "doc_id long, n_words long, n_features long, weight long, score long"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc32(features: pa.ChunkedArray) -> pa.Array:
    """Unsigned CRC-32 of each value, read from the values' one buffer; there are no nulls."""
    values = pa.concat_arrays(features.cast(pa.large_binary()).chunks) if isinstance(features, pa.ChunkedArray) else features.cast(pa.large_binary())
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1].tolist()
    data = values.buffers()[2].to_pybytes() if values.buffers()[2] else b""
    return pa.array([*map(zlib.crc32, [data[a:b] for a, b in pairwise(ends)])], pa.int64())


@cache
def _engine():
    """This worker's DuckDB: one thread, no files."""
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "preserve_insertion_order": False})
    con.create_function("zlib_crc32", _crc32, ["VARCHAR"], "BIGINT", type="arrow")
    return con


def bucket_sql(width: int, buckets: int) -> str:
    """Bucket counts of the texts of ``batch`` (row, text): (row, n_words, n_features, buckets, counts)."""
    leads = ", ".join(f"lead(word, {k}) OVER (PARTITION BY row ORDER BY pos) AS w{k}" for k in range(1, width))
    runs = [f"SELECT row, {' || '.join(['word', *(f"' ' || w{j}" for j in range(1, k))])} AS feature FROM grams" + (f" WHERE w{k - 1} IS NOT NULL" if k > 1 else "") for k in range(1, width + 1)]
    return rf"""
WITH lists AS (SELECT row, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM batch),
words AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM lists),
grams AS (SELECT row, word{', ' + leads if leads else ''} FROM words),
features AS ({' UNION ALL '.join(runs)}),
counted AS (SELECT row, CAST(zlib_crc32(feature) % {buckets} AS INTEGER) AS bucket, CAST(count(*) AS INTEGER) AS n FROM features GROUP BY ALL),
packed AS (SELECT row, CAST(sum(n) AS BIGINT) AS n_features, list(bucket ORDER BY bucket) AS buckets, list(n ORDER BY bucket) AS counts FROM counted GROUP BY row)
SELECT row, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(buckets, []) AS buckets, coalesce(counts, []) AS counts FROM lists LEFT JOIN packed USING (row) ORDER BY row"""


def bucket_counts(texts: DataFrame, width: int, buckets: int, name: str) -> DataFrame:
    """The spilled counts of every row of ``texts`` (doc_id, text), as ``COUNTS``."""
    sql = bucket_sql(width, buckets)
    types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = ["n_words", "n_features", "buckets", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _engine()
        for batch in common.small_batches(batches, "text", BATCH_BYTES):
            con.register("batch", pa.table({"row": pa.array(range(batch.num_rows), pa.int32()), "text": batch.column("text").cast(pa.string())}))
            found = con.sql(sql).to_arrow_table()
            con.unregister("batch")
            made = [pa.concat_arrays(found.column(n).cast(t).chunks or [pa.array([], t)]) for n, t in zip(names, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", *names])

    return common.written(common.keyed_texts(texts).mapInArrow(run, COUNTS), name)


def totals(counted: DataFrame, buckets: int) -> np.ndarray:
    """The counts of all buckets, summed in tasks and merged: ``buckets`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            of, n = (batch.column(c).flatten().to_numpy() for c in ("buckets", "counts"))
            held += np.bincount(of, n, buckets).astype(np.int64)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(held[at], pa.int64())})

    merged = counted.select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in merged.collect():  # at most ``buckets`` rows
        out[r.bucket] = r.n
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the target's share of each bucket to the documents', smoothed by one."""
    size, s, t = len(documents), int(documents.sum()), int(target.sum())
    pairs = zip(documents.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + size) / ((a + 1) * (t + size)))) for a, b in pairs], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of standard Gumbel noise that the id and seed decide."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(counted: DataFrame, of_bucket: np.ndarray, seed: int) -> DataFrame:
    """``SCORED`` of every row of ``COUNTS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch.column("buckets")), 0).to_numpy(zero_copy_only=False))])
            worth = of_bucket[batch.column("buckets").flatten().to_numpy()] * batch.column("counts").flatten().to_numpy()
            summed = np.concatenate([[0], np.cumsum(worth)])[ends]
            weight = np.diff(summed) // np.maximum(batch.column("n_features").to_numpy(), 1)
            score = weight + np.array([noise(d, seed) for d in batch.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(weight, pa.int64()), pa.array(score, pa.int64())], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return counted.mapInArrow(run, SCORED)


def drawn(scored: DataFrame, percent: int, least_words: int, name: str = "drawn") -> DataFrame:
    """``scored`` (a written table) with ``rank``: 1 for the greatest score, then on, in the drawn
    share of the rows of at least ``least_words`` words; null in all others."""
    could = F.col("n_words") >= least_words
    n = scored.where(could).count() * percent // 100
    keys = [F.desc("score"), F.col("doc_id").asc_nulls_first(), F.desc("weight"), F.desc("n_features")]
    # The last key parts rows that are alike in all others, however many they are.
    numbered = scored.where(could).withColumn("_row", F.monotonically_increasing_id())
    placed = numbered.repartitionByRange(*keys, "_row").sortWithinPartitions(*keys, "_row").drop("_row").withColumn("_m", F.monotonically_increasing_id())
    placed = common.written(placed.withColumn("_part", F.shiftright("_m", 33)).withColumn("_at", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m"), name)
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each partition
    before = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.col("_at") + 1
    ranked = placed.join(F.broadcast(before), "_part").withColumn("rank", F.when(place <= n, place)).drop("_part", "_at", "_before")
    return ranked.unionByName(scored.where(~could).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10000, width: int = 2, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``, drawn
    towards the texts of ``target`` (its column ``text`` alone is read)."""
    counted = bucket_counts(docs, width, buckets, "feature-counts")
    wanted = bucket_counts(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), width, buckets, "target-counts")
    of_bucket = gains(totals(counted, buckets), totals(wanted, buckets))
    return drawn(common.written(scores(counted, of_bucket, seed), "scored"), percent, least_words)
