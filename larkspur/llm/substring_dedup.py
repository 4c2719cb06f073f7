"""Removal of long repeated byte strings, by suffix arrays over content shards.

Every string of ``length`` bytes that starts at two places is found, across all
documents:

1. A rolling hash of ``GRAM`` bytes is taken at every byte.  A window of ``length``
   bytes belongs to the least hash in it; equal windows have equal least hashes, so
   all copies of a window meet in one group.  Neighbouring windows with the same
   least hash form one stretch, stored as a hash of its bytes and its place.
2. Stretches whose least hash occurs once in the collection (and once in the
   stretch) hold no repeat and end here: the bulk of the text never moves.
3. Stretches with equal bytes repeat as a whole.  One of each distinct content goes
   on to its group's shard, where an array induced over the shard's contents and
   its permuted common prefixes mark the windows that occur twice.
4. A group of over ``LARGE`` bytes is not given to one task: its contents go through
   the same steps again as texts of their own, with hashes of twice as many bytes, and
   so divide.  At hashes of ``length`` bytes a stretch is one window, or a run of one
   byte of at most ``MOST_WINDOWS`` windows, so that no group is large any more.

Rules: null text counts as empty; texts under ``length`` bytes hold no window; rows that
repeat a ``doc_id`` are separate documents, and so are those without one.  The input is
read three times; a row is known again by a hash of its ``doc_id`` and text, as files may
be divided otherwise when executors come or go, and rows alike in both have one result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common, passages
from larkspur.llm.rolling import BYTE_VALUES, mixed, rolled, runs, stretches_of
from larkspur.llm.suffix_array import permuted_lcp, suffix_array
from larkspur.operators.skew import join_counted

LENGTH, GRAM = 400, 64
SHARD, LARGE = 1 << 21, 1 << 23


def stretches(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """All stretches of some texts: text number, start, windows, anchor, content, repeats."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    return stretches_of(data, mixed(rolled(BYTE_VALUES[data], gram)), np.array([len(t) for t in texts], np.int64), length, gram)


def repeated_windows(contents: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each content, the starts of windows that occur twice among all contents."""
    joined = np.frombuffer(b"\xff".join(contents) + b"\xff", np.uint8) + np.uint8(1)  # UTF-8 has no 0xff; the separator becomes 0
    sizes = np.array([len(c) + 1 for c in contents], np.int64)
    ends = np.cumsum(sizes)
    order = suffix_array(joined, 256)
    value, before = permuted_lcp(joined, order)
    room = np.repeat(ends - 1, sizes) - np.arange(len(joined))
    long = np.flatnonzero((value >= length) & (room >= length))
    long = long[room[before[long]] >= length]
    mark = np.zeros(len(joined), bool)
    mark[long] = True
    mark[before[long]] = True
    return [np.flatnonzero(mark[e - n : e]) for e, n in zip(ends, sizes, strict=True)]


SPANS = pa.schema([("row", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])


def _shard_spans(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; whole groups are gathered up to about ``SHARD`` bytes."""
    held: list[tuple[bytes, int, bytes]] = []
    size, anchor = 0, None

    def out() -> pa.RecordBatch:
        found = repeated_windows([c for _, _, c in held], length)
        spans = [(row, start + a, start + b) for (row, start, _), w in zip(held, found, strict=True) for a, b in runs(w, length)]
        return pa.RecordBatch.from_pydict(dict(zip(SPANS.names, zip(*spans, strict=True), strict=True)) if spans else {n: [] for n in SPANS.names}, schema=SPANS)

    for batch in batches:
        for key, row, start, content in zip(*(batch.column(c).to_pylist() for c in ("anchor", "row", "start", "content")), strict=True):
            if key != anchor and size >= SHARD:
                yield out()
                held, size = [], 0
            anchor = key
            held.append((row, start, content))
            size += len(content)
    if held:
        yield out()


def keyed_rows(docs: DataFrame) -> DataFrame:
    return docs.select(common.row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("text"))


def _spans(rows: DataFrame, length: int, gram: int, large: int, also: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, spans) of ``rows`` (row, text): the texts that may hold repeats, and the
    rows named in ``also`` with its columns; the repeated byte spans (row, a, b), perhaps overlapping."""
    names = ("start", "windows", "anchor", "content", "repeats")
    schema = pa.schema([("row", pa.binary()), ("start", pa.int64()), ("windows", pa.int32()), ("anchor", pa.int64()), ("content", pa.int64()), ("repeats", pa.bool_())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "text", 1 << 20):
            found = stretches(batch.column("text").to_pylist(), length, gram)
            row = batch.column("row").take(pa.array(found["text"]))
            yield pa.RecordBatch.from_pydict({"row": row} | {n: found[n] for n in names}, schema=schema)

    long_texts = rows.select("row", "text").where(F.octet_length("text") >= length)
    places = common.written(long_texts.mapInArrow(cut, "row binary, start long, windows int, anchor long, content long, repeats boolean"), "stretches")
    anchors = places.groupBy("anchor").agg(F.count("*").alias("n"), F.max("repeats").alias("r")).where("n > 1 or r").select("anchor", "n")
    maybe = common.written(join_counted(places, anchors, ["anchor"], places.count()), "repeated-stretches")
    total = maybe.count()

    # Equal contents: each of their bytes occurs elsewhere.
    bytes_ = F.col("windows") + F.lit(length - 1)
    distinct = maybe.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("row", "start", "windows", "repeats")).alias("x"))
    copied = distinct.where("n > 1").select("anchor", "content", "n")
    equal = join_counted(maybe, copied, ["anchor", "content"], total).select("row", F.col("start").alias("a"), (F.col("start") + bytes_).alias("b"))

    # One of each distinct content, where its group has another or it may repeat itself.
    groups = distinct.groupBy("anchor").agg(F.count("*").alias("d"), F.sum(F.col("x.windows") + length - 1).alias("size"), F.max("x.repeats").alias("r")).where("d > 1 or r")
    hot = (F.col("size") > large) & F.lit(gram < length)
    wanted = join_counted(distinct, groups, ["anchor"], total, "d").select("anchor", "x.row", "x.start", "x.windows", hot.alias("hot"))
    per_row = maybe.select("row").distinct().join(wanted.groupBy("row").agg(F.collect_list(F.struct("anchor", "start", "windows", "hot")).alias("wanted")), "row", "left")
    per_row = per_row.join(also, "row", "full") if also is not None else per_row
    candidates = common.written(rows.select("row", "text").join(per_row, "row").dropDuplicates(["row"]), "candidates")

    content_schema = pa.schema([("anchor", pa.int64()), ("row", pa.binary()), ("start", pa.int64()), ("hot", pa.bool_()), ("content", pa.binary())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "text", 1 << 20):
            out: dict[str, list] = {n: [] for n in content_schema.names}
            for row, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "wanted")), strict=True):
                for x in wanted:
                    for name, value in zip(out, (x["anchor"], row, x["start"], x["hot"], text[x["start"] : x["start"] + x["windows"] + length - 1]), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=content_schema)

    contents = candidates.where("wanted is not null").mapInArrow(fetch, "anchor long, row binary, start long, hot boolean, content binary")
    sharded = contents.where("not hot").select("anchor", "row", "start", "content").repartition("anchor").sortWithinPartitions("anchor")
    shared = sharded.mapInArrow(lambda batches: _shard_spans(batches, length), "row binary, a long, b long")

    found = equal.unionByName(shared)
    if gram < length and not candidates.where(F.exists("wanted", lambda x: x["hot"])).isEmpty():
        # A content's key is its row's and its start; its spans are moved back by that.
        key = F.concat("row", F.to_binary(F.lpad(F.hex("start"), 16, "0"), F.lit("hex"))).alias("row")
        pieces = common.written(contents.where("hot").select(key, F.col("content").alias("text")), "contents")
        _, inner = _spans(pieces, length, min(gram * 2, length), large)
        start = F.conv(F.hex(F.expr("substring(row, length(row) - 7, 8)")), 16, 10).cast("long")
        found = found.unionByName(inner.select(F.expr("substring(row, 1, length(row) - 8)").alias("row"), (F.col("a") + start).alias("a"), (F.col("b") + start).alias("b")))
    return candidates, found


def removed(text: bytes, spans: list) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal runs removed)."""
    mark = np.zeros(len(text) + 2, np.int8)
    for a, b in spans:
        mark[a + 1 : b + 1] = 1
    inside = mark[1:-1].astype(bool)
    left = np.frombuffer(text, np.uint8)[~inside].tobytes()
    return left, int(inside.sum()), int((np.diff(mark) == 1).sum())


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, large: int = LARGE, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words (words in
    passages that also stand in another row, however few their bytes; see ``passages``), and
    with ``with_text`` the bytes left, as ``kept``."""
    rows = keyed_rows(docs)
    places, contents, wanted = passages.shared_groups(rows, large=large)
    candidates, spans = _spans(rows, length, gram, large, wanted)
    shared = passages.passage_words(candidates.where("passages is not null").select("row", "text", "passages"), places, contents)
    by_row = spans.groupBy("row").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    schema = pa.schema([("row", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "text", 1 << 22):
            out: dict[str, list] = {n: [] for n in schema.names}
            for row, text, found in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "spans")), strict=True):
                left, n, runs_ = removed(text, [(x["a"], x["b"]) for x in found])
                for name, value in zip(out, (row, n, runs_, hashlib.sha256(left).hexdigest(), left if with_text else None), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    touched = candidates.select("row", "text").join(by_row, "row").mapInArrow(cut, "row binary, n_removed long, n_spans long, kept_sha256 string, kept binary")
    touched = common.written(touched, "cut")
    whole = rows.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"), *([F.col("text")] if with_text else []))
    joined = whole.join(touched, "row", "left").join(shared, "row", "left")
    kept = [F.when(F.col("n_removed").isNull(), F.col("text")).otherwise(F.col("kept")).alias("kept")] if with_text else []
    return joined.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("n_passage_words", F.lit(0)).cast("long").alias("n_passage_words"), *kept)
