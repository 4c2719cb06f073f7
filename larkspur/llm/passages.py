"""Passages of over 50 words that stand in several documents.

The way of ``substring_dedup``, over words in place of bytes: a window of ``WORDS`` words
belongs to the least hash of ``GRAM`` words in it, neighbouring windows with the same least
hash form one stretch, and stretches whose least hash stands in one document only end
here.  Stretches of equal words are shared as a whole; where a group holds unlike ones, the
hashes of their single windows are counted, each distinct stretch once: groups of up to
``LARGE`` bytes of hashes in tasks of about ``SHARD`` at a time, larger ones window by window.

Rules: words are ``[^\\x20\\x09-\\x0D]+`` with case and marks kept, so spaces and line ends between
them do not count; every row is a document of its own, equal rows included; what repeats inside
one document alone is no passage.  Windows are compared by 64-bit hashes of their words inside
the group of a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common
from larkspur.llm.rolling import BYTE_VALUES, mixed, rolled, runs, stretches_of
from larkspur.operators.skew import join_counted

WORDS, GRAM = 51, 8
SHARD, LARGE = 1 << 21, 1 << 23
BATCH = 1 << 19  # bytes of texts that meet in one array
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


@cache
def _first_powers(base: int) -> np.ndarray:
    return _powers(base, 2 * BATCH, held=False)


def _powers(base: int, n: int, held: bool = True) -> np.ndarray:
    if held and n <= 2 * BATCH:
        return _first_powers(base)[:n]
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit hash of every word, number of words of every text)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[data]])))
    start, stop = edges[::2], edges[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * _powers(_BASE, len(data)), out=total[1:])
    # A word's sum, moved back to where it would be at the start.
    back = _powers(pow(_BASE, -1, 1 << 64), len(data))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return mixed((total[stop] - total[start]) * back[start]), np.diff(np.searchsorted(start, ends), prepend=0)


def stretches(texts: list[bytes], words: int = WORDS, gram: int = GRAM) -> dict[str, np.ndarray]:
    """All stretches of some texts: text number, start, windows, anchor, content."""
    hashes, sizes = word_hashes(texts)
    return stretches_of(hashes, mixed(rolled(hashes, gram)), sizes, words, gram, repeats=False)


def shared_groups(rows: DataFrame, words: int = WORDS, gram: int = GRAM, large: int = LARGE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(places, contents, wanted) of ``rows`` (row, text): the stretches whose group stands in
    several documents; the distinct ones; by row, those whose windows must be counted."""
    schema = pa.schema([("row", pa.binary()), ("document", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("anchor", pa.int64()), ("content", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "text", BATCH):
            found = stretches(batch.column("text").to_pylist(), words, gram)
            of = {c: batch.column(c).take(pa.array(found["text"])) for c in ("row", "document")}
            yield pa.RecordBatch.from_pydict(of | {n: found[n].astype(schema.field(n).type.to_pandas_dtype(), copy=False) for n in schema.names[2:]}, schema=schema)

    long_texts = rows.where(F.octet_length("text") >= 2 * words - 1).select("row", F.monotonically_increasing_id().alias("document"), "text")
    all_places = common.written(long_texts.mapInArrow(cut, "row binary, document long, start int, windows int, anchor long, content long"), "word-stretches")
    documents = [F.min("document").alias("first"), F.max("document").alias("last")]
    anchors = all_places.groupBy("anchor").agg(F.count("*").alias("n"), *documents).where("first < last").select("anchor", "n")
    places = common.written(join_counted(all_places, anchors, ["anchor"], all_places.count()), "shared-word-stretches")
    contents = common.written(places.groupBy("anchor", "content").agg(F.count("*").alias("n"), *documents, F.min(F.struct("row", "start", "windows")).alias("x")), "word-contents")
    unlike = contents.groupBy("anchor").agg(F.count("*").alias("d"), (8 * F.sum("x.windows") > large).alias("hot")).where("d > 1")
    counted = join_counted(contents, unlike, ["anchor"], contents.count(), "d")
    wanted = counted.groupBy("x.row").agg(F.collect_list(F.struct("anchor", "content", "n", "first", "last", "hot", "x.start", "x.windows")).alias("passages"))
    return places, contents, wanted


def _shared_parts(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; whole groups are gathered up to about ``SHARD`` bytes."""
    held: list[tuple[int, int, int, int, int, np.ndarray]] = []
    size, anchor = 0, None

    def out() -> pa.RecordBatch:
        window = np.concatenate([x[5] for x in held])
        n = np.array([len(x[5]) for x in held])
        of = {i: np.repeat(np.array([x[i] for x in held], np.int64), n) for i in (0, 3, 4)}
        order = np.lexsort((window, of[0]))
        new = np.ones(len(order), bool)
        new[1:] = (window[order][1:] != window[order][:-1]) | (of[0][order][1:] != of[0][order][:-1])
        begin = np.flatnonzero(new)
        several = np.minimum.reduceat(of[3][order], begin) < np.maximum.reduceat(of[4][order], begin)
        shared = np.empty(len(order), bool)
        shared[order] = several[np.cumsum(new) - 1]
        found = [(x[0], x[1], x[2], a, b) for x, e in zip(held, np.cumsum(n).tolist(), strict=True) if x[3] == x[4] for a, b in runs(np.flatnonzero(shared[e - len(x[5]) : e]), words)]
        return pa.RecordBatch.from_pydict(dict(zip(PARTS.names, zip(*found, strict=True), strict=True)) if found else {c: [] for c in PARTS.names}, schema=PARTS)

    for batch in batches:
        for *x, window in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "n", "first", "last", "window")), strict=True):
            if x[0] != anchor and size >= SHARD:
                yield out()
                held, size = [], 0
            anchor = x[0]
            held.append((*x, np.frombuffer(window, np.int64)))
            size += len(window)
    if held:
        yield out()


#: Shared words of a stretch that is not shared as a whole, from its start.
PARTS = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("n", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])
PARTS_DDL = "anchor long, content long, n long, a int, b int"


def passage_words(texts: DataFrame, places: DataFrame, contents: DataFrame, words: int = WORDS) -> DataFrame:
    """(row, n_passage_words) of rows with passages; ``texts`` (row, text, passages) are the
    rows of ``wanted`` with their texts."""
    names = ("anchor", "content", "n", "first", "last", "hot")
    schema = pa.schema([*((c, pa.int64()) for c in names[:5]), ("hot", pa.bool_()), ("window", pa.binary())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "text", BATCH):
            hashes, sizes = word_hashes(batch.column("text").to_pylist())
            window = mixed(rolled(hashes, words))
            stretch = [(x, int(begin) + x["start"]) for begin, wanted in zip(np.cumsum(sizes) - sizes, batch.column("passages").to_pylist(), strict=True) for x in wanted]
            yield pa.RecordBatch.from_pydict({c: [x[c] for x, _ in stretch] for c in names} | {"window": [window[i : i + x["windows"]].tobytes() for x, i in stretch]}, schema=schema)

    single_schema = pa.schema([*((c, pa.int64()) for c in names[:5]), ("at", pa.int32()), ("window", pa.int64())])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "window", 1 << 20):
            windows = [np.frombuffer(x, np.int64) for x in batch.column("window").to_pylist()]
            of = pa.array(np.repeat(np.arange(len(windows)), [len(x) for x in windows]))
            yield pa.RecordBatch.from_pydict({c: batch.column(c).take(of) for c in names[:5]} | {"at": np.concatenate([np.arange(len(x), dtype=np.int32) for x in windows]), "window": np.concatenate(windows)}, schema=single_schema)

    all_windows = texts.mapInArrow(hashed, "anchor long, content long, n long, first long, last long, hot boolean, window binary")
    small = all_windows.where("not hot").repartition("anchor").sortWithinPartitions("anchor")
    told = contents.where("first < last").select("anchor", "content", "n", F.lit(0).alias("a"), F.lit(None).cast("int").alias("b"))
    told = told.unionByName(small.mapInArrow(lambda batches: _shared_parts(batches, words), PARTS_DDL))
    if not texts.where(F.exists("passages", lambda x: x["hot"])).isEmpty():
        windows = common.written(all_windows.where("hot").mapInArrow(single, "anchor long, content long, n long, first long, last long, at int, window long"), "word-windows")
        several = windows.groupBy("anchor", "window").agg(F.count("*").alias("m"), F.min("first").alias("x"), F.max("last").alias("y")).where("x < y").select("anchor", "window", "m")
        shared = join_counted(windows.where("first = last"), several, ["anchor", "window"], windows.count(), "m")
        told = told.unionByName(shared.select("anchor", "content", "n", F.col("at").alias("a"), (F.col("at") + F.lit(words)).alias("b")))
    found = join_counted(places, common.written(told, "word-parts"), ["anchor", "content"], places.count())
    # (first, one past the last) word; each word of a row counts once.
    span = F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.coalesce("b", F.col("windows") + F.lit(words - 1))).alias("b"))
    by_row = found.select("row", span.alias("span")).groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    covered = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["end"]))).alias("n"), F.greatest(s["end"], x["b"]).alias("end")), lambda s: s["n"])
    return by_row.select("row", covered.alias("n_passage_words"))
