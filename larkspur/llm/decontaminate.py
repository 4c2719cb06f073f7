"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents inside a task.  Only stretches of benchmark words
can hold a window, so a shard's sequence consists of such stretches that are long
enough for the shortest window; everything else is one separator.  All windows
are searched backwards at once; the occurrences found are located, and their
spans merged.

The benchmark is read in blocks of at most ``BLOCK_WORDS`` words; each block is
shipped to the tasks and run against all documents, so its size is bounded
whatever the size of the benchmark; a longer item is divided.

Rules: null texts have no words; an item without words has no window; null item
ids are ignored; rows that repeat an item id form one item.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common
from larkspur.llm.fm_index import FMIndex

BLOCK_WORDS = 1 << 20
SHARD_BYTES = 1 << 23
#: Bytes outside words become a space, A-Z are lowered; every byte from 0x80 belongs to a word.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Windows:
    """The distinct windows of some items, as numbers of their words."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.word_no: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            numbers = [self.word_no.setdefault(w, len(self.word_no) + 1) for w in words_of(text)]
            for i in range(max(1, len(numbers) - width + 1) if numbers else 0):
                owners.setdefault(tuple(numbers[i : i + width]), set()).add(item)
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.patterns = np.zeros((len(owners), width), np.int64)
        for row, w in enumerate(owners):
            self.patterns[row, : len(w)] = w
        self.items = [sorted(x) for x in owners.values()]
        self.shortest = int(self.lengths.min(initial=width))


def stretches(numbers: np.ndarray, text_ends: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence to index (stretches of non-zero numbers inside one text, each
    followed by 0) and the position in ``numbers`` of each of its places (-1: separator)."""
    known = numbers > 0
    edge = np.diff(np.concatenate([[False], known, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inner = text_ends[:-1]
    inner = inner[(inner > 0) & (inner < len(numbers))]
    inner = np.unique(inner[known[inner - 1] & known[inner]]) if len(inner) else inner
    starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    keep = ends - starts >= shortest
    starts, sizes = starts[keep], (ends - starts)[keep] + 1
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    last = np.cumsum(sizes) - 1
    places = at.copy()
    places[last] = -1
    sequence = np.zeros(len(at), np.int64)
    sequence[places >= 0] = numbers[places[places >= 0]]
    return sequence, places


def find(texts: list[list[bytes]], windows: Windows) -> tuple[list[list[tuple[int, int]]], list[list[str]]]:
    """For each text: merged spans of words hit (end exclusive), and the items found."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    get = windows.word_no.get
    numbers = np.fromiter((get(w, 0) for t in texts for w in t), np.int64, int(sizes.sum()))
    sequence, places = stretches(numbers, ends, windows.shortest)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    if len(sequence) and len(windows.lengths):
        index = FMIndex(sequence)
        low, high = index.ranges(windows.patterns, windows.lengths)
        found = np.flatnonzero(high > low)
        counts = (high - low)[found]
        pattern = np.repeat(found, counts)
        rows = np.repeat(low[found] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        start = places[index.locate(rows)]
        text = np.searchsorted(ends, start, "right")
        for p, t in np.unique(np.stack([pattern, text], 1), axis=0).tolist():
            items[t].update(windows.items[p])
        hit = np.zeros(len(numbers) + 1, np.int64)
        np.add.at(hit, start, 1)
        np.add.at(hit, start + windows.lengths[pattern], -1)
        covered = np.cumsum(hit)[:-1] > 0
        first = ends - sizes
        for t in np.unique(text).tolist():
            edge = np.diff(np.concatenate([[False], covered[first[t] : ends[t]], [False]]).astype(np.int8))
            spans[t] = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
    return spans, [sorted(x) for x in items]


def parts_of(text: bytes, width: int, most: int) -> Iterator[bytes]:
    """A text in parts of about ``most`` words that hold all its windows."""
    words = words_of(text) if len(text) > most else []
    if len(words) <= most:
        yield text
    else:
        for i in range(0, len(words) - width + 1, most):
            yield b" ".join(words[i : i + most + width - 1])


def benchmark_blocks(benchmark: DataFrame, width: int = 10, most: int | None = None) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of bounded size, streamed through the driver; a longer item is divided."""
    most = max(most or BLOCK_WORDS, width)
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    block, held = [], 0
    for r in rows.toLocalIterator():
        for part in parts_of(bytes(r.text), width, most):
            block.append((r.item, part))
            held += len(part) // 4 + 1
            if held > most:
                yield block
                block, held = [], 0
    if block:
        yield block


def merge_spans(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, keep: list[str] = (), block_words: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, spans (array of start, end in words),
    items, and the columns of ``docs`` named in ``keep`` as ``_<name>``."""
    return _searched(docs, benchmark, width, list(keep), block_words, False)


def cleaned(docs: DataFrame, benchmark: DataFrame, width: int = 10, keep: list[str] = (), block_words: int | None = None) -> DataFrame:
    """As ``contamination``, the kept text without the words of its spans and what stands
    between them; null texts stay null."""
    return _searched(docs, benchmark, width, list(keep), block_words, True)


def _searched(docs: DataFrame, benchmark: DataFrame, width: int, keep: list[str], block_words: int | None, cut: bool) -> DataFrame:
    rows = common.texts_kept(docs, keep)
    blocks = benchmark_blocks(benchmark, width, block_words)
    first, more = next(blocks, []), next(blocks, None)
    if more is None:
        return _against(rows, first, width, keep, cut)
    # Several blocks: each reads all texts; what it finds is joined by the rows' keys.
    keyed = rows.withColumn("_row_key", common.row_key())
    every, block = common.written(_against(keyed, first, width, ["row_key"], False), "contamination"), more
    while block is not None:
        every = every.unionByName(common.written(_against(keyed, block, width, ["row_key"], False), "contamination"))
        block = next(blocks, None)
    found = every.groupBy("_row_key").agg(F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = keyed.join(found, "_row_key").drop("_row_key")
    return joined.mapInArrow(_merging(keep, cut), _ddl(rows, keep))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _ddl(rows: DataFrame, keep: list[str]) -> str:
    return "doc_id long, n_words long, spans array<struct<a: long, b: long>>, items array<string>" + common.kept_ddl(rows, keep)


def _without(batch: pa.RecordBatch, spans: list[list[tuple[int, int]]]) -> pa.Array:
    """The texts of a batch without the words of their spans."""
    texts = batch.column("text").to_pylist()
    return pa.array([cut_words(t, s) if t is not None and s else t for t, s in zip(texts, spans, strict=True)], pa.string())


def _as_structs(spans: list[list[tuple[int, int]]]) -> list[list[dict[str, int]]]:
    return [[{"a": a, "b": b} for a, b in s] for s in spans]


def _merging(keep: list[str], cut: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "text", 1 << 21):
            spans = [merge_spans(s) for s in batch.column("spans").to_pylist()]
            made = pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": batch.column("n_words"), "spans": _as_structs(spans), "items": batch.column("items")}, schema=_SCHEMA)
            yield common.kept_columns(made, batch, keep, _without(batch, spans) if cut else None)

    return run


def _against(rows: DataFrame, items: list[tuple[str, bytes]], width: int, keep: list[str], cut: bool) -> DataFrame:
    """The search of one block of items."""
    block = hashlib.md5(repr((items, width)).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = common.worker_cache(("windows", block), lambda: Windows(items, width))
        for batch in common.small_batches(batches, "text", SHARD_BYTES):
            texts = [words_of(t) for t in common.texts_of(batch)]
            spans, found = find(texts, windows)
            made = pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": [len(t) for t in texts], "spans": _as_structs(spans), "items": found}, schema=_SCHEMA)
            yield common.kept_columns(made, batch, keep, _without(batch, spans) if cut else None)

    return rows.mapInArrow(run, _ddl(rows, keep))


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    import re

    found = [m.span() for m in re.finditer("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : found[a][0]])
        at = found[b - 1][1]
    return "".join([*out, text[at:]])
