"""Packing: an order-preserving dynamic programme over document and sentence ends.

Documents in ``doc_id`` order form a stream of ids per range partition.  A
sequence is a stretch of at most ``size`` ids between two cuts; cuts are allowed
at document ends (free), sentence ends (``SENTENCE_COST``) and, inside a stretch
without either, every ``size`` ids (``HARD_COST``).  The programme minimises
padding plus these costs; a monotone queue finds the best start of each window
in constant time on average.  The last stretch of a partition may instead be cut
into powers of two, which need no padding, where that is cheaper.

Rules: null text counts as empty and its end id is packed like any other; null
``doc_id`` comes first; repeated rows are packed each.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm import common
from larkspur.llm.token_ids import REMEMBERED, id_table, unpacked

SENTENCE_COST, HARD_COST = 6, 64
STREAM_IDS = 1 << 21
PIECES = "part long, stream long, sequence long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, offset long"


def sentence_end_ids(tokenizer_path: str) -> np.ndarray:
    """True for ids whose token closes a sentence."""
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_file(tokenizer_path).get_vocab()
    out = np.zeros(max(vocab.values()) + 1, bool)
    out[[i for t, i in vocab.items() if t.removesuffix("</w>").endswith((".", "!", "?"))]] = True
    return out


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, closes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending cut positions (0 and the end among them) and the cost of each."""
    n = len(ids)
    at_doc, at_sentence = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    at_doc[doc_ends] = True
    at_sentence[1:] = closes[np.minimum(ids, len(closes) - 1)] & (ids < len(closes))
    any_ = at_doc | at_sentence
    any_[[0, n]] = True
    cuts = np.flatnonzero(any_)
    gaps = np.diff(cuts)
    if len(gaps) and gaps.max() > size:
        wide = np.flatnonzero(gaps > size)
        cuts = np.unique(np.concatenate([cuts, *(np.arange(cuts[i] + size, cuts[i + 1], size) for i in wide)]))
    cost = np.where(at_doc[cuts], 0, np.where(at_sentence[cuts], SENTENCE_COST, HARD_COST))
    cost[[0, -1]] = 0
    return cuts, cost


def best_cuts(cuts: np.ndarray, cost: np.ndarray, size: int) -> list[int]:
    """Positions at which to cut: min over starts i in the window of
    best[i] + size - (cut[j] - cut[i]) + cost[j], by a queue of falling keys."""
    if len(cuts) <= 1:
        return []
    pos, price = cuts.tolist(), cost.tolist()
    best, back = [0] * len(pos), [0] * len(pos)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (best[i] + cut[i], i), keys rising
    for j in range(1, len(pos)):
        p = pos[j]
        while pos[queue[0][1]] < p - size:
            queue.popleft()
        key, i = queue[0]
        best[j], back[j] = key + size - p + price[j], i
        key = best[j] + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [], len(pos) - 1
    while j:
        out.append(pos[j])
        j = back[j]
    return out[::-1]


def _tail(first: int, last: int, size: int) -> list[int]:
    """Ends for the last stretch: powers of two where their cuts cost less than padding."""
    n = last - first
    powers = [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]
    if (len(powers) - 1) * HARD_COST < size - n and n & (n - 1):
        return [first + int(x) for x in np.cumsum(powers)]
    return [last]


def pack_stream(docs: list, texts: list[np.ndarray], closes: np.ndarray, size: int) -> dict[str, list]:
    flat = np.concatenate(texts).astype("<u4")
    sizes = np.array([len(x) for x in texts])
    ends = np.cumsum(sizes)
    cuts = best_cuts(*boundaries(flat, ends, closes, size), size)
    cuts = cuts[:-1] + _tail(cuts[-2] if len(cuts) > 1 else 0, cuts[-1], size)
    edges = np.unique(np.concatenate([[0], cuts, ends]))
    begin, end = edges[:-1], edges[1:]
    doc, seq = np.searchsorted(ends, begin, "right"), np.searchsorted(cuts, begin, "right")
    opened = np.concatenate([[0], cuts])[seq]
    return {
        "sequence": seq,
        "doc_id": [docs[i] for i in doc],
        "start": begin - (ends - sizes)[doc],
        "length": end - begin,
        "ids_crc32": [zlib.crc32(flat[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)],
        "doc_tokens": sizes[doc],
        "offset": begin - opened,
    }


def pack(ids: DataFrame, closes: np.ndarray, size: int = 4096) -> DataFrame:
    """Pieces of every document of an ``id_table``."""
    schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, stream, held = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        texts: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            made = pack_stream(docs, texts, closes, size)
            n = len(made["sequence"])
            return pa.RecordBatch.from_pydict({"part": [part] * n, "stream": [stream] * n} | made, schema=schema)

        for batch in batches:
            for doc, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                docs.append(doc)
                texts.append(unpacked(x))
                held += len(texts[-1])
                if held >= STREAM_IDS:
                    yield out()
                    stream, held, docs, texts = stream + 1, 0, [], []
        if docs:
            yield out()

    pieces = ids.withColumn("h", F.xxhash64("ids")).withColumn("n", common.row_number()).repartitionByRange("doc_id", "h", "n").sortWithinPartitions("doc_id", "h", "ids").select("doc_id", "ids").mapInArrow(run, PIECES)
    pieces = common.written(pieces, "pieces")
    # One row per stream (some two million ids), so these running totals stay small.
    streams = pieces.groupBy("part", "stream").agg((F.max("sequence") + 1).alias("n"))
    within = Window.partitionBy("part").orderBy("stream")
    parts = streams.groupBy("part").agg(F.sum("n").alias("of_part"))
    parts = parts.select("part", (F.sum("of_part").over(Window.orderBy("part")) - F.col("of_part")).alias("before"))
    streams = streams.join(parts, "part").select("part", "stream", (F.col("before") + F.sum("n").over(within) - F.col("n")).alias("base"))
    return pieces.join(streams, ["part", "stream"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("sequence")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 4096, remembered: int = REMEMBERED) -> DataFrame:
    return pack(id_table(docs, tokenizer, end_id, remembered), sentence_end_ids(tokenizer), size)
