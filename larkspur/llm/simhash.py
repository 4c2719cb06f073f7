"""Document fingerprints: SimHash of weighted terms, searched by permuted block tables.

Terms are pairs of neighbouring words (A-Z lowered), and for texts of under
``SHORT`` words also single words and character triples.  A term's 64-bit hash
votes on every bit with weight 1 + ln(count), for on set bits and against on clear
ones; a positive sum sets the bit.

Rules: a null text counts as empty and has fingerprint zero; a null ``doc_id``
comes last in the descending order; rows that repeat a ``doc_id`` follow in the
order of a hash of their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm import common

SHORT = 8
REMEMBERED = 300_000
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    """Hashes of words, which a worker keeps between tasks."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > REMEMBERED:
            self.clear()
        h = self[word] = xxh64_intdigest(word, 1)
        return h


def term_hashes(text: str) -> np.ndarray:
    words = text.encode().lower().split()
    hashed = common.worker_cache("word hashes", _Hashes).__getitem__
    one = np.array([hashed(w) for w in words], np.uint64)
    mixed = (one[:-1] * _LEFT) ^ ((one[1:] ^ (one[1:] >> np.uint64(29))) * _RIGHT)
    mixed ^= mixed >> np.uint64(32)
    pairs = mixed * _LEFT
    if len(words) >= SHORT:
        return pairs
    triples = np.array([hashed(text[i : i + 3].encode()) for i in range(max(1, len(text) - 2))] if text else [], np.uint64)
    return np.concatenate([one, pairs, triples])


def fingerprint(text: str) -> int:
    hashes = term_hashes(text)
    if not len(hashes):
        return 0
    terms, counts = np.unique(hashes, return_counts=True)
    weights = 1 + np.log(counts)
    votes = np.zeros(64)
    for i in range(0, len(terms), 1 << 15):
        bits = np.unpackbits(terms[i : i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += weights[i : i + (1 << 15)] @ bits.astype(np.float64)
    return int(np.packbits(votes * 2 > weights.sum()).view(">u8")[0])


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / 64


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as much of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


ROW = "part long, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
FIELDS = [c.split()[0] for c in ROW.split(", ")]
_TYPES = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def compared(part: int, doc, text: str, fp: int, following: str, next_fp: int) -> tuple:
    other = edited(text, following)
    other_fp = fp if other == text else fingerprint(other)
    return (part, doc, len(text), hashlib.sha256(other.encode()).hexdigest(), f"{fp:016x}", f"{other_fp:016x}", likeness(fp, other_fp), likeness(fp, next_fp))


def fingerprints_with_next(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint beside those of its edited text and of the next document."""
    schema = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in ROW.split(", ")] + [("first_text", pa.string()), ("last_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of a partition is compared with the next one in it; the texts at
        both ends of the partition are handed on, two rows for each partition."""
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None
        for batch in common.small_batches(batches, "text", 1 << 20):
            rows = []
            for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = data.decode()
                fp = fingerprint(text)
                if held is None:
                    rows.append((part, doc, *[None] * 6, text, None))
                else:
                    rows.append((*compared(part, *held, text, fp), None, None))
                held = (doc, text, fp)
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema=schema)
        if held:
            yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(schema.names, (part, held[0], *[None] * 6, None, held[1]), strict=True)}, schema=schema)

    ordered = common.keyed_texts(docs).withColumn("h", F.xxhash64("text")).withColumn("n", common.row_number()).repartitionByRange(F.desc("doc_id"), "h", "n").sortWithinPartitions(F.desc("doc_id"), "h", "text").drop("h", "n")
    rows = common.written(ordered.mapInArrow(run, ROW + ", first_text string, last_text string"), "fingerprints")
    # Only the ends of partitions remain: one text at each end.
    parts = rows.where("first_text is not null").select("part")
    order = Window.orderBy("part")
    following = parts.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())).alias("next"))
    firsts = rows.where("first_text is not null").select(F.col("part").alias("next"), F.col("first_text").alias("following"))
    ends = rows.where("last_text is not null").select("part", "doc_id", F.col("last_text").alias("text")).join(following, "part").join(firsts, "next").select("part", "doc_id", "text", "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema(list(schema)[: len(FIELDS)])
        for batch in batches:
            done = [compared(r["part"], r["doc_id"], r["text"], fingerprint(r["text"]), r["following"], fingerprint(r["following"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pydict(dict(zip(FIELDS, zip(*done, strict=True), strict=True)) if done else {f: [] for f in FIELDS}, schema=out)

    inner = rows.where("n_chars is not null").select(*FIELDS)
    return inner.unionByName(ends.mapInArrow(close, ROW)).drop("part")


def block_masks(radius: int, blocks: int) -> list[int]:
    """Masks of every choice of ``blocks - radius`` blocks: fingerprints within the
    radius leave at least so many blocks alike."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    ones = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    return [sum(ones[i] for i in c) for c in combinations(range(blocks), blocks - radius)]


def search(prints: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(query, fp, distance): all distinct ``fp`` of ``prints`` (signed 64-bit) within
    ``radius`` bits of each distinct ``fp`` of ``queries``, by permuted block tables."""
    signed = [m - (1 << 64) if m >> 63 else m for m in block_masks(radius, blocks)]
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).alias("mask")) for i, m in enumerate(signed)])

    def keyed(df: DataFrame, name: str) -> DataFrame:
        distinct = df.select(F.col("fp").alias(name)).where("fp is not null").distinct()
        return distinct.select(name, F.explode(tables).alias("x")).select(name, F.col("x.t").alias("t"), F.col("x.mask").bitwiseAND(F.col(name)).alias("key"))

    pairs = keyed(queries, "query").join(keyed(prints, "fp"), ["t", "key"])
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fp")))
    first = F.expr("filter(array(" + ", ".join(f"if((query & {m}L) = (fp & {m}L), {i}, null)" if m >= 0 else f"if((query & ({m}L)) = (fp & ({m}L)), {i}, null)" for i, m in enumerate(signed)) + "), x -> x is not null)[0]")
    return pairs.where((distance <= radius) & (F.col("t") == first)).select("query", "fp", distance.cast("int").alias("distance"))
