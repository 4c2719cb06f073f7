"""Token ids in binary files: canonical length-limited Huffman coding.

Code lengths come from the counts of all ids.  A file (one Spark partition) is a
sequence of independent blocks of whole documents in ascending ``doc_id`` order;
a block holds its bits as big-endian 64-bit words and a bit offset for every
``STEP`` ids, from which its runs are decoded side by side through one table.

Rules: null text counts as empty; null ``doc_id`` comes first; rows that repeat a
``doc_id`` follow one another in order of a hash of their ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm import common
from larkspur.llm.token_ids import id_table, unpacked

STEP = 256
BLOCK_IDS = 1 << 17
BLOCK_SCHEMA = "part long, block long, first long, n_ids long, doc_ids array<long>, doc_sizes array<long>, offsets binary, bits binary"


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0: id not used."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of over {limit} bits")
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    level, levels = weights, []
    for _ in range(limit):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1) if levels else np.empty(0, np.int64)
        both = np.concatenate([weights, packages])
        by = np.argsort(both, kind="stable")
        levels.append(by < len(weights))
        level = both[by]
    take = 2 * (len(used) - 1)
    sizes = np.zeros(len(used), np.int64)
    for is_symbol in reversed(levels):
        symbols = int(is_symbol[:take].sum())
        sizes[:symbols] += 1
        take = 2 * (take - symbols)
    lengths[order] = sizes
    return lengths


class Code:
    """The canonical code of given lengths, with its decoding table."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.limit = max(1, int(lengths.max(initial=0)))
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        spans = 1 << (self.limit - self.lengths[order])
        ends = np.cumsum(spans)
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (ends - spans) >> (self.limit - self.lengths[order])
        #: Code at the top, length below.
        self.entries = (self.codes << (64 - self.lengths).astype(np.uint64) if len(lengths) else self.codes) | self.lengths.astype(np.uint64)
        self.entries[lengths == 0] = 0
        self.ids = np.zeros(1 << self.limit, np.uint32)
        self.sizes = np.ones(1 << self.limit, np.int64)
        self.ids[: ends[-1] if len(ends) else 0] = np.repeat(order, spans)
        self.sizes[: ends[-1] if len(ends) else 0] = np.repeat(self.lengths[order], spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(bit offsets of every STEP-th id, bits)."""
        if not len(ids):
            return b"", b""
        value = self.entries[ids]
        sizes = (value & np.uint64(63)).view(np.int64)
        value &= ~np.uint64(63)
        ends = np.cumsum(sizes)
        at = ends - sizes
        word, low = at >> 6, at & 63
        shift = low.view(np.uint64)
        out = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[starts]] = np.bitwise_or.reduceat(value >> shift, starts)
        over = np.flatnonzero(low + sizes > 64)
        out[word[over] + 1] |= value[over] << (np.uint64(64) - shift[over])
        return at[::STEP].astype("<i8").tobytes(), out.astype(">u8").tobytes()

    def decode(self, offsets: bytes, bits: bytes, n: int) -> np.ndarray:
        words = np.frombuffer(bits, ">u8").astype(np.uint64)
        at = np.frombuffer(offsets, "<i8").copy()
        out = np.zeros((STEP, len(at)), np.uint32)
        one, top, drop = np.uint64(1), np.uint64(63), np.uint64(64 - self.limit)
        last = len(words) - 2
        for k in range(min(STEP, n)):
            word, shift = np.minimum(at >> 6, last), (at & 63).astype(np.uint64)
            index = ((words[word] << shift) | ((words[word + 1] >> one) >> (top - shift))) >> drop
            out[k] = self.ids[index]
            at += self.sizes[index]
        return out.T.reshape(-1)[:n]


def id_counts(ids: DataFrame, vocab: int) -> np.ndarray:
    """How often each id occurs; one row per id reaches the driver, at most ``vocab``."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab, np.int64)
        for batch in common.small_batches(batches, "ids", 1 << 19):
            total += np.bincount(np.concatenate([unpacked(x) for x in batch.column("ids").to_pylist()]), minlength=vocab)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": used, "n": total[used]}, schema=schema)

    rows = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(vocab, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def write_blocks(ids: DataFrame, lengths: np.ndarray, path: str) -> None:
    """Range-partition by ``doc_id``, code each partition block by block, write the files."""
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int64())), ("offsets", pa.binary()), ("bits", pa.binary())])

    def code_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, part = Code(lengths), TaskContext.get().partitionId()
        block = first = held = 0
        docs: list[int | None] = []
        texts: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            flat = np.concatenate(texts)
            offsets, bits = code.encode(flat)
            return pa.RecordBatch.from_pydict({"part": [part], "block": [block], "first": [first], "n_ids": [len(flat)], "doc_ids": [docs], "doc_sizes": [[len(x) for x in texts]], "offsets": [offsets], "bits": [bits]}, schema=schema)

        for batch in batches:
            for doc, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                docs.append(doc)
                texts.append(unpacked(x))
                held += len(texts[-1])
                if held >= BLOCK_IDS:
                    yield out()
                    block, first, held, docs, texts = block + 1, first + held, 0, [], []
        if docs:
            yield out()

    (
        ids.withColumn("h", F.xxhash64("ids"))
        .withColumn("n", common.row_number())
        .repartitionByRange("doc_id", "h", "n")
        .sortWithinPartitions("doc_id", "h", "ids")
        .select("doc_id", "ids")
        .mapInArrow(code_partition, BLOCK_SCHEMA)
        .write.option("compression", "none")
        .parquet(path)
    )


def read_blocks(spark, path: str, lengths: np.ndarray) -> DataFrame:
    """Decode the files: (doc_id, start, n_tokens, ids_crc32) per document."""
    schema = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                flat = code.decode(row["offsets"], row["bits"], row["n_ids"]).astype("<u4")
                sizes = np.array(row["doc_sizes"], np.int64)
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(flat[e - n : e]) for e, n in zip(ends, sizes, strict=True)]
                yield pa.RecordBatch.from_pydict({"part": [row["part"]] * len(sizes), "doc_id": row["doc_ids"], "at": row["first"] + ends - sizes, "n_tokens": sizes, "ids_crc32": crc}, schema=schema)

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # One row per file, so the running total over files stays small.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    docs = blocks.mapInArrow(decode, "part long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(before, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, limit: int = 16) -> np.ndarray:
    """Tokenise ``docs`` and write the coded files to ``path``; returns the code
    lengths, which with the files are all that reading needs (they are also
    written beside them, to ``path + '.code'``)."""
    from tokenizers import Tokenizer

    vocab = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    ids = id_table(docs, tokenizer, end_id)
    lengths = code_lengths(id_counts(ids, vocab), max(limit, (vocab - 1).bit_length()))
    write_blocks(ids, lengths, path)
    docs.sparkSession.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").write.parquet(f"{path}.code")
    return lengths


def read_ids(spark, path: str) -> DataFrame:
    row = spark.read.schema("lengths binary").parquet(f"{path}.code").first()
    return read_blocks(spark, path, np.frombuffer(bytes(row.lengths), np.uint8))
