import zlib
from collections import Counter

import numpy as np
import pytest

from larkspur.llm import huffman, packing, sharding
from larkspur.llm.common import scratch_path
from larkspur.llm.token_ids import WordEncoder, tokenizer_path

WORDS = "word_bpe_49k.json"


def library(texts, end=2):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(WORDS))
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def expected(rows):
    return Counter((d, len(i), crc(i)) for (d, t), i in zip(rows, library([t for _, t in rows]), strict=True))


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_words_encode_as_the_library_does():
    texts = ["It's İstanbul's ÉTÉ naïve ﬁ x<|endoftext|>Y <|STARTOFTEXT|> áb c ≠≠ don't!!", "", "  ", "ab\x1ccd \x85 e"]
    encoder = WordEncoder(tokenizer_path(WORDS), limit=3)
    for _ in range(3):
        ids, counts = encoder.encode([t.encode() for t in texts])
        ends = np.cumsum(counts)
        assert [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == [x[:-1] for x in library(texts)]


@pytest.mark.parametrize("which", ["edge_docs", "documents", "long_docs"])
def test_files_round_trip(spark, which, request):
    docs = request.getfixturevalue(which)
    path = scratch_path(spark, "ids")
    huffman.write_ids(docs, path, tokenizer_path(WORDS))
    got = huffman.read_ids(spark, path).orderBy("start").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected(rows_of(docs))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x)


def test_empty_table(spark, no_docs):
    path = scratch_path(spark, "ids")
    huffman.write_ids(no_docs, path, tokenizer_path(WORDS))
    assert huffman.read_ids(spark, path).count() == 0
    assert packing.pack_documents(no_docs, tokenizer_path(WORDS)).count() == 0


@pytest.mark.parametrize("limit", [4, 5, 9, 16])
def test_code_lengths_are_optimal_and_limited(limit):
    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 0, 144])
    lengths = huffman.code_lengths(counts, limit)
    assert lengths.max() <= limit and (lengths > 0).sum() == (counts > 0).sum()
    assert (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
    if limit >= 12:  # plain Huffman, by merging
        import heapq

        heap, total = [int(c) for c in counts if c], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            x = heapq.heappop(heap) + heapq.heappop(heap)
            total += x
            heapq.heappush(heap, x)
        assert int((counts * lengths).sum()) == total


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_code_round_trip(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.geometric(0.02, n), 999).astype(np.uint32)
    code = huffman.Code(huffman.code_lengths(np.bincount(ids, minlength=1000) if n else np.ones(1000, int), 12))
    assert code.decode(*code.encode(ids), n).tolist() == ids.tolist()


@pytest.mark.parametrize("size", [5, 12])
def test_cuts_are_the_best_ones(size):
    r = np.random.default_rng(size)
    for _ in range(30):
        cuts = np.unique(np.concatenate([[0], r.choice(np.arange(1, 40), 14, replace=False), np.arange(0, 41, size)]))
        cost = r.integers(0, 9, len(cuts))
        best = [0.0] + [float("inf")] * (len(cuts) - 1)
        for j in range(1, len(cuts)):
            best[j] = min(best[i] + size - (cuts[j] - cuts[i]) + cost[j] for i in range(j) if cuts[j] - cuts[i] <= size)
        chosen = [0, *packing.best_cuts(cuts, cost, size)]
        price = dict(zip(cuts.tolist(), cost.tolist(), strict=True))
        assert sum(size - (b - a) + price[b] for a, b in zip(chosen, chosen[1:], strict=False)) == best[-1]


@pytest.mark.parametrize("which", ["edge_docs", "documents", "long_docs"])
def test_packing_covers_every_id_once(which, request):
    docs = request.getfixturevalue(which)
    got = packing.pack_documents(docs, tokenizer_path(WORDS)).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = total = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
        total += at
    assert sorted(sequences) == list(range(len(sequences)))
    assert padding <= 0.02 * total + 4096
    pieces = {}
    for r in got:
        if r.doc_id is not None:
            pieces.setdefault((r.doc_id, r.doc_tokens), Counter())[(r.start, r.length, r.ids_crc32)] += 1
    for (doc, text), ids in zip(rows_of(docs), library([t for _, t in rows_of(docs)]), strict=True):
        if doc is None or (doc, text) == (8, rows_of(docs)[0][1]):
            continue
        at = 0
        for start, length, check in sorted(pieces[(doc, len(ids))]):
            if start >= at:
                assert start == at and check == crc(ids[start : start + length])
                at += length
        assert at == len(ids)


def test_written_shards_hold_every_row_once(spark, edge_docs, tmp_path):
    rows = [(i % 5, "same text", f"s{i % 2}") for i in range(9)] + [(None, "same text", "s0")] * 4 + [(7, "other", "s1"), (8, None, None), (9, "", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sharding.write_shards(docs, str(tmp_path / "shards"), 4)
    back = spark.read.parquet(str(tmp_path / "shards")).collect()
    assert sorted(((r.doc_id, r.text, r.source) for r in back), key=repr) == sorted(rows, key=repr)
    for shard in range(4):
        assert sorted(r.slot for r in back if r.shard == shard) == list(range(4))
