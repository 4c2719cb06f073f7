import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from larkspur.llm import decontaminate, substring_dedup
from larkspur.llm.fm_index import FMIndex
from larkspur.llm.suffix_array import _order_of_names, permuted_lcp, suffix_array


def brute_removed(texts, k):
    seen = Counter(t[i : i + k] for t in texts for i in range(len(t) - k + 1))
    out = []
    for t in texts:
        mark = [False] * len(t)
        for i in range(len(t) - k + 1):
            if seen[t[i : i + k]] > 1:
                mark[i : i + k] = [True] * k
        left = bytes(b for b, m in zip(t, mark, strict=True) if not m)
        out.append((len(t), sum(mark), sum(m and not p for m, p in zip(mark, [False, *mark], strict=False)), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize(("which", "large"), [("edge_docs", 1 << 23), ("edge_docs", 1000), ("edge_docs", 0), ("documents", 1 << 23)])
def test_repeated_substrings(which, large, request):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
    want = Counter((d, *x) for (d, _), x in zip(rows, brute_removed([t for _, t in rows], 400), strict=True))
    got = substring_dedup.deduplicate(docs, large=large).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_one_large_group(spark):
    """A passage shared by all texts, in contexts of their own, copies of a third of the
    rows, and runs of one byte: the group divides by longer hashes, over many partitions."""
    r = np.random.default_rng(7)
    word = lambda n: "".join(map(chr, r.integers(97, 123, n)))
    common, phrase = word(390), word(120)
    texts = [word(60) + common + word(80) + phrase + word(300) for _ in range(40)]
    texts += [texts[0]] * 20 + [word(i) + texts[1][30:520] + word(9) for i in range(20)] + ["a" * n for n in (399, 400, 401, 900, 5000)] + ["ab" * 400]
    rows = list(enumerate(texts))
    want = Counter((d, *x) for (d, _), x in zip(rows, brute_removed([t.encode() for t in texts], 400), strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(23)
    got = substring_dedup.deduplicate(docs, large=2000).collect()
    assert Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == want


def test_kept_texts(edge_docs):
    got = substring_dedup.deduplicate(edge_docs, with_text=True).collect()
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_empty(spark, no_docs):
    assert substring_dedup.deduplicate(no_docs).count() == 0
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert decontaminate.contamination(no_docs, items).count() == 0


def test_suffix_arrays():
    r = np.random.default_rng(0)
    for trial in range(60):
        s = r.integers(0, r.integers(1, 5), r.integers(1, 50)).astype(np.uint8)
        s = np.tile(s, 3) if trial % 3 == 0 else s
        s = np.concatenate([s, np.sort(s), np.sort(s)[::-1], s]) if trial % 5 == 0 else s
        order = suffix_array(s, 5)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        assert _order_of_names(s.astype(np.int64)).tolist() == order.tolist()
        value, _ = permuted_lcp(s, order)
        for a, b in zip(order, order[1:], strict=False):
            n = 0
            while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert value[b] == n


def test_fm_index_finds_every_occurrence():
    r = np.random.default_rng(1)
    for _ in range(30):
        s = r.integers(0, 4, 80)
        index = FMIndex(s)
        for n in (1, 3, 5):
            patterns = r.integers(0, 5, (20, n))
            low, high = index.ranges(patterns, np.full(20, n))
            for p, a, b in zip(patterns, low, high, strict=True):
                want = [i for i in range(len(s) - n + 1) if s[i : i + n].tolist() == p.tolist()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def brute_contamination(text, items, width=10):
    def words(t):
        return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))

    doc, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        if item is None:
            continue
        windows = [w[i : i + width] for i in range(max(1, len(w) - width + 1))] if w else []
        for x in windows:
            for i in range(len(doc) - len(x) + 1):
                if doc[i : i + len(x)] == x:
                    hit.update(range(i, i + len(x)))
                    found.add(str(item))
    return len(doc), len(hit), sorted(found)


def compare(spark, docs, bench, **options):
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = Counter((r.doc_id, *map(str, brute_contamination(r.text, items))) for r in docs.select("doc_id", "text").collect())
    got = decontaminate.contamination(docs, bench, **options).collect()
    assert Counter((r.doc_id, str(r.n_words), str(sum(s.b - s.a for s in r.spans)), str(list(r["items"]))) for r in got) == want


def test_contamination(spark, documents, sf_dir):
    compare(spark, documents.limit(60), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@pytest.mark.parametrize("block", [1 << 20, 8])
def test_contamination_edges(spark, edge_docs, edge_rows, block, monkeypatch):
    texts = [r[1] for r in edge_rows if r[1]]
    long = max(texts, key=len)
    bench = [(1, long[300:700]), (2, "Two words"), (3, ""), (4, None), (None, long[:200]), (10, long[300:500]), (5, "a"), (6, "été"), (5, "no id here")]
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    compare(spark, edge_docs, spark.createDataFrame(bench, "item_id long, text string"))


def test_cut_words():
    assert decontaminate.cut_words("One, two (three) four.", [(1, 3)]) == "One, ) four."
    assert decontaminate.cut_words("One", [(0, 1)]) == ""


def test_contamination_of_long_texts(spark, long_docs):
    """A passage at the end of a long text, and one that stands in none."""
    text = long_docs.where("doc_id = 0").first().text
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    bench = spark.createDataFrame([(1, " ".join(words[-30:-10])), (2, "none of these ten words stand together in any long text here")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, [(s.a, s.b) for s in r.spans], list(r["items"])) for r in decontaminate.contamination(long_docs, bench, width=10).collect()}
    assert got[0] == got[5] == (len(words), [(len(words) - 30, len(words) - 10)], ["1"]) and got[3][1] == got[1][1] == []


def brute_passage_words(texts, k):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", t) for t in texts]
    held = Counter(x for w in words for x in {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    return [len({j for i in range(len(w) - k + 1) if held[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}) for w in words]


@pytest.mark.parametrize("which", ["edge_docs", "documents"])
def test_passage_words(which, request):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
    want = Counter(zip([d for d, _ in rows], brute_passage_words([t for _, t in rows], 51), strict=True))
    assert Counter((r.doc_id, r.n_passage_words) for r in substring_dedup.deduplicate(docs).collect()) == want
    assert any(n for _, n in want)


@pytest.mark.parametrize("large", [1 << 23, 1000])
def test_short_passages(spark, large):
    """Passages of 50, 51 and 90 words under 400 bytes in two texts each, with other spaces between
    their words; a line that one text repeats; equal rows; many copies in contexts of their own."""
    r = np.random.default_rng(3)
    prose = lambda n: " ".join("".join(map(chr, r.integers(97, 123, r.integers(1, 6)))) for _ in range(n))
    p50, p51, p90, hot = prose(50), prose(51), prose(90), prose(70)
    assert len(p90) < 400
    texts = [f"{prose(30)} {p} {prose(40)}" for p in (p50, p50, p51)] + [f"{prose(5)}\n{p51.replace(' ', chr(10) + '  ')}\t{prose(9)}", p90, f"{prose(300)} {p90}"]
    texts += [" ".join([prose(60)] * 3), "the " * 500, prose(4000), None, "", "\xa0".join(["é"] * 60)]
    texts += [f"{prose(60)} {hot[i:]} {prose(60)}" for i in range(60)]
    rows = [*enumerate(texts), (7, texts[7]), (6, texts[6]), (100, prose(50)), (None, p51)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = substring_dedup.deduplicate(docs, large=large).collect()
    want = Counter(zip([d for d, _ in rows], brute_passage_words([(t or "").encode() for _, t in rows], 51), strict=True))
    assert Counter((x.doc_id, x.n_passage_words) for x in got) == want
    told = {x.doc_id: x for x in got}
    assert [told[i].n_passage_words for i in range(6)] == [0, 0, 51, 51, 90, 90]
    assert all(told[i].n_removed == 0 for i in range(6))
