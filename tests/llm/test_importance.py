"""Importance resampling against a plain reading of its definition."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from larkspur.llm.importance import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, width, buckets):
    w = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(w[i : i + k]) for k in range(1, width + 1) for i in range(len(w) - k + 1)]
    return len(w), Counter(zlib.crc32(f.encode()) % buckets for f in runs)


def brute(docs, target, buckets, width, percent, least, seed):
    own = [(d, *features(t, width, buckets)) for d, t in docs]
    s, t = (sum((c for *_, c in x), Counter()) for x in (own, [features(t, width, buckets) for t in target]))
    all_s, all_t = s.total(), t.total()
    rows = []
    for doc, words, counts in own:
        gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in counts}
        n = counts.total()
        weight = sum(gain[b] * c for b, c in counts.items()) // n if n else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, words, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    could = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, -r[3], -r[2]))
    for i, r in enumerate(could[: len(could) * percent // 100]):
        r[5] = i + 1
    return sorted(map(str, rows))


def as_rows(df):
    return sorted(str(list(r)) for r in df.collect())


@pytest.mark.parametrize(("width", "buckets", "percent", "least"), [(2, 10000, 25, 20), (1, 7, 50, 1), (3, 1000, 100, 0)])
def test_brute_force(spark, edge_docs, edge_rows, width, buckets, percent, least):
    target = [(1, edge_rows[9][1]), (2, None), (3, "it's a word")]
    got = resample(edge_docs, spark.createDataFrame(target, "item_id long, text string"), buckets, width, percent, least, seed=7)
    assert as_rows(got) == brute([(r[0], r[1]) for r in edge_rows], [t for _, t in target], buckets, width, percent, least, 7)


def test_empty_tables(spark, no_docs, edge_docs, edge_rows):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert as_rows(resample(no_docs, edge_docs)) == []
    assert as_rows(resample(no_docs, nothing)) == []
    assert as_rows(resample(edge_docs, nothing)) == brute([(r[0], r[1]) for r in edge_rows], [], 10000, 2, 25, 20, 7)


def test_long_text_and_equal_rows(spark):
    rows = [(5, "ab cd ef " * 400_000)] + [(7, "one two three " * 9)] * 3000 + [(None, "one two three " * 9)] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = resample(docs, spark.createDataFrame([("cd ef",)], "text string"))
    assert as_rows(got) == brute(rows, ["cd ef"], 10000, 2, 25, 20, 7)
