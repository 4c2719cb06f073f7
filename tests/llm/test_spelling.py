"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from larkspur.llm import spelling
from larkspur.llm.spelling import Trie, variants


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        after = [i]
        for j, y in enumerate(b, 1):
            after.append(min(row[j] + 1, after[-1] + 1, row[j - 1] + (x != y)))
        row = after
    return row[-1]


def brute(docs, every=97, least_chars=5, least_count=3, times=2):
    counts = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_count}
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and distance(w, x) == 1] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= times * words[w] else None
    out = []
    for w in words:
        last = w
        while form[last]:
            last = form[last]
        out.append((w, form[w], last, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(map(str, out))


def rows(df):
    return sorted(str(tuple(r)) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("long", [0, 64])
@pytest.mark.parametrize("alphabet", ["ab", "abcé÷×ÿ", "aあ\U0001f600b"])
def test_trie(monkeypatch, alphabet, long):
    monkeypatch.setattr(spelling, "LONG", long)
    r = random.Random(3)
    words = {"".join(r.choice(alphabet) for _ in range(r.randint(1, 7))): r.randint(1, 9) for _ in range(80)}
    trie = Trie(*Trie.columns(words))
    for w in [*words, "", alphabet[0] * 9]:
        assert sorted(trie.near(w)) == sorted((x, n) for x, n in words.items() if distance(w, x) == 1)


@pytest.fixture(scope="module")
def spelt():
    r = random.Random(5)
    bases = ["".join(r.choice("abcdeéÿ÷") for _ in range(r.randint(4, 8))) for _ in range(60)]
    texts = []
    for _ in range(400):
        words = []
        for _ in range(30):
            w = bases[min(r.randrange(60), r.randrange(60))]
            if r.random() < 0.3:
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + "e" + w[at:], w[:at] + "E" + w[at + 1 :]])
            words.append(w)
        texts.append(r.choice([" ", ", ", "1", "–"]).join(words))
    return [(i % 390 or None, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("chars", "group"), [(1 << 20, 32 << 20), (300, 2000)])
def test_brute_force(spark, monkeypatch, spelt, edge_rows, chars, group):
    monkeypatch.setattr(spelling, "SHARD_CHARS", chars)
    monkeypatch.setattr(spelling, "GROUP_BYTES", group)
    docs = [(r[0], r[1]) for r in edge_rows] + spelt
    df = spark.createDataFrame([(*d, "k", 1, "f") for d in docs], "doc_id long, text string, word string, n long, form string").repartition(3)
    assert rows(variants(df)) == brute(docs)


def test_other_parameters(spark, spelt):
    df = spark.createDataFrame(spelt, "doc_id long, text string")
    assert rows(variants(df, 5, 3, 2, 3)) == brute(spelt, 5, 3, 2, 3)


def test_long_words_and_empty_tables(spark, no_docs):
    docs = [(1, " ".join(["a" * 50_000] * 3 + ["a" * 50_001] * 6 + ["a" * 49_999 + "b"] * 4))]
    got = variants(spark.createDataFrame(docs, "doc_id long, text string"))
    forms = {r.word: (r.form, r.root, r.n, r.n_near) for r in got.collect()}
    a = "a" * 50_000
    assert forms[a] == (a + "a", a + "a", 3, 2) and forms[a + "a"] == (None, a + "a", 6, 1)
    assert variants(no_docs).count() == 0 and variants(spark.createDataFrame([(1, None), (2, "abc")], "doc_id long, text string")).count() == 0
