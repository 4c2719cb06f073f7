import random
from collections import Counter

import pytest

from larkspur.llm import token_counts
from larkspur.llm.token_ids import tokenizer_path

BYTES = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(BYTES))
    return lambda x: len(t.encode(x or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def compiled():
    return token_counts.counter(tokenizer_path(BYTES))


ALPHABET = ["a", "the", " ", "  ", "\n", "\t", "'s", "'", "'re", "1", "23", ".", "!!", "é", "日本", " ", " ", "\u0085", "\x1c", "<|endoftext|>", "<|", "ing", "ß", "😀", "́", "²", "ª"]


def test_counts_are_the_librarys(library, compiled):
    r = random.Random(1)
    for _ in range(1500):
        text = "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 30)))
        assert compiled.count(text.encode()) == library(text), text


def test_chunk_maps_compose(library, compiled):
    r = random.Random(2)
    for _ in range(400):
        text = "".join(r.choice(ALPHABET) for _ in range(r.randint(1, 40)))
        size = r.randint(1, 9)
        maps = [compiled.chunk(text[i : i + size].encode()) for i in range(0, len(text), size)]
        prefixes = compiled.prefix_scan(maps)
        assert compiled.whole(prefixes[-1]) == library(text), (text, size)
        assert compiled.whole(compiled.prefix_scan(compiled.joined(maps))[-1]) == library(text)
        k = r.randrange(len(maps))
        assert compiled.whole(prefixes[k]) == library(text[: (k + 1) * size])


@pytest.mark.parametrize(("which", "chunk"), [("edge_docs", 1 << 16), ("edge_docs", 700), ("documents", 1 << 16)])
def test_documents(which, chunk, library, request):
    docs = request.getfixturevalue(which)
    want = Counter((r.doc_id, len((r.text or "").encode()), library(r.text)) for r in docs.select("doc_id", "text").collect())
    assert Counter(tuple(r) for r in token_counts.token_counts(docs, tokenizer_path(BYTES), chunk).collect()) == want


def test_long_pre_tokens(library, compiled, monkeypatch):
    monkeypatch.setattr(token_counts, "LONG", 6)
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60)))
        words = [w for w in compiled.pre_tokens(text) if not compiled.special.search(w)]
        assert [compiled.transducer.run(w.encode()) for w in words] == [library(w) for w in words]


def test_unbroken_runs(spark, library):
    """Megabytes without white space, of letters, of one letter, and of letters and marks."""
    r = random.Random(4)
    texts = ["".join(r.choices("abcdefghij", k=4_000_000)), "z" * 1_000_000, "x.1日" * 300_000, "word " * 50_000 + "y" * 300_000 + " end" * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.n_tokens for x in token_counts.token_counts(docs, tokenizer_path(BYTES)).collect()}
    assert got == {i: library(t) for i, t in enumerate(texts)}


def test_empty(no_docs):
    assert token_counts.token_counts(no_docs, tokenizer_path(BYTES)).count() == 0
