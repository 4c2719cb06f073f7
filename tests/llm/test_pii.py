import hashlib
import random
import re

import numpy as np
import pytest

from larkspur.llm import pii, tagger
from pii_sentences import SENTENCES

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")), "card": lambda d=digits: 14 <= len(d) <= 19 and pii.luhn(d), "phone": lambda d=digits: 10 <= len(d) <= 15}[kind]()
            if ok:
                out.append((m.start(), order, m.end(), kind))
    return [(a, b, k) for a, _, b, k in sorted(out)]


def test_base_spans_are_the_patterns():
    r = random.Random(3)
    pieces = ["a@b.c", "@", "x.y@z", ".com", "1.2.3.4", "256", "255.255.255.255", ".", "5", "4994226020900891", "4994 2260 2090 0891", "49-94", " ", "-", "+1 (743) 555-3824", "+", "(", "é", "a", "_%", "0000255", "+49 30 1234567890123"]
    for _ in range(4000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 9)))
        assert pii.base_spans(text) == brute(text), text


def test_long_texts_take_linear_time():
    for part in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a.b" * 60_000 + "@", "+1" * 80_000, "@" * 100_000, "1 - " * 50_000):
        pii.base_spans(part)


@pytest.fixture(scope="module")
def model():
    return pii.trained()


def test_held_out_accuracy(model):
    r = random.Random(99)
    made = [pii.example(r) for _ in range(300)]
    hit = wrong = missed = 0
    for (_, gold), e in zip(made, tagger.emissions(model, np.stack([tagger.symbols(t) for t, _ in made])), strict=True):
        a, b = set(tagger.spans(gold)), set(tagger.spans(tagger.viterbi(e, model["trans"])))
        hit, wrong, missed = hit + len(a & b), wrong + len(b - a), missed + len(a - b)
    assert hit / (hit + wrong) > 0.85 and hit / (hit + missed) > 0.85


def test_viterbi_is_the_best_path():
    from itertools import product

    r = np.random.default_rng(0)
    e, trans = r.normal(size=(4, tagger.TAGS)), r.normal(size=(tagger.TAGS, tagger.TAGS))
    full = trans + tagger.BLOCKED
    score = lambda p: tagger.START[p[0]] + sum(e[i, t] for i, t in enumerate(p)) + sum(full[a, b] for a, b in zip(p, p[1:], strict=False))
    assert tuple(tagger.viterbi(e, trans)) == max(product(range(tagger.TAGS), repeat=4), key=score)


def test_gradients():
    r = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in tagger.init(3).items()}
    ids, tags = r.integers(1, 100, (2, 6)), np.array([[0, 1, 2, 0, 3, 0], [0, 0, 5, 6, 6, 0]])
    _, grads = tagger._loss(p, ids, tags)
    for name in p:
        at = tuple(r.integers(0, n) for n in p[name].shape) if name != "embed" else (int(ids[0, 2]), 1)
        for sign in (1,):
            up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
            up[name][at] += 1e-3
            down[name][at] -= 1e-3
            slope = (tagger._loss(up, ids, tags)[0] - tagger._loss(down, ids, tags)[0]) / 2e-3 * sign
            assert abs(slope - grads[name][at]) < 2e-3 + 0.02 * abs(slope), name


@pytest.mark.parametrize("which", ["edge_docs", "documents"])
def test_documents(which, request, model):
    docs = request.getfixturevalue(which)
    want = sorted((str(r.doc_id), hashlib.sha256(pii.joined(brute(r.text)).encode()).hexdigest(), *(sum(s[2] == k for s in brute(r.text)) for k in BASE)) for r in docs.select("doc_id", "text").collect())
    got = pii.digests(docs).collect()
    assert sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == want
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect() if r.doc_id is not None}
    for r in got:
        if r.doc_id in texts:
            assert {pii.joined([s]) for s in brute(texts[r.doc_id])} <= set(r.spans.split(","))


def test_empty(no_docs):
    assert pii.digests(no_docs).count() == 0


def test_added_forms(model):
    texts = ["call (743) 555-3824 today", "card 4994.2260.2090.0891 ok", "nothing 12 here 3.5 at dot"]
    _, spans = pii.find(texts, model)
    assert [[(t[a:b], k) for a, b, k in s] for t, s in zip(texts, spans, strict=True)] == [[("(743) 555-3824", "phone")], [("4994.2260.2090.0891", "card")], []]


def test_masking():
    assert pii.masked("ab a@b.cd 12", [(3, 9, "email")]) == "ab <EMAIL> 12"
    assert pii.masked("abcdef", [(0, 3, "ip"), (2, 5, "card")]) == "<IP>f"


def accuracy(model):
    _, found = pii.find([t for t, _ in SENTENCES], model)
    hit = wrong = missed = 0
    for (text, want), spans in zip(SENTENCES, found, strict=True):
        got = {(text[a:b], k) for a, b, k in spans}
        hit, wrong, missed = hit + len(got & set(want)), wrong + len(got - set(want)), missed + len(set(want) - got)
    return hit, wrong, missed


def test_sentences_that_the_generator_did_not_make(model):
    hit, wrong, missed = accuracy(model)
    assert hit / (hit + wrong) >= 0.85 and hit / (hit + missed) >= 0.75, (hit, wrong, missed)


def test_long_regions_are_decoded_in_stretches_alike(model, monkeypatch):
    text = " ".join(f"row {i} call (743) 555-{1000 + i} or 12 34" for i in range(400))
    whole = pii.find([text], model)[1]
    monkeypatch.setattr(pii, "MOST", 512)
    assert pii.find([text], model)[1] == whole and len(whole[0]) > 300


def test_spans_lie_in_regions(model):
    """What reading whole texts finds beyond the regions, over texts without any change."""
    texts = [t for t, _ in SENTENCES]
    whole = pii.find(texts, model)[1]
    found = [[(t[a:b], k) for a, b, k in s] for t, s in zip(texts, whole, strict=True)]
    original = pii.regions
    try:
        pii.regions = lambda text: [(0, len(text))] if text else []
        all_of = [[(t[a:b], k) for a, b, k in s] for t, s in zip(texts, pii.find(texts, model)[1], strict=True)]
    finally:
        pii.regions = original
    assert sum(len(set(a) - set(b)) for a, b in zip(all_of, found, strict=True)) <= 1
