from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from larkspur.llm import covering, sharding, simhash
from larkspur.operators.components import components


def brute_fingerprint(text, k=3):
    words = [w for w in (text or "").encode().lower().split()]
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(rows, radius):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, f"{f:016x}", least.get(root(i))) for i, (d, f) in enumerate(rows))


@pytest.mark.parametrize("which", ["edge_docs", "documents", "long_docs"])
def test_near_duplicates(which, request):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    got = covering.near_duplicates(docs).select("doc_id", covering.hexed(), "component_id").collect()
    assert Counter(tuple(r) for r in got) == brute_components(rows, 2)


@pytest.mark.parametrize("large", [1, 8192])
@pytest.mark.parametrize("radius", [1, 2, 3])
def test_no_link_is_lost(spark, radius, large):
    r = np.random.default_rng(radius)
    base = r.integers(0, 1 << 63, 12, dtype=np.int64)
    fps = {int(b) ^ int(sum(1 << int(i) for i in r.choice(62, r.integers(0, 4), replace=False))) for b in base for _ in range(12)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = components(covering.links(df, radius, large)).collect()
    want = brute_components([(i, f) for i, f in enumerate(sorted(fps))], radius)
    groups = Counter(c for _, _, c in want)
    assert sorted(x for x in Counter(r.component for r in got).values()) == sorted(n for n in groups.values() if n > 1)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_difference(radius):
    from itertools import combinations

    masks = covering.masks(radius)
    assert len(masks) == (1 << radius + 1) - 1
    for bits in combinations(range(0, 64, 3), radius):
        assert any(not any(m >> b & 1 for b in bits) for m in masks)


def test_empty(no_docs):
    assert covering.near_duplicates(no_docs).count() == 0
    assert simhash.fingerprints_with_next(no_docs).count() == 0
    assert sharding.assign(no_docs, 40).count() == 0


@pytest.mark.parametrize("which", ["edge_docs", "documents"])
def test_shards_match_the_mixture(which, request):
    docs = request.getfixturevalue(which)
    shards = 4
    rows = sharding.assign(docs, shards).collect()
    n = docs.count()
    assert len(rows) == n
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    for source in {r.source for r in rows}:
        per = Counter(r.shard for r in rows if r.source == source)
        share = sum(per.values()) / shards
        assert all(abs(per[s] - share) <= 2 for s in range(shards))


@pytest.mark.parametrize("which", ["edge_docs", "documents", "long_docs"])
def test_fingerprints_with_next(which, request):
    import hashlib

    docs = request.getfixturevalue(which)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = Counter()
    for i, (d, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        e = simhash.edited(t, following)
        a, b, c = (simhash.fingerprint(x) for x in (t, e, following))
        want[(d, len(t), hashlib.sha256(e.encode()).hexdigest(), f"{a:016x}", f"{b:016x}", simhash.likeness(a, b), simhash.likeness(a, c))] += 1
    assert Counter(tuple(r) for r in simhash.fingerprints_with_next(docs).collect()) == want


def test_block_tables_find_all(spark):
    r = np.random.default_rng(5)
    base = [int(x) for x in r.integers(-(1 << 63), 1 << 63, 60, dtype=np.int64)]
    fps = base + [b ^ int(sum(1 << int(i) for i in r.choice(62, k, replace=False))) for b in base for k in (1, 3, 4)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {(x.query, x.fp) for x in simhash.search(df, df.limit(20), 3).collect()}
    queries = [x.fp for x in df.limit(20).collect()]
    mask = (1 << 64) - 1
    assert got == {(q, f) for q in queries for f in fps if ((q ^ f) & mask).bit_count() <= 3}


def jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("large", [8192, 3])
def test_similar_documents(spark, large):
    r = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    texts, of = [], []
    for g in range(40):
        base = list(r.choice(words, 300))
        for edits in (0, 0, 1, 3, 5):
            t = list(base)
            for i in r.choice(300, edits, replace=False):
                t[i] = str(r.choice(words))
            texts.append(" ".join(t))
            of.append(g)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "x"), (900, None), (901, "")], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in covering.similar_documents(df, large=large).collect()}
    assert len(got) == len(texts) + 2 and got[901] == got[900] == 900
    for i, g in enumerate(of):
        assert of[got[i]] == g  # unlike texts stay apart
    missed = sum(got[i] != 5 * of[i] for i in range(len(texts)) if jaccard(texts[i], texts[5 * of[i]]) >= 0.85)
    assert missed <= 4


def test_isolated_pairs_are_found_from_the_bound_up(spark):
    """Groups of two, of similarity just over 0.8, and pairs just under it."""
    r = np.random.default_rng(9)
    rows, want = [], {}
    for g in range(600):
        base = [f"w{x}" for x in r.integers(0, 1 << 30, 400)]
        # e edits cost 5 e of 396 shingles: 8 edits are 0.816, 9 are 0.795
        copy = list(base)
        for e in range(8 if g % 2 else 9):
            copy[20 + 40 * e] = f"x{g}-{e}"
        a, b = " ".join(base), " ".join(copy)
        assert (jaccard(a, b) >= 0.8) == bool(g % 2)
        rows += [(2 * g, a), (2 * g + 1, b)]
        want |= {2 * g: 2 * g, 2 * g + 1: 2 * g if g % 2 else 2 * g + 1}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in covering.similar_documents(df).collect()} == want


def test_repeated_lines_and_templates_link_nothing(spark):
    """One line that stands twenty times in unlike texts, and long shared passages."""
    r = np.random.default_rng(10)
    fresh = lambda n: [f"w{x}" for x in r.integers(0, 1 << 40, n)]
    line, passage = fresh(14), fresh(140)
    texts = [" ".join(fresh(204) + line * 20) for _ in range(50)] + [" ".join(passage + fresh(40)) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(x.doc_id == x.component_id for x in covering.similar_documents(df).collect())


@pytest.mark.parametrize("large", [8192, 3])
def test_prints_near_in_a_block_are_joined(spark, large):
    """Prints whose blocks differ in one bit at most meet, whatever the size of their bucket."""
    r = np.random.default_rng(11)
    blocks, bits = 3, 6
    base = r.integers(0, 256, (8, covering.PRINT_BITS // 8), np.uint8)
    rows, prints, numbers = [], [], []
    for i in range(120):
        x = np.unpackbits(base[i % 8])
        x[r.choice(len(x), r.integers(0, 40), replace=False)] ^= 1
        prints.append(x)
        numbers.append(r.integers(0, 1 << bits, blocks, np.uint32))
        rows.append((i, np.packbits(x).tobytes(), numbers[-1].tobytes()))
    df = spark.createDataFrame(rows, "node long, print binary, blocks binary")
    group = {x.node: x.component for x in components(covering.print_links(df, bits, 45, large)).collect()}
    close = [[(prints[i] != prints[j]).sum() <= 45 for j in range(120)] for i in range(120)]
    met = [(i, j) for i in range(120) for j in range(i) if close[i][j] and np.bitwise_count(numbers[i] ^ numbers[j]).min() <= covering.BLOCK_RADIUS]
    assert len(met) > 50
    assert all(group[i] == group[j] for i, j in met)
    assert all(i % 8 == c % 8 for i, c in group.items())


@pytest.mark.parametrize("count", [1, 50_000])
def test_blocks_leave_no_pair_at_the_bound_apart(count):
    r = np.random.default_rng(12)
    blocks, bits = covering.block_plan(count)
    differs = r.random((20_000, blocks, bits)) < np.arccos(1.6 / 1.8) / np.pi
    cover = np.array([[m >> b & 1 for b in range(bits)] for m in covering.masks(covering.BLOCK_RADIUS, bits)])
    assert ((differs @ cover.T) == 0).any((1, 2)).all()


def test_wide_majority():
    r = np.random.default_rng(13)
    hashes = r.integers(0, 1 << 64, 600, np.uint64)
    one = np.array([covering.wide_majority(hashes[i : i + 1], 200) for i in range(600)])
    assert (covering.wide_majority(hashes, 200) == (one.sum(0) > 300)).all()
    assert not covering.wide_majority(hashes[:0], 200).any()
