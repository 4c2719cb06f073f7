import numpy as np
import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import briefing, dedup, exchanges, facts, graph, search, skew, store
from larkspur.operators.components import components


def vectors(spark, n, seed):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([(i, r.normal(size=6).tolist()) for i in range(n)] + [(None, [1.0] * 6), (n, None), (n + 1, [0.0] * 6)], "id long, vector array<double>")


@pytest.mark.parametrize("block", [7, 8192])
def test_similar_pairs(spark, block):
    a, b = vectors(spark, 30, 1), vectors(spark, 40, 2)
    got = {(r.a, r.b) for r in dedup.similar_pairs(a, b, 0.6, block).collect()}
    unit = lambda v: np.asarray(v) / np.linalg.norm(v)
    x, y = ([(r.id, unit(r.vector)) for r in df.collect() if r.id is not None and r.vector and any(r.vector)] for df in (a, b))
    assert got == {(i, j) for i, v in x for j, w in y if i != j and v @ w >= 0.6}


def likeness(x, y):
    return float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y) or 1))


@pytest.mark.parametrize(("block", "bits", "part"), [(7, 64, 5), (40, 512, 16384), (32768, 4096, 16384)])
def test_unlike_pairs(spark, monkeypatch, block, bits, part):
    """Rows of every size of word set, of one id twice, without vector, platform or words; with few bits most pairs meet their words."""
    monkeypatch.setattr(dedup, "SKETCH_BITS", bits)
    monkeypatch.setattr(dedup, "PART", part)
    r, g = random.Random(2), np.random.default_rng(2)
    v = [(i, g.normal(size=6).tolist()) for i in range(110)] + [(3, g.normal(size=6).tolist()), (120, [0.0] * 6), (121, None), (None, [1.0] * 6)]
    m = [(i, r.choice(["p", "q", None]), r.sample([f"w{k}" for k in range(40)], r.choice([0, 1, 5, 20, 30]))) for i in range(130)] + [(5, "r", ["w1", "w2"]), (6, "p", None), (None, "p", [])]
    m[8], m[9] = (8, "p", m[7][2]), (9, "q", m[7][2])
    vectors_, rows = spark.createDataFrame(v, "id long, vector array<double>"), spark.createDataFrame(m, "id long, platform string, words array<string>")
    got = sorted((x.a, x.b, round(x.score, 9)) for x in dedup.unlike_pairs(vectors_, rows, 0.3, 0.3, block).collect())
    full = [(i, x, p, set(w)) for i, x in v if i is not None and x for j, p, w in m if i == j and p and w is not None]
    want = [(a, b, round(s, 9)) for a, x, p, t in full for b, y, q, u in full if a < b and p != q and (s := likeness(x, y)) >= 0.3 and len(t & u) / max(1, len(t | u)) < 0.3]
    assert got == sorted(want) and len(want) > 300


@pytest.mark.parametrize("name", ["d8_cross_platform_flags", "d9_details"])
def test_no_text_is_joined_with_pairs(spark, sf_dir, name):
    from larkspur.plans import catalog

    found = catalog.QUERIES[name](spark, sf_dir)
    assert "text#" not in found._jdf.queryExecution().executedPlan().toString()
    assert "/near-pairs-" in "".join(found.inputFiles())


def test_greedy_merges(spark):
    pairs = spark.createDataFrame([(1, 2, 0.95), (2, 1, 0.95), (2, 3, 0.95), (3, 2, 0.95)], "a long, b long, score double")
    rows = spark.createDataFrame([(1, "p", 0.5, 1), (2, "p", 0.9, 2), (3, "p", 0.9, 3)], "id long, platform string, confidence double, created_minute long")
    assert {(r.kept, r.gone) for r in dedup.greedy_merges(pairs, rows).collect()} == {(3, 2)}


def test_greedy_merges_stay_in_their_platform(spark, sf_dir):
    from larkspur.plans import catalog, views

    platform = {r.id: r.platform for r in views.vectors(spark, sf_dir).select("id", "platform").collect()}
    found = catalog.QUERIES["d7_greedy_merges"](spark, sf_dir).collect()
    assert found and all(platform[r.kept] == platform[r.gone] for r in found)
    near = dedup.nearest_k(views.vectors(spark, sf_dir), views.vectors(spark, sf_dir), 5).where("score >= 0.4").select("a", "b", "score").collect()
    rows = [(r.id, r.platform, r.confidence, r.id) for r in views.vectors(spark, sf_dir).select("id", "platform", "confidence").collect()]
    assert sorted(map(tuple, found)) == greedy_by_turns(list(map(tuple, near)), rows)
    assert catalog.QUERIES["d9_report"](spark, sf_dir).first().merged == len(found)


def test_nearest_within_a_key(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.choice(["a", "a", "a", "b", None]), r.normal(size=5).tolist()) for i in range(120)] + [(500, "only", [1.0] * 5), (501, "b", None)]
    df = spark.createDataFrame([(i, None if k is None else str(k), v) for i, k, v in rows], "id long, key_ string, vector array<double>")
    left = df.where("id % 2 = 0")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows if v}
    for within, blocks in (("key_", 7), ("key_", 1000), (None, 50)):
        got = sorted((x.a, x["rank"], x.b) for x in dedup.nearest_k(left, df, 3, within, blocks).collect())
        want = []
        for i, k, v in rows:
            if i % 2 == 0 and v and (within is None or k is not None):
                near = sorted((j for j, kj, vj in rows if vj and j != i and (within is None or kj == k)), key=lambda j: (-round(float(unit[i] @ unit[j]), 12), j))[:3]
                want += [(i, n + 1, j) for n, j in enumerate(near)]
        assert got == sorted(want)


@pytest.mark.parametrize(("block", "held"), [(7, 50), (50, 4_000_000), (32768, 4_000_000)])
def test_nearest_above_equals_nearest(spark, monkeypatch, block, held):
    """With ties, one id twice, and vectors that are zero or null."""
    monkeypatch.setattr(dedup, "HELD", held)
    r = np.random.default_rng(8)
    rows = [(i, r.normal(size=4).round(1).tolist()) for i in range(140)] + [(200 + i, [1.0, 0.5, 0.0, -1.0]) for i in range(9)] + [(5, [1.0, 0.5, 0.0, -1.0]), (300, [0.0] * 4), (301, None), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    order = lambda found: sorted((x.a, x["rank"], x.b, round(x.score, 9)) for x in found.collect())
    assert order(dedup.nearest_above(df, 5, 0.7, block)) == order(dedup.nearest_k(df, df, 5).where("score >= 0.7"))


def test_merges_meet_every_two_blocks_once(spark, sf_dir, monkeypatch):
    from larkspur.plans import catalog

    met = []
    whole = dedup._meeting
    monkeypatch.setattr(dedup, "_meeting", lambda *a: met.append(a[1]) or whole(*a))
    monkeypatch.setattr(dedup, "nearest_k", None)
    assert not catalog.QUERIES["d7_greedy_merges"](spark, sf_dir).isEmpty()
    assert met == [spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()]


def test_report_needs_no_twofold_joins(spark, sf_dir, monkeypatch):
    """Merged and flagged are the rows of their own queries, and come from blocks that meet once."""
    from larkspur.plans import catalog

    monkeypatch.setattr(dedup, "nearest_k", None)
    monkeypatch.setattr(dedup, "similar_pairs", None)
    row = catalog.QUERIES["d9_report"](spark, sf_dir).first()
    assert row.flagged == catalog.QUERIES["d8_cross_platform_flags"](spark, sf_dir).count() > 0


def greedy_by_turns(pairs, rows):
    info = {i: (p, c, m) for i, p, c, m in rows}
    gone, out = set(), []
    for i in sorted(info, key=lambda i: (-info[i][2], i)):
        if i in gone:
            continue
        for a, b, _ in sorted((x for x in pairs if x[0] == i), key=lambda x: (-x[2], x[1])):
            if a != b and b in info and b not in gone and info[a][0] == info[b][0]:
                out.append((a, b) if info[a][1] >= info[b][1] else (b, a))
                gone.add(out[-1][1])
    return sorted(out)


@pytest.mark.parametrize("walked", [0, 40, None])
def test_greedy_merges_equal_the_walk(spark, walked):
    for seed in range(2):
        r = random.Random(seed)
        rows = [(i, f"p{r.randrange(2)}", r.choice([0.5, 0.7, 0.9]), r.randrange(30)) for i in range(90)]
        pairs = [(a, b, r.choice([0.93, 0.95, 0.99])) for a in range(90) for b in r.sample(range(95), 4)] + [(7, b, 0.94) for b in range(60)]
        pairs = list({(a, b): (a, b, s) for a, b, s in pairs}.values())
        got = dedup.greedy_merges(spark.createDataFrame(pairs, "a long, b long, score double"), spark.createDataFrame(rows, "id long, platform string, confidence double, created_minute long"), walked)
        assert sorted(map(tuple, got.collect())) == greedy_by_turns(pairs, rows)



def test_diverse_selection_keeps_pins_and_avoids_likeness(spark):
    rows = [(1, 1.0, False, [1.0, 0.0]), (2, 0.9, False, [1.0, 0.0]), (3, 0.5, False, [0.0, 1.0]), (4, 0.1, True, None)]
    df = spark.createDataFrame(rows, "id long, score double, is_pinned boolean, vector array<double>")
    assert {r.id for r in briefing.select_diverse(df, 3).collect()} == {1, 3, 4}


@pytest.mark.parametrize("pins", [3, 320])
def test_diverse_selection_over_all_rows(spark, pins):
    """More pins than 300, and a row far down the scores that only diversity brings in."""
    r = np.random.default_rng(3)
    rows = [(i, 0.1, True, r.normal(size=4).tolist() + [0.0]) for i in range(pins)]
    rows += [(1000 + i, 0.9 - i / 1e5, False, rows[0][3]) for i in range(400)] + [(5000, 0.5, False, [0.0] * 4 + [1.0]), (5001, 0.0, False, None)]
    df = spark.createDataFrame(rows, "id long, score double, is_pinned boolean, vector array<double>")
    want = set(range(pins)) | {5000}
    got = [x.id for x in briefing.select_diverse(df, pins + 1).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {x.id for x in briefing.select_diverse(df, 2).collect()} == set(range(pins))


def test_metrics(spark):
    recall, mrr, precision = briefing.metrics(F.col("f"), F.col("g"), 3)
    df = spark.createDataFrame([(["x", "a", "a"], ["a"]), (["x"], []), ([], ["a"])], "f array<string>, g array<string>")
    assert [tuple(r) for r in df.select(recall, F.round(mrr, 3), F.round(precision, 3)).collect()] == [(1.0, 0.5, 0.667), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]
    with pytest.raises(ValueError):
        briefing.metrics(F.col("f"), F.col("g"), 0)


def test_cosine_of_odd_vectors(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0]), ([0.0], [1.0]), (None, [1.0]), ([2.0], [3.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(search.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 0.0, 1.0]


def test_hybrid_scores(spark):
    m = spark.createDataFrame([(1, 1.0, 0.0), (2, 0.5, 90.0)], "id long, importance double, age_days double")
    semantic = spark.createDataFrame([(1, 0.9), (2, 0.8)], "id long, score double")
    words = spark.createDataFrame([(2, 5.0)], "id long, score double")
    got = {r.id: r.score for r in search.hybrid(m, semantic, words, m.where("id = 3").select("id"), 5).collect()}
    assert got == {1: 1.0, 2: round((1 / 62 + 1 / 61) * 0.25 / (1 / 61), 4)}


def test_neighbours_exclude_the_start(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("a", "c", 1)], "a string, b string, weight long")
    start = spark.createDataFrame([("a",)], "name string")
    assert {(r.name, r.depth) for r in graph.neighbours(edges, start, 2).collect()} == {("b", 1), ("c", 1), ("d", 2)}


def test_windows_of_facts_are_inclusive(spark):
    df = spark.createDataFrame([("2024-01-01", "2024-01-31"), (None, "2024-01-31"), ("2024-02-01", None)], "f string, t string").select(F.col("f").cast("date").alias("valid_from"), F.col("t").cast("date").alias("valid_to"))
    count = lambda day: df.where(facts.valid_at(F.lit(day).cast("date"))).count()
    assert [count(d) for d in ("2023-12-31", "2024-01-31", "2024-02-01")] == [1, 2, 1]


def test_upsert_and_filters(spark):
    base = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "id long, v string, version int")
    new = spark.createDataFrame([(2, "z", 2), (3, None, 1)], "id long, v string, version int")
    assert {tuple(r) for r in store.upsert(base, new).collect()} == {(1, "x", 1), (2, "z", 2), (3, None, 1)}
    f = store.SessionFilter(["a"], min_confidence=0.5).overridden(include_sources=["b"])
    assert f.include_sources == ["b"] and f.min_confidence == 0.5


@pytest.mark.parametrize("hot_keys", [1, 4, 1000])
def test_counted_join_equals_a_plain_one(spark, monkeypatch, hot_keys):
    monkeypatch.setattr(skew, "HOT_KEYS", hot_keys)
    rows = spark.createDataFrame([(None if i % 29 == 0 else 0 if i % 3 else i % 17, i) for i in range(600)], "k long, i long")
    keys = rows.where("k % 2 = 0").groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("m"))
    got = skew.join_counted(rows, keys, ["k"], rows.count())
    assert got.columns == ["k", "i", "m"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(keys.drop("n"), "k").collect()))
    assert skew.join_counted(rows.limit(0), keys.limit(0), ["k"], 0).isEmpty()


def test_components_with_a_hub_and_a_chain(spark):
    hub = [(5000, i) for i in range(100, 400)] + [(7, 5000), (7, 7), (None, 3)]
    chain = [(i, i + 1) for i in range(6000, 6040)]
    pair = [(9001, 9000), (9000, 9001), (9001, 9000)]
    found = components(spark.createDataFrame(hub + chain + pair, "u long, v long"))
    got = {r.node: r.component for r in found.collect()}
    assert found.count() == len(got)
    assert got == {n: 7 for n in (7, 5000, *range(100, 400))} | {n: 6000 for n in range(6000, 6041)} | {9000: 9000, 9001: 9000}
    assert components(spark.createDataFrame([], "u long, v long")).isEmpty()


def test_log_summaries_of_short_lines(spark):
    """Chunks without a line of over 30 characters give no key point; conversations of such chunks alone give none at all."""
    long = "a line that is over thirty characters"
    rows = [(1, i, t) for i, t in enumerate([f"short\n  {long}  \n{long} two", "", "short", "x" * 30, None, long])] + [(2, i, "short") for i in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, exchange long, text string")
    got = {r.conv_id: r.summary for r in exchanges.log_summaries(df, F.array().cast("array<string>")).collect()}
    assert got == {1: f"Conversation with 6 exchanges.\n\nKey points:\n- {long}", 2: "Conversation with 3 exchanges."}
