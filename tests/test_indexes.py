"""The vector index and name matching against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import dedup, fuzzy, vector_index
from larkspur.operators.vector_index import VectorIndex, recall


@pytest.fixture(scope="module")
def clustered(spark):
    g = np.random.default_rng(3)
    centres = g.standard_normal((25, 16))
    v = [(int(i), (centres[g.integers(25)] + 0.3 * g.standard_normal(16)).tolist()) for i in g.permutation(1500)]
    v += [(2000, v[0][1]), (2001, [0.0] * 16), (2002, None), (None, v[1][1])]
    return spark.createDataFrame(v, "id long, vector array<double>").cache()


def rounded(df):
    return sorted((r.a, r.b, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("block", [4096, 50])
def test_exact_searches(spark, monkeypatch, clustered, block):
    monkeypatch.setattr(vector_index, "BLOCK", block)
    queries = clustered.where("id % 20 = 0")
    index = VectorIndex.build(clustered)
    assert index.rows.count() == 1502
    assert rounded(index.pairs(queries, 0.95)) == rounded(dedup.similar_pairs(queries, clustered, 0.95))
    exact = dedup.nearest_k(queries, clustered, 5)
    assert rounded(index.nearest(queries, 5)) == rounded(exact)
    assert rounded(index.nearest(queries, 5, probes=1)) == rounded(exact)


def test_a_query_is_sent_once_to_a_group_of_lists(spark, clustered, monkeypatch):
    """However many lists it must read: all pairs over -0.9 read all lists."""
    whole = clustered.where("id is not null and vector is not null and id <> 2001")
    index = VectorIndex.build(whole, lists=30)
    assert index._routed(whole, lambda angles, widest, _: angles > -1).count() == whole.count()
    monkeypatch.setattr(vector_index, "BLOCK", 400)
    n, _, group, parts = index._grouped()
    assert max(sum(n[group == g]) for g in set(group)) <= 400 and set(parts) == {1}
    assert index._routed(whole, lambda angles, widest, _: angles > -1).count() <= whole.count() * len(parts) and len(parts) < 9
    both = rounded(dedup.similar_pairs(whole, whole, -0.9))
    assert rounded(index.pairs(whole, -0.9)) == both
    assert rounded(index.pairs(whole, -0.9, later=True)) == [x for x in both if x[0] < x[1]]


def test_recall_of_probed_lists(spark, clustered, sf_dir):
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    for rows in (clustered.where("id is not null and vector is not null and id <> 2001"), embeddings):
        queries = rows.where("id % 20 = 0")
        index, exact = VectorIndex.build(rows), dedup.nearest_k(queries, rows, 10)
        assert recall(index.nearest(queries, 10, exact=False), exact).first().recall >= 0.9
    assert VectorIndex.build(clustered).probes < 20  # of 39 lists


def test_small_and_empty_tables(spark, clustered):
    none = VectorIndex.build(clustered.where("false"))
    assert none.pairs(clustered, 0.5).count() == 0
    one = VectorIndex.build(clustered.where("id = 3"))
    assert [(r.b, r["rank"]) for r in one.nearest(clustered.where("id = 5"), 4).collect()] == [(3, 1)]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        after = [i]
        for j, y in enumerate(b, 1):
            after.append(min(row[j] + 1, after[-1] + 1, row[j - 1] + (x != y)))
        row = after
    return row[-1]


@pytest.mark.parametrize(("least", "alphabet"), [(80, "abc"), (60, "abcdé"), (90, "ab")])
def test_alike_loses_no_pair(spark, least, alphabet):
    r = random.Random(least)
    word = lambda: "".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6, 8, 10, 13, 17, 24])))

    def edited(w):
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(w) + 1)
            w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice(alphabet) + w[at:], w[:at] + r.choice(alphabet) + w[at + 1 :]])
        return w

    variants = [word() for _ in range(60)]
    names = [edited(r.choice(variants)) for _ in range(120)]
    got = fuzzy.alike(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(v,) for v in variants], "variant string"), least)
    want = {(n, v, d) for n in names for v in variants if n and v and (d := levenshtein(n, v)) * 100 <= (100 - least) * max(len(n), len(v))}
    assert set(map(tuple, got.collect())) == want and len(want) > 30


def test_resolve_by_aliases(spark):
    known = spark.createDataFrame([(1, "PostgreSQL", ["postgres"]), (2, "Postgre SQL", None), (3, "Redis", [])], "entity long, name string, aliases array<string>")
    asked = spark.createDataFrame([(1, " postgress "), (2, "postgresql"), (3, "rediss"), (4, "mysql"), (5, ""), (6, None)], "key long, name string")
    got = {r.key: (r.entity, round(r.ratio, 3)) for r in fuzzy.resolve(asked, known).collect()}
    assert got == {1: (1, 0.889), 2: (1, 1.0), 3: (3, 0.833)}
