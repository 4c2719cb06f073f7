"""Cosine links against all pairs."""

import numpy as np
import pytest

from larkspur.llm import cosine_links as C

DDL = "vec_id long, vector array<double>, label int, cid long, core long, n long"


def brute(rows, cosine):
    good = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    scaled = {i: np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in good}
    unit = {i: x / np.linalg.norm(x) for i, x in scaled.items()}
    links = {i: [] for i in range(len(rows))}
    for i in good:
        for j in good:
            if i != j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i].append(j)
    out = []
    for i, (vec, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            more = [j for j in links[todo.pop()] if j not in seen]
            seen.update(more)
            todo += more
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((vec, len(links[i]), least, vec == least))
    return sorted(map(str, out))


def run(spark, rows, cosine=0.98, ddl=DDL):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], ddl).repartition(3)
    return sorted(str(tuple(r)) for r in C.cosine_links(df, cosine).select("vec_id", "n_links", "component_id", "kept").collect())


def near(r, base, spread, n):
    size = np.linalg.norm(base) / np.sqrt(len(base))
    return [(base + r.standard_normal(len(base)) * size * spread).tolist() for _ in range(n)]


@pytest.fixture(scope="module")
def planted():
    r = np.random.default_rng(4)
    vectors = [(v, label) for label in (0, 1) for v in r.standard_normal((60, 24)).tolist()]
    for label, spread, n in ((0, 0.05, 40), (0, 0.12, 60), (1, 0.16, 50), (1, 0.1, 3), (1, 0.0, 30)):
        vectors += [(v, label) for v in near(r, r.standard_normal(24), spread, n)]
    walk = r.standard_normal(24)  # a chain whose ends are far apart
    for _ in range(30):
        walk = walk + r.standard_normal(24) * 0.15 * np.linalg.norm(walk) / np.sqrt(24)
        vectors.append((walk.tolist(), 0))
    vectors += [(vectors[0][0], 1), ([3 * x for x in vectors[0][0]], 0), ([1e-200 * x for x in vectors[0][0]], 0), (vectors[0][0][:7], 0), (vectors[0][0][:7], 0)]
    vectors += [(None, 0), ([0.0] * 24, 0), ([0.0] * 24, 0), ([None] * 24, 0), ([float("nan")] * 24, 0), ([float("inf")] * 24, 0), ([], 0), (vectors[1][0], None), (vectors[1][0], None)]
    order = r.permutation(len(vectors)).tolist()
    rows = [(order[i] * 3, *v) for i, v in enumerate(vectors)]
    return [*rows, rows[5], rows[130], (None, vectors[1][0], 0), (None, [1.0, 2.0], 9), (None, None, None)]


@pytest.mark.parametrize(("part", "cosine"), [(1024, 0.98), (7, 0.98), (1024, 0.9)])
def test_all_pairs(spark, monkeypatch, planted, part, cosine):
    monkeypatch.setattr(C, "PART_ROWS", part)
    assert run(spark, planted, cosine) == brute(planted, cosine)


def test_floats_and_empty(spark, planted):
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in planted[:200]]
    assert run(spark, single, ddl=DDL.replace("double", "float")) == brute(single, 0.98)
    assert run(spark, []) == []
    assert run(spark, [(1, None, 2), (2, [1.0], None)]) == brute([(1, None, 2), (2, [1.0], None)], 0.98)


def test_isolated_pairs_at_the_threshold(spark):
    """Of pairs just within the threshold in their own label none is lost, just beyond none is found."""
    r = np.random.default_rng(9)
    rows = []
    for i in range(600):
        a, b = r.standard_normal((2, 32))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = 0.98 + (1e-7 if i % 2 else -1e-7)
        rows += [(2 * i, a.tolist(), i % 3), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b).tolist(), i % 3)]
    got = {r.vec_id: r.n_links for r in C.cosine_links(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DDL)).collect()}
    assert all(got[2 * i] == got[2 * i + 1] == i % 2 for i in range(600))
