import zlib

import numpy as np
import pytest

from larkspur.llm import toxicity

KINDS = "doc_id long, quality int, toxic int"


def test_label_model_finds_the_reliable_voters():
    r = np.random.default_rng(0)
    y = r.random(3000) < 0.2
    votes = np.stack([np.where(r.random(3000) < a, np.where(y, 1, -1), np.where(y, -1, 1)) for a in (0.95, 0.9, 0.9, 0.55)] + [np.zeros(3000, int)], 1)
    votes = np.concatenate([votes, votes[:, [3]], votes[:, [3]]], 1)  # copies of a poor voter
    p = toxicity.label_model(votes, np.ones(3000))
    assert ((p > 0.5) == y).mean() > 0.95


def test_linear_classifier():
    r = np.random.default_rng(1)
    rows = [np.flatnonzero(r.random(6) < 0.4) for _ in range(600)]
    target = np.array([float(2 in x) for x in rows])
    w, b = toxicity.linear(rows, target, np.ones(600), 6)
    assert all((w[x].sum() + b > 0) == bool(t) for x, t in zip(rows, target, strict=True))


def test_held_out_rows_are_classified(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = {r.doc_id: r.score for r in toxicity.scores(docs, labels).collect()}
    held = [(r.toxic, got[r.doc_id]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    hits = sum(t == 1 and s >= 0.5 for t, s in held)
    assert hits >= 0.85 * sum(t for t, _ in held)
    assert sum(t == 0 and s >= 0.5 for t, s in held) <= 0.01 * len(held)
    assert len(got) == docs.count()


def test_held_out_labels_have_no_effect(spark, documents):
    labels = [(i, 1, int(i % 3 == 0)) for i in range(150)]
    changed = [(i, q, 1 - t) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, t) for i, q, t in labels]
    a, b = ({r.doc_id: r.score for r in toxicity.scores(documents, spark.createDataFrame(x, KINDS)).collect()} for x in (labels, changed))
    assert a == b


@pytest.mark.parametrize("rows", [[], [(None, 1, 1), (1, None, None)], [(1, 0, 0), (2, 0, 0)], [(8, 0, 1), (8, 0, 0), (9, 1, 0), (10, None, 1), (11, 1, 0)]])
def test_edges(spark, edge_docs, rows):
    got = toxicity.scores(edge_docs, spark.createDataFrame(rows, KINDS)).collect()
    assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 for r in got)


def test_without_labels_the_lexicon_decides(spark):
    docs = spark.createDataFrame([(1, "you stupid idiot"), (2, "a fine day"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.score >= 0.5 for r in toxicity.scores(docs, spark.createDataFrame([], KINDS)).collect()} == {1: True, 2: False, 3: False}


def test_empty(spark, no_docs):
    assert toxicity.scores(no_docs, spark.createDataFrame([], KINDS)).count() == 0


def test_long_texts(spark, long_docs):
    got = {r.doc_id: r.score for r in toxicity.scores(long_docs, spark.createDataFrame([], KINDS)).collect()}
    assert len(got) == 6 and got[0] == got[5] and all(0 <= x <= 1 for x in got.values())
