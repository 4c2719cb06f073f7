"""An index that follows its table answers as a fresh one does."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import keyword_index
from larkspur.operators.keyword_index import KeywordIndex
from larkspur.operators.manifests import Conflict
from larkspur.operators.search import keyword
from larkspur.plans import search_queries

DDL = "id long, content string, topics array<string>, entities array<string>"
WORDS = "the cat sat on a mat and saw another cat near new york été ß".split()
QUERIES = [(["cat"], "any"), (["the", "cat"], "all"), (["cat", "sat"], "any"), (["new", "york"], "phrase"), (["absent"], "all"), (["cat", "absent"], "any"), (["a", "a"], "phrase")]


def row(r, i):
    return (i, " ".join(r.choice(WORDS) for _ in range(r.randint(0, 12))) or None, r.sample(["cat", "new york", "x"], r.randint(0, 2)), r.choice([None, [], ["Mat"]]))


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL)


def answers(index):
    out = [index.manifest()["n"], index.manifest()["size"], sorted(map(tuple, index.terms().collect())), sorted(map(tuple, index.rows().collect()))]
    return out + [sorted((r.id, round(r.score, 9)) for r in index.search(*q).collect()) for q in QUERIES]


def fresh(spark, rows, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / f"fresh-{random.random()}"))
    index.upsert(frame(spark, rows))
    return answers(index)


def test_follows_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword_index, "FANOUT", 3)
    r, rows = random.Random(2), {}
    index = KeywordIndex(spark, str(tmp_path / "index"))
    for step in range(7):
        changed = [row(r, i) for i in r.sample(range(40), 12)]
        gone = r.sample(range(40), 5) if step % 2 else []
        gone = [g for g in gone if g not in {c[0] for c in changed}]
        index.commit(frame(spark, changed), spark.createDataFrame([(g,) for g in gone], "id long") if gone else None)
        rows |= {c[0]: c for c in changed}
        rows = {i: x for i, x in rows.items() if i not in gone}
    segments = index.manifest()["segments"]
    assert len(segments) < 7 and max(s["level"] for s in segments) == 2 or len(segments) < 5
    want = fresh(spark, list(rows.values()), tmp_path)
    assert answers(index) == want
    index.merge()
    assert len(index.manifest()["segments"]) == 1 and not index.manifest()["segments"][0]["deletes"]
    assert answers(index) == want
    index.vacuum()
    assert answers(index) == want and len(list((tmp_path / "index").glob("segment-*"))) == 1


def test_scores_equal_a_scan(spark, tmp_path):
    rows = [row(random.Random(i), i)[:2] + ([], []) for i in range(50)]
    index = KeywordIndex(spark, str(tmp_path / "index"))
    index.upsert(frame(spark, rows))
    scan = keyword(frame(spark, rows).where("content is not null"), ["the", "cat"], "any")
    got = {x.id: x.score for x in index.search(["the", "cat"], "any").collect()}
    # Rows without content count in the index, so the scan is given them as empty texts.
    scan = {x.id: x.score for x in keyword(frame(spark, rows).withColumn("content", F.coalesce("content", F.lit(""))), ["the", "cat"], "any").collect()}
    assert got.keys() == scan.keys() and all(got[i] == pytest.approx(scan[i]) for i in got)


def test_sync_tokenises_only_what_differs(spark, tmp_path, monkeypatch):
    rows = [(i, f"note {i}", [], []) for i in range(20)]
    index = KeywordIndex(spark, str(tmp_path / "index"))
    index.sync(frame(spark, rows))
    seen = []
    original = keyword_index._tokenised
    monkeypatch.setattr(keyword_index, "_tokenised", lambda df: seen.append(df.count()) or original(df))
    rows[3] = (3, "changed note", [], [])
    index.sync(frame(spark, [*rows[:-2], (99, "added", [], [])]))
    assert seen == [2]
    assert sorted(r.id for r in index.rows().collect()) == [*range(18), 99]
    version = index.manifest()["version"]
    index.sync(frame(spark, [*rows[:-2], (99, "added", [], [])]))
    assert index.manifest()["version"] == version


def test_one_of_two_writers_wins(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "index"))
    index.upsert(frame(spark, [(1, "first", [], [])]))
    stale = index.manifest()
    index.upsert(frame(spark, [(2, "second", [], [])]))
    before = answers(index)
    other = KeywordIndex(spark, index.path)
    other.manifest = lambda: stale
    with pytest.raises(Conflict):
        other.upsert(frame(spark, [(3, "third", [], [])]))
    assert answers(index) == before


def test_queries_follow_their_table(spark, tmp_path):
    def write(n):
        rows = [(i, "the same note", "en", "src1", 13) for i in range(1, n)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))

    for n in (11, 16, 9):
        write(n)
        assert search_queries._keyword(spark, str(tmp_path), ["the"], "all").count() == n - 1


def test_empty(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "index"))
    assert index.search(["a"]).count() == 0
    index.upsert(frame(spark, []))
    index.delete(spark.createDataFrame([(1,)], "id long"))
    assert index.manifest()["version"] == 0 and index.rows().count() == 0
