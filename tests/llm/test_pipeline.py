import corpus_pipeline as pipeline
import pytest

from larkspur.llm import pii
from larkspur.llm.common import written


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, f in pipeline.STAGES:
        out.append(written(f(spark, out[-1], sf_dir), name))
    return out


def test_stages_keep_the_columns_of_documents(stages):
    assert all(x.columns == stages[0].columns and x.dtypes == stages[0].dtypes for x in stages[:-1])


def test_filters_keep_rows_whole(stages):
    before = {r.doc_id: r for r in stages[0].collect()}
    for x in stages[1:3]:
        rows = x.collect()
        assert len({r.doc_id for r in rows}) == len(rows)
        assert all(before[r.doc_id] == r for r in rows)
        assert len(rows) >= 0.7 * len(before)


def test_exact_copies_are_gone(stages):
    texts = [r.text for r in stages[2].collect()]
    assert len(texts) == len(set(texts))


def test_masked_texts_hold_no_base_spans(stages):
    assert not any(pii.base_spans(r.text) for r in stages[4].collect())


def test_pieces_cover_what_was_kept(stages):
    kept = {r.doc_id for r in stages[4].collect()}
    pieces = stages[5].collect()
    assert {r.doc_id for r in pieces} == kept
    total = {}
    for r in pieces:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert all(total[r.doc_id] == r.doc_tokens for r in pieces)


def test_edges(spark, edge_docs, sf_dir):
    docs = edge_docs.select(*pipeline.COLUMNS)
    for name, f in pipeline.STAGES:
        docs = written(f(spark, docs, sf_dir), name)
    assert docs.count() > 0


def test_empty(spark, no_docs, sf_dir):
    docs = no_docs
    for name, f in pipeline.STAGES:
        docs = written(f(spark, docs, sf_dir), name)
    assert docs.count() == 0


def test_decisions_take_effect(spark, tmp_path):
    passage = " ".join(f"secret{i}" for i in range(12))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    words = " ".join(f"plain{i}" for i in range(60))
    docs = spark.createDataFrame(
        [(1, words, "en", "a", 1), (2, words, "en", "a", 1), (3, f"Before. {passage}, after mail a.b@example.com", "en", "a", 1), (4, None, "en", None, None), (5, "nothing to see", None, "a", 14)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    kept = pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]
    cut = {r.doc_id: r for r in pipeline.cut_benchmark(spark, docs, str(tmp_path)).collect()}
    assert cut[3].text == "Before. , after mail a.b@example.com" and cut[3].n_chars == len(cut[3].text)
    assert cut[1].text == words and cut[4].text is None and cut[4].n_chars is None and cut[5].text == "nothing to see"
    masked = {r.doc_id: r.text for r in pipeline.mask_personal_data(spark, docs, str(tmp_path)).collect()}
    assert masked[3] == f"Before. {passage}, after mail <EMAIL>" and masked[1] == words and masked[4] is None


def test_rows_that_share_or_lack_an_id(spark, tmp_path):
    text = {c: " ".join(f"{c}{i}" for i in range(200)) for c in "abcd"}
    near = text["a"] + " and a few more words"
    rows = [(1, text["a"]), (2, text["a"]), (2, text["b"]), (None, near), (None, text["c"]), (None, text["c"] + " end"), (3, text["d"]), (3, text["d"])]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text[0]) for r in pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()]
    assert sorted(kept, key=str) == sorted([(1, "a"), (2, "b"), (None, "c"), (3, "d")], key=str)


def test_near_copies_are_found_through_fingerprints(spark, tmp_path, monkeypatch):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join([*words, "and", "more"]), " ".join(words[::-1])]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = lambda: sorted(r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect())
    assert kept() == [0, 2]
    monkeypatch.setattr(pipeline.covering, "MOST_BITS", -1)  # no two fingerprints are near then
    assert kept() == [0, 1, 2]
