"""The pinned store: refusals, resumed re-embedding, migration."""

import pytest
from pyspark.sql import functions as F

from larkspur.operators.vector_store import Refused, VectorStore
from larkspur.sources.readers import embed_hashed


def rows(spark, n, size=4, start=0):
    return spark.range(start, start + n).select("id", F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: ((F.col("id") * 7 + i) % 11 / 10.0)).cast("array<float>").alias("vector"))


def held(store):
    return sorted((r.id, tuple(r.vector)) for r in store.read().collect())


def test_the_pin_refuses(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "s"))
    assert store.pin() is None and store.read().isEmpty()
    store.check("any", 9)
    store.upsert(rows(spark, 5), "model", 4)
    store.upsert(rows(spark, 2, start=4), "model", 4)
    before = held(store)
    assert len(before) == 6 and store.pin() == {"model": "model", "size": 4}
    broken = [rows(spark, 1, 3), rows(spark, 1).unionByName(rows(spark, 1)), spark.createDataFrame([(1, None)], "id long, vector array<float>"), spark.createDataFrame([(None, [1.0] * 4)], "id long, vector array<float>")]
    for df in broken:
        with pytest.raises(Refused):
            store.upsert(df, "model", 4)
    with pytest.raises(Refused, match="re-embed"):
        store.upsert(rows(spark, 1), "other", 4)
    with pytest.raises(Refused):
        store.upsert(rows(spark, 1, 8), "model", 8)
    assert held(store) == before
    store.delete(spark.createDataFrame([(0,), (77,)], "id long"))
    assert held(store) == before[1:]


def test_a_resumed_job_equals_a_whole_one(spark, tmp_path):
    memories = spark.range(60).select("id", F.concat(F.lit("note number "), "id").alias("content"))
    store, whole = VectorStore(spark, str(tmp_path / "s")), VectorStore(spark, str(tmp_path / "w"))
    store.upsert(rows(spark, 60), "old", 4)
    before = held(store)

    def failing(text):
        return F.when(text.endswith("7"), F.raise_error(F.lit("model is down")).cast("array<float>")).otherwise(embed_hashed(text, 8))

    first = store.reembed(memories, failing, "new", 8, batches=12)
    assert first.failed and first.written and not first.switched
    assert held(store) == before and store.pin()["model"] == "old"  # nothing is visible
    second = store.reembed(memories, lambda t: embed_hashed(t, 8), "new", 8, batches=12)
    assert second.switched and second.skipped == 12 - first.failed and second.written == 60 - first.written
    assert whole.reembed(memories, lambda t: embed_hashed(t, 8), "new", 8, batches=5).switched
    assert held(store) == held(whole) and store.pin() == {"model": "new", "size": 8} == whole.pin()
    store.upsert(rows(spark, 1, 8, 100), "new", 8)
    assert len(held(store)) == 61


def test_vectors_of_another_size_fail_their_batch(spark, tmp_path):
    memories = spark.range(10).select("id", F.lit("x").alias("content"))
    store = VectorStore(spark, str(tmp_path / "s"))
    report = store.reembed(memories, lambda t: embed_hashed(t, 8), "new", 16, batches=2)
    assert report.failed == 2 and not report.switched and store.pin() is None


def test_memories_that_change_during_a_job(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "s"))
    memories = spark.range(20).select("id", F.lit("x").alias("content"))
    store._run("reembed-new-8-2", lambda i: rows(spark, 30, 8).where(F.pmod(F.xxhash64("id"), F.lit(2)) == i), 1, 8)
    with pytest.raises(Refused, match="changed"):
        store.reembed(memories, lambda t: embed_hashed(t, 8), "new", 8, batches=2)


def test_migration(spark, tmp_path):
    source, target = VectorStore(spark, str(tmp_path / "a")), VectorStore(spark, str(tmp_path / "b"))
    assert target.migrate_from(source, spark.range(5)).total == 0
    source.upsert(rows(spark, 20), "model", 4)
    memories = spark.range(18)
    dry = target.migrate_from(source, memories, dry_run=True)
    assert (dry.total, dry.orphans, dry.written, dry.switched) == (18, 2, 0, False) and target.read().isEmpty() and target.pin() is None
    report = target.migrate_from(source, memories, batches=3)
    assert (report.written, report.orphans, report.switched) == (18, 2, True)
    assert held(target) == [x for x in held(source) if x[0] < 18] and target.pin() == source.pin() and len(held(source)) == 20
    source.upsert(rows(spark, 1, start=5).withColumn("vector", F.array(*[F.lit(9.0)] * 4)), "model", 4)
    before = held(target)
    with pytest.raises(Refused, match="already contains 18"):
        target.migrate_from(source, memories)
    assert held(target) == before
    target.upsert(rows(spark, 1, start=500), "model", 4)
    assert target.migrate_from(source, memories, force=True).switched
    assert dict(held(target))[5] == (9.0,) * 4 and 500 in dict(held(target)) and len(held(target)) == 19


def test_a_killed_migration_goes_on(spark, tmp_path, monkeypatch):
    source, target = VectorStore(spark, str(tmp_path / "a")), VectorStore(spark, str(tmp_path / "b"))
    source.upsert(rows(spark, 20), "model", 4)
    import larkspur.operators.vector_store as module

    original, calls = module.rename_new, []

    def killed(*args):
        calls.append(args)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return original(*args)

    monkeypatch.setattr(module, "rename_new", killed)
    with pytest.raises(KeyboardInterrupt):
        target.migrate_from(source, spark.range(20), batches=5)
    assert target.read().isEmpty()
    monkeypatch.setattr(module, "rename_new", original)
    report = target.migrate_from(source, spark.range(20), batches=5)
    assert report.skipped == 2 and report.switched and held(target) == held(source)
