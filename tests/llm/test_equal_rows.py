"""A third of the rows alike in id and text: no partition of a range order holds much more than another."""

import pytest
from pyspark.sql import functions as F

from larkspur.llm import packing, sharding
from larkspur.llm.huffman import read_ids, write_ids
from larkspur.llm.simhash import fingerprints_with_next
from larkspur.llm.token_ids import tokenizer_path


@pytest.fixture(scope="module")
def alike(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("alike") / "documents")
    rows = spark.range(9000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("text number "), "id")).otherwise("the same text").alias("text"), F.lit("s").alias("source"))
    rows.repartition(6).write.parquet(path)
    return spark.read.parquet(path)


def biggest(df):
    sizes = sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
    return sizes[-1] / sizes[len(sizes) // 2]


@pytest.fixture
def even(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_shards(spark, alike, even):
    placed = sharding._by_source(alike, 17)
    sizes = sorted(r["count"] for r in placed.groupBy("_part").count().collect())
    assert len(sizes) == 12 and sizes[-1] <= 2 * sizes[6]
    counts = [r["count"] for r in sharding.assign(alike, 7).groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1 and sum(counts) == 9000


def test_token_files_and_packing(spark, alike, even, tmp_path):
    tokenizer = tokenizer_path("word_bpe_49k.json")
    write_ids(alike, str(tmp_path / "ids"), tokenizer, 2)
    rows = sorted(r.n for r in spark.read.parquet(str(tmp_path / "ids")).select("part", F.size("doc_ids").alias("n")).groupBy("part").agg(F.sum("n").alias("n")).collect())
    assert rows[-1] <= 2 * rows[len(rows) // 2] and sum(rows) == 9000
    got = read_ids(spark, str(tmp_path / "ids"))
    ordered = got.orderBy("start").collect()
    assert [r.doc_id is None for r in ordered] == [True] * 3000 + [False] * 6000
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:], strict=False))
    pieces = packing.pack_documents(alike, tokenizer)
    assert pieces.agg(F.sum("length")).first()[0] == got.agg(F.sum("n_tokens")).first()[0]


def test_fingerprints(spark, alike, even):
    got = fingerprints_with_next(alike)
    assert got.count() == 9000 and got.where("doc_id is null").count() == 3000
    assert got.where("doc_id is null").select("fingerprint").distinct().count() == 1
