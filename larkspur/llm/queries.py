"""The queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import scratch_path, table

WORD_TOKENIZER, BYTE_TOKENIZER = "word_bpe_49k.json", "byte_bpe_50k.json"
END_ID = 2
SHARDS = 40


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.pii import digests

    return digests(table(spark, sf_dir, "documents"))


def op2_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.huffman import read_ids, write_ids
    from larkspur.llm.token_ids import tokenizer_path

    path = scratch_path(spark, "token-files")
    write_ids(table(spark, sf_dir, "documents"), path, tokenizer_path(WORD_TOKENIZER), END_ID)
    return read_ids(spark, path)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.token_counts import token_counts
    from larkspur.llm.token_ids import tokenizer_path

    counted = token_counts(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.packing import pack_documents
    from larkspur.llm.token_ids import tokenizer_path

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER), END_ID, 4096)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.covering import hexed, near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2).select("doc_id", hexed().alias("fingerprint"), "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["b"] - x["a"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.toxicity import scores, train_split

    scored = scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(~train_split(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.sharding import assign

    return assign(table(spark, sf_dir, "documents"), SHARDS).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.substring_dedup import deduplicate

    return deduplicate(table(spark, sf_dir, "documents")).withColumn("has_repeat", F.col("n_removed") > 0)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.simhash import fingerprints_with_next

    return fingerprints_with_next(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.importance import resample

    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), buckets=10000, width=2, percent=25, least_words=20, seed=7)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.cosine_links import cosine_links

    return cosine_links(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label"), 0.98)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.spelling import variants

    return variants(table(spark, sf_dir, "documents"), every=97, least_chars=5, least_count=3, times=2)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_huffman_ids, op3_token_counts, op4_packing, op5_near_duplicates, op6_decontamination, op7_toxicity, op8_interleaved_shards, op9_repeated_substrings, op10_fingerprints, op11_importance_resampling, op12_embedding_links, op13_spelling_variants, pipeline)
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: CRC-32 in SQL: the table of its 256 bytes, and the checksum of a text by it.
_CRC_TABLE = "crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"
_RUNS = "unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))"


def _crc32(text: str) -> str:
    octets = f"list_transform(range(strlen({text})), lambda j: CAST('0x' || substr(hex({text}), 2 * j + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


#: Where SQL can express a query; the others are tested against brute force, round trips or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op6_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS phrase FROM b, range(1, 100000) t(i) WHERE len(w) > 0 AND i <= greatest(1, len(w) - 9)),
sizes AS (SELECT DISTINCT size FROM p),
x AS (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT DISTINCT r, i, x.size, item FROM x JOIN p ON x.phrase = p.phrase AND x.size = p.size),
h AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(i, i + size)) AS place FROM m) GROUP BY r),
n AS (SELECT r, count(DISTINCT item) AS n, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(n.n, 0) AS n_items, sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN n ON d.r = n.r""",
    "op11_importance_resampling": f"""
WITH {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS r, {_WORDS} AS w FROM benchmark),
runs AS (SELECT 'd' AS side, r, {_RUNS} AS f FROM d UNION ALL SELECT 'b', r, {_RUNS} FROM b),
hashed AS (SELECT f, {_crc32('f')} % 10000 AS bucket FROM (SELECT DISTINCT f FROM runs), crc_table),
counted AS (SELECT side, r, bucket, count(*) AS n FROM runs JOIN hashed USING (f) GROUP BY ALL),
buckets AS (SELECT i AS bucket, coalesce(sum(n) FILTER (WHERE side = 'd'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (WHERE side = 'b'), 0)::BIGINT AS t FROM range(10000) x(i) LEFT JOIN counted ON bucket = i GROUP BY i),
gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (sum(s) OVER () + 10000) AS DOUBLE) / CAST((s + 1) * (sum(t) OVER () + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM buckets),
weights AS (SELECT r, sum(n)::BIGINT AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight FROM counted JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (SELECT r, doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN weights USING (r)),
places AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, weight DESC, n_features DESC) AS rank, count(*) OVER () * 25 // 100 AS drawn FROM scored WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM scored LEFT JOIN places USING (r)""",
    "op13_spelling_variants": f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS name, run, count(*) AS c FROM runs WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (SELECT run, c, {_crc32('name')} AS h FROM counted, crc_table),
words AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(c) AS BIGINT) AS n FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(c) >= 3),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
less AS (SELECT DISTINCT c.word, c.n, w.word AS other, w.n AS other_n FROM cuts c JOIN words w ON w.word = c.a || c.b),
near AS (SELECT x.word, y.word AS other, y.n FROM cuts x JOIN cuts y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word UNION ALL SELECT word, other, other_n FROM less UNION ALL SELECT other, word, n FROM less),
best AS (SELECT word, count(*) AS n_near, max(n) AS near_n, arg_min(other, struct_pack(a := -n, b := other)) AS near FROM near GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
ways AS (SELECT word, word AS top, 0 AS depth FROM formed UNION ALL SELECT ways.word, form, depth + 1 FROM ways JOIN formed f ON ways.top = f.word WHERE form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN (SELECT word, arg_max(top, depth) AS root FROM ways GROUP BY word) r ON f.word = r.word""",
    "op12_embedding_links": """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.label = b.label AND a.r <> b.r WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reach AS (SELECT r, r AS other FROM v UNION SELECT reach.r, b FROM reach JOIN links ON other = a),
least AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON other = v.r GROUP BY reach.r),
counts AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN least USING (r) LEFT JOIN counts USING (r)""",
}
