"""Search, similarity, graph, facts and briefing queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions import fixed, text
from larkspur.operators import briefing, dedup, exchanges, facts, fuzzy, graph, search
from larkspur.operators.keyword_index import KeywordIndex
from larkspur.operators.scratch import fingerprint, scratch_path, written
from larkspur.operators.store import active
from larkspur.plans.registry import query
from larkspur.plans.views import MEMORIES, TRIPLES, VECTORS, memories, table, triples, vectors

M = f"WITH {MEMORIES} "
V = f"WITH {VECTORS} "
MV = f"WITH {MEMORIES}, {VECTORS}"

# Keyword search ---------------------------------------------------------------

_WORDS = "list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


_TOPICS = "list_filter([" + ", ".join(f"'{t}'" for t in fixed.TOPICS) + "], lambda k: contains(lower(content), k))[1:10]"
_FIELDS = [_WORDS, _WORDS.replace("content", f"array_to_string({_TOPICS}, ' ')", 1), _WORDS.replace("content", "platform", 1)]


def _bm25(terms: list[str], mode: str, source: str = "memories WHERE status = 'active'") -> str:
    """Common table expressions that end in ``hits`` (id, score), over contents, topics and
    entities; a phrase is one term."""
    pairs = " + ".join(f"len(list_filter(range(1, len({f}) - {len(terms)} + 2), lambda i: {' AND '.join(f'{f}[i + {j}] = ' + repr(t) for j, t in enumerate(terms))}))" for f in ("w0", "w1", "w2"))
    counts = [pairs] if mode == "phrase" else [f"len(list_filter(w, lambda t: t = '{t}'))" for t in terms]
    tf = ", ".join(f"{c} AS tf{i}" for i, c in enumerate(counts))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(counts)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / avg_size))" for i in range(len(counts)))
    hit = (" OR " if mode == "any" else " AND ").join(f"tf{i} > 0" for i in range(len(counts)))
    return f"fields AS (SELECT id, {_FIELDS[0]} AS w0, {_FIELDS[1]} AS w1, {_FIELDS[2]} AS w2 FROM {source}), words AS (SELECT *, list_concat(list_concat(w0, w1), w2) AS w FROM fields), counted AS (SELECT id, len(w) AS size, {tf} FROM words), stats AS (SELECT count(*) AS n, avg(size) AS avg_size, {df} FROM counted), hits AS (SELECT id, {score} AS score FROM counted, stats WHERE {hit})"


_INDEXES: dict[tuple[str, str], tuple[tuple, KeywordIndex]] = {}


def _indexed(spark, d):
    """What the index holds of the active memories."""
    return active(memories(spark, d)).select("id", "content", text.topics(F.col("content")).alias("topics"), F.array("platform").alias("entities"))


def _keyword(spark, d, terms: list[str], mode: str):
    """Search in an index of the active memories that an application writes once for a folder
    and brings up to date when the files there change."""
    key, files = (spark.sparkContext.applicationId, d), fingerprint(spark, f"{d}/documents.parquet")
    known, index = _INDEXES.get(key, (None, None)) if key in _INDEXES else (None, KeywordIndex(spark, scratch_path(spark, "index")))
    if known != files:
        (index.sync if known else index.upsert)(_indexed(spark, d))
        _INDEXES[key] = (files, index)
    return index.search(terms, mode)


@query("r1_index_terms", M + f"SELECT term, count(*) AS n, count(DISTINCT id) AS docs FROM (SELECT id, unnest({_WORDS}) AS term FROM memories WHERE status = 'active') GROUP BY term HAVING count(DISTINCT id) > 5")
def index_terms(spark, d):
    """Builds an index of its own and reads the terms of all contents from it."""
    index = KeywordIndex(spark, scratch_path(spark, "fresh-index"))
    index.upsert(_indexed(spark, d))
    return index.terms().where("docs > 5")


_CHANGED = "WITH {0}, changed AS (SELECT id, CASE WHEN id % 7 = 3 THEN 'this the new note' ELSE content END AS content, platform FROM memories WHERE status = 'active' AND id % 11 <> 4)".format(MEMORIES)


@query("r1_index_after_changes", f"{_CHANGED}, {_bm25(['the', 'this'], 'all', 'changed')}, {_bm25(['new', 'note'], 'phrase', 'changed').replace('fields', 'fields2').replace('words', 'words2').replace('counted', 'counted2').replace('stats', 'stats2').replace('hits', 'hits2')} SELECT 'all' AS asked, id, round(score, 6) AS score FROM hits UNION ALL SELECT 'phrase', id, round(score, 6) FROM hits2")
def index_after_changes(spark, d):
    """An index filled in two commits, then changed, shrunk and partly merged, searched in place."""
    index, rows = KeywordIndex(spark, scratch_path(spark, "changing-index")), _indexed(spark, d)
    index.upsert(rows.where("id % 2 = 0"))
    index.upsert(rows.where("id % 2 = 1"))
    index.upsert(rows.where("id % 7 = 3").withColumn("content", F.lit("this the new note")).withColumn("topics", F.array().cast("array<string>")))
    index.merge(0, 2)
    index.delete(rows.where("id % 11 = 4").select("id"))
    out = [index.search(t, m).select(F.lit(m).alias("asked"), "id", F.round("score", 6).alias("score")) for t, m in ((["the", "this"], "all"), (["new", "note"], "phrase"))]
    return out[0].unionByName(out[1])


@query("r1_keyword_all", f"WITH {MEMORIES}, {_bm25(['the', 'this'], 'all')} SELECT id, round(score, 6) AS score FROM hits ORDER BY round(score, 6) DESC, id LIMIT 20")
def keyword_all(spark, d):
    found = _keyword(spark, d, ["the", "this"], "all")
    return found.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "id").limit(20)


@query("r1_keyword_any", f"WITH {MEMORIES}, {_bm25(['von', 'this'], 'any')} SELECT id, round(score, 6) AS score FROM hits")
def keyword_any(spark, d):
    return _keyword(spark, d, ["von", "this"], "any").withColumn("score", F.round("score", 6))


@query("r1_keyword_phrase", f"WITH {MEMORIES}, {_bm25(['of', 'the'], 'phrase')} SELECT id, round(score, 6) AS score FROM hits")
def keyword_phrase(spark, d):
    return _keyword(spark, d, ["of", "the"], "phrase").withColumn("score", F.round("score", 6))


@query("r1_phrase_fields", f"WITH {MEMORIES}, {_bm25(['machine', 'learning'], 'phrase')}, {_bm25(['src1'], 'phrase').replace('fields', 'fields2').replace('words', 'words2').replace('counted', 'counted2').replace('stats', 'stats2').replace('hits', 'hits2')} SELECT 'topic' AS asked, id, round(score, 6) AS score FROM hits UNION ALL SELECT 'entity', id, round(score, 6) FROM hits2")
def phrase_fields(spark, d):
    """Phrases that stand in topics and in entities."""
    topic = _keyword(spark, d, ["machine", "learning"], "phrase").select(F.lit("topic").alias("asked"), "id", F.round("score", 6).alias("score"))
    return topic.unionByName(_keyword(spark, d, ["src1"], "phrase").select(F.lit("entity").alias("asked"), "id", F.round("score", 6).alias("score")))


@query("r1_postings", M + f"SELECT term, count(*) AS n, count(DISTINCT id) AS docs FROM (SELECT id, unnest({_WORDS}) AS term FROM memories) GROUP BY term HAVING count(DISTINCT id) > 5")
def postings(spark, d):
    p = search.postings(memories(spark, d)).groupBy("term", "id").agg(F.count("*").alias("n"))
    return p.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).where("docs > 5")


# Vector search ------------------------------------------------------------------

_COS = "list_cosine_similarity({}, {})"
_Q0 = "(SELECT vector FROM vectors WHERE id = 0)"


def _query_vector(spark, d, i: int = 0):
    return vectors(spark, d).where(F.col("id") == i).select("vector")


@query("r2_vector_top_k", V + f"SELECT id, round({_COS.format('vector', _Q0)}, 6) AS score FROM vectors WHERE status = 'active' AND confidence >= 0.6 ORDER BY {_COS.format('vector', _Q0)} DESC, id LIMIT 10")
def vector_top_k(spark, d):
    rows = active(vectors(spark, d)).where("confidence >= 0.6")
    return search.vector_top_k(rows, _query_vector(spark, d), 10).withColumn("score", F.round("score", 6))


@query("r3_basic_search", V + f", top AS (SELECT id, {_COS.format('vector', _Q0)} AS score FROM vectors ORDER BY score DESC, id LIMIT 10) SELECT id, round(score / max(score) OVER (), 4) AS score FROM top")
def basic_search(spark, d):
    return search.normalised(search.vector_top_k(vectors(spark, d), _query_vector(spark, d), 10))


def _hybrid(spark, d, with_graph: bool):
    m = active(memories(spark, d))
    semantic = search.vector_top_k(active(vectors(spark, d)), _query_vector(spark, d), 20)
    words = _keyword(spark, d, ["the"], "all").select("id", F.round("score", 6).alias("score"))
    near = graph.near_memories(_tagged(spark, d), ["llm", "nothing", "rag"]).join(m.select("id"), "id", "left_semi") if with_graph else m.where("false").select("id")
    return search.hybrid(m, semantic, words, near, 10)


def _hybrid_sql(graph: str, before: str = MV) -> str:
    return f"""{before}, {_bm25(['the'], 'all')},
sem AS (SELECT id, {_COS.format('vector', _Q0)} AS score FROM vectors WHERE status = 'active' ORDER BY score DESC, id LIMIT 20),
kw AS (SELECT id, round(score, 6) AS score FROM hits ORDER BY 2 DESC, id LIMIT 20),
legs AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sem UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM kw UNION ALL SELECT id, 1 FROM memories WHERE {graph}),
fused AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM legs GROUP BY id),
top AS (SELECT f.id, rrf * coalesce(importance * pow(0.5::DOUBLE, age_days / 90), 1) AS score FROM fused f LEFT JOIN (SELECT * FROM memories WHERE status = 'active') m ON f.id = m.id ORDER BY score DESC, f.id LIMIT 10)
SELECT id, round(CASE WHEN max(score) OVER () = 0 THEN score ELSE score / max(score) OVER () END, 4) AS score FROM top"""


@query("r4_hybrid_rrf", _hybrid_sql("false"))
def hybrid(spark, d):
    return _hybrid(spark, d, False)


@query("r6_decay", M + "SELECT id, round(importance * pow(0.5::DOUBLE, age_days / 90), 6) AS weight, round(importance * pow(0.5::DOUBLE, age_days / 7), 6) AS fast FROM memories")
def decayed(spark, d):
    return memories(spark, d).select("id", F.round(F.col("importance") * search.decay(F.col("age_days")), 6).alias("weight"), F.round(F.col("importance") * search.decay(F.col("age_days"), 7.0), 6).alias("fast"))


@query("r7_related", V + f"SELECT id, round({_COS.format('vector', '(SELECT vector FROM vectors WHERE id = 7)')}, 6) AS score FROM vectors WHERE id <> 7 AND status = 'active' ORDER BY {_COS.format('vector', '(SELECT vector FROM vectors WHERE id = 7)')} DESC, id LIMIT 8")
def related(spark, d):
    return search.vector_top_k(active(vectors(spark, d)).where("id <> 7"), _query_vector(spark, d, 7), 8).withColumn("score", F.round("score", 6))


@query("r8_duplicate_check", V + f", top AS (SELECT id, round({_COS.format('vector', _Q0)}, 4) AS score FROM vectors WHERE id <> 0 ORDER BY {_COS.format('vector', _Q0)} DESC, id LIMIT 10) SELECT id, score, max(score) OVER () >= 0.3 AS is_duplicate FROM top WHERE score >= 0.3")
def duplicate_check(spark, d):
    top = search.vector_top_k(vectors(spark, d).where("id <> 0"), _query_vector(spark, d), 10).withColumn("score", F.round("score", 4))
    return top.where("score >= 0.3").select("id", "score", (F.max("score").over(Window.partitionBy()) >= 0.3).alias("is_duplicate"))


@query("r11_truncated_vectors", "SELECT vec_id AS id, len(embedding[1:16]) AS size, round(CAST(embedding[1] AS DOUBLE) + CAST(embedding[16] AS DOUBLE), 6) AS ends FROM embeddings")
def truncated_vectors(spark, d):
    short = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 16).alias("v"))
    return short.select("id", F.size("v").cast("long").alias("size"), F.round(F.col("v")[0].cast("double") + F.col("v")[15].cast("double"), 6).alias("ends"))


# Deduplication and consolidation --------------------------------------------------

_PAIRS = f"pairs AS (SELECT a.id AS a, b.id AS b, {_COS.format('a.vector', 'b.vector')} AS score FROM vectors a JOIN vectors b ON a.id <> b.id WHERE {_COS.format('a.vector', 'b.vector')} >= 0.4)"
#: No two given vectors are as near as the default thresholds ask; queries run at this one.
THRESHOLD = 0.4


def _pairs(spark, d):
    v = vectors(spark, d).select("id", "vector")
    return dedup.similar_pairs(v, v, THRESHOLD)


@query("d2_similar_pairs", f"WITH {VECTORS}, {_PAIRS} SELECT a, b, round(score, 6) AS score FROM pairs WHERE a < b")
def similar_pairs(spark, d):
    return _pairs(spark, d).where("a < b").select("a", "b", F.round("score", 6).alias("score"))


_NEAR = f"near AS (SELECT a.id AS a, b.id AS b, {_COS.format('a.vector', 'b.vector')} AS score, row_number() OVER (PARTITION BY a.id ORDER BY round({_COS.format('a.vector', 'b.vector')}, 12) DESC, b.id) AS rank FROM vectors a JOIN vectors b ON a.id % 2 = 1 AND b.id % 2 = 0)"
_SET = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda w: w <> ''))"
_OVERLAP = f"CAST(len(list_intersect({_SET.format('x.content')}, {_SET.format('y.content')})) AS DOUBLE) / greatest(1, len(list_distinct(list_concat({_SET.format('x.content')}, {_SET.format('y.content')}))))"


def _new_and_store(spark, d):
    """New vectors are those with odd ids, the store those with even ids."""
    v = vectors(spark, d)
    return v.where("id % 2 = 1"), v.where("id % 2 = 0")


def _neighbours(spark, d, k: int):
    """(a, b, score, rank) and the memory rows of both, as x_ and y_ columns."""
    m = memories(spark, d).select("id", "content", "platform", "status")
    x = m.select(*[F.col(c).alias(f"x_{c}") for c in m.columns])
    y = m.select(*[F.col(c).alias(f"y_{c}") for c in m.columns])
    near = dedup.nearest_k(*_new_and_store(spark, d), k)
    return near.join(x, F.col("a") == F.col("x_id")).join(y, F.col("b") == F.col("y_id"))


@query("d2_new_rows", f"{MV}, {_NEAR} SELECT v.id FROM vectors v WHERE v.id % 2 = 1 AND v.id NOT IN (SELECT a FROM near JOIN memories x ON a = x.id JOIN memories y ON b = y.id WHERE rank <= 3 AND score > 0.3 AND {_OVERLAP} > 0.02)")
def new_rows(spark, d):
    """New rows without a like one among their three nearest in the store."""
    return dedup.without_near(_new_and_store(spark, d)[0].select("id"), _neighbours(spark, d, 3), text.overlap(F.col("x_content"), F.col("y_content")), 0.3, 0.02)


@query("d3_watcher_reasons", f"""WITH {VECTORS}, s AS (SELECT id, vector, platform, id // 100 AS session FROM vectors), t AS (SELECT a.id, b.id AS b, a.session <> b.session AS other, {_COS.format('a.vector', 'b.vector')} AS score, row_number() OVER (PARTITION BY a.id ORDER BY round({_COS.format('a.vector', 'b.vector')}, 12) DESC, b.id) AS rank FROM s a JOIN s b ON a.id % 40 >= 20 AND b.id % 40 < 20 AND a.platform = b.platform WHERE a.id % 31 <> 0 AND a.id % 37 <> 0)
SELECT s.id, CASE WHEN s.id % 31 = 0 THEN 'embed_failed' WHEN s.id % 37 = 0 THEN 'search_failed' WHEN b IS NULL THEN 'no_match' WHEN other THEN 'different_session' WHEN score >= 0.1 THEN 'near_duplicate' ELSE 'below_threshold' END AS reason, round(coalesce(score, 0), 6) AS score, CASE WHEN NOT other AND score >= 0.1 THEN b END AS matched FROM s LEFT JOIN (SELECT * FROM t WHERE rank = 1) n ON s.id = n.id WHERE s.id % 40 >= 20""")
def watcher_reasons(spark, d):
    """Rows without a vector, and with one of another length, are among the new ones."""
    rows = vectors(spark, d).select("id", "vector", "platform", F.floor(F.col("id") / 100).alias("session"))
    broken = F.when(F.col("id") % 31 == 0, F.lit(None)).when(F.col("id") % 37 == 0, F.slice("vector", 1, 8)).otherwise(F.col("vector"))
    return dedup.watcher_decisions(rows.where("id % 40 >= 20").withColumn("vector", broken), rows.where("id % 40 < 20"), 0.1, 64)


@query("d4_corroboration", f"WITH {VECTORS}, {_NEAR}, c AS (SELECT b, string_agg(DISTINCT x.platform, ',' ORDER BY x.platform) AS by FROM near JOIN vectors x ON a = x.id JOIN vectors y ON b = y.id WHERE rank <= 5 AND score >= 0.3 AND x.platform <> y.platform GROUP BY b) SELECT id, round(CASE WHEN c.by IS NULL THEN confidence ELSE least(1, confidence + 0.1::DOUBLE) END, 6) AS confidence, coalesce(c.by, '') AS corroborated_by FROM vectors LEFT JOIN c ON id = b WHERE id % 2 = 0")
def corroboration(spark, d):
    """Rows of the store near one of the five nearest of a new row of another platform."""
    new, store_ = _new_and_store(spark, d)
    own = store_.select(F.col("id").alias("b"), F.col("platform").alias("_own"))
    near = dedup.nearest_k(new, store_, 5).where("score >= 0.3").join(new.select(F.col("id").alias("a"), "platform"), "a").join(own, "b").where("platform <> _own")
    grown = dedup.corroborated(store_.select("id", "confidence"), near)
    return grown.select("id", F.round("confidence", 6).alias("confidence"), F.array_join("corroborated_by", ",").alias("corroborated_by"))


@query("d5_contradictions", f"{MV}, {_NEAR}, c AS (SELECT b, min(a) AS a FROM near JOIN memories x ON a = x.id JOIN memories y ON b = y.id WHERE rank <= 5 AND score >= 0.3 AND y.status = 'active' AND {_OVERLAP} < 0.3 GROUP BY b) SELECT m.id, CASE WHEN c.b IS NOT NULL THEN 'superseded' ELSE m.status END AS status, coalesce(s.l, '') AS supersedes FROM memories m LEFT JOIN c ON m.id = c.b LEFT JOIN (SELECT a, string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) AS l FROM c GROUP BY a) s ON m.id = s.a")
def contradictions(spark, d):
    found = _neighbours(spark, d, 5).where("score >= 0.3 AND y_status = 'active'").where(text.overlap(F.col("x_content"), F.col("y_content")) < 0.3)
    out = dedup.superseding(memories(spark, d).select("id", "status"), found.select("a", "b"))
    return out.select("id", "status", F.array_join(F.transform("supersedes", lambda x: x.cast("string")), ",").alias("supersedes"))


def _flagged(spark, d):
    """(a, b, score), a < b, of near vectors whose memories are of different platforms and unlike
    in words; memories outside the ids of vectors are not read."""
    v = vectors(spark, d).select("id", "vector")
    first, last = v.agg(F.min("id"), F.max("id")).first()
    m = memories(spark, d).where(F.col("id").between(F.lit(first), F.lit(last)))
    return dedup.unlike_pairs(v, m.select("id", "platform", text.word_set(F.col("content")).alias("words")), THRESHOLD, 0.3)


@query("d6_importance", M + "SELECT id, round(least(exp(-floor(age_days) / 90) * (1 + 0.1::DOUBLE * ln(1 + access_count)), 1), 4) AS importance, abs(round(least(exp(-floor(age_days) / 90) * (1 + 0.1::DOUBLE * ln(1 + access_count)), 1), 4) - importance) > 0.001 AS changed FROM memories")
def importance(spark, d):
    new = dedup.recomputed_importance(F.col("age_days"), F.col("access_count"), 90.0)
    return memories(spark, d).select("id", "importance", new.alias("_new")).select("id", F.col("_new").alias("importance"), (F.abs(F.col("_new") - F.col("importance")) > 0.001).alias("changed"))


@query("d7_greedy_merges")
def greedy_merges(spark, d):
    rows = vectors(spark, d).select("id", "platform", "confidence", F.col("id").alias("created_minute"))
    near = dedup.nearest_above(vectors(spark, d), 5, THRESHOLD)
    return dedup.greedy_merges(near.select("a", "b", "score"), rows)


@query("d8_cross_platform_flags", f"{MV}, {_PAIRS} SELECT a, b FROM pairs JOIN memories x ON a = x.id JOIN memories y ON b = y.id WHERE a < b AND x.platform <> y.platform AND {_OVERLAP} < 0.3")
def cross_platform_flags(spark, d):
    return _flagged(spark, d).select("a", "b")


@query("d9_report")
def report(spark, d):
    """One row: merged, flagged, updated, errors.  Merging is greedy and has no SQL form."""
    merged = greedy_merges(spark, d).agg(F.count("*").alias("merged"))
    flagged = cross_platform_flags(spark, d).agg(F.count("*").alias("flagged"))
    updated = importance(spark, d).agg(F.count_if("changed").alias("updated"), F.count_if(F.col("importance").isNull()).alias("errors"))
    return merged.join(flagged).join(updated)


@query("a10_centroid", "SELECT i, round(avg(x), 6) AS x FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label = 1) GROUP BY i")
def centroid(spark, d):
    row = briefing.centroid(table(spark, d, "embeddings").where("label = 1").select(F.col("embedding").alias("vector")))
    return row.select(F.posexplode("vector").alias("i", "x")).select((F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


# Graph ------------------------------------------------------------------------------

_ITEMS = f"{MEMORIES}, item AS (SELECT id, created_minute, unnest(list_concat(list_transform({_TOPICS}, lambda t: {{'name': t, 'type': 'topic'}}), [{{'name': platform, 'type': 'entity'}}])) AS x FROM memories), items AS (SELECT id, created_minute, x.name AS name, x.type AS type FROM item)"
_EDGES = f"{_ITEMS}, edges AS (SELECT p.name AS a, q.name AS b, count(*) AS weight FROM items p JOIN items q ON p.id = q.id AND p.name < q.name GROUP BY p.name, q.name)"


def _tagged(spark, d):
    """Topics and entities of every memory, kept in the shared folder, as graph queries read them more than once."""
    return written(_tags(spark, d), "tags")


def _tags(spark, d):
    return memories(spark, d).select("id", "created_minute", text.topics(F.col("content")).alias("topics"), F.array("platform").alias("entities"))


@query("g1_nodes", f"WITH {_ITEMS} SELECT name, count(*) AS n, arg_min(type, created_minute) AS type, min(created_minute) AS first_seen, max(created_minute) AS last_seen FROM items GROUP BY name")
def nodes(spark, d):
    return graph.nodes(graph.items(_tags(spark, d)))


@query("g2_edges", f"WITH {_EDGES} SELECT * FROM edges")
def edges(spark, d):
    return graph.edges(_tags(spark, d))


@query("g3_memories_of_node", f"WITH {_ITEMS} SELECT DISTINCT id FROM items WHERE name = 'llm'")
def memories_of_node(spark, d):
    return graph.items(_tags(spark, d)).where("name = 'llm'").select("id").distinct()


@query("g4_neighbours", f"WITH RECURSIVE {_EDGES}, both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), walk AS (SELECT 'llm' AS name, 0 AS depth UNION SELECT b, depth + 1 FROM walk JOIN both_ways ON name = a WHERE depth < 2), r AS (SELECT name, min(depth) AS depth FROM walk GROUP BY name HAVING min(depth) > 0), c AS (SELECT name, count(*) AS n FROM items GROUP BY name) SELECT 'llm' AS start, r.name, depth, n, row_number() OVER (ORDER BY n DESC, r.name) AS place, true AS found FROM r JOIN c ON r.name = c.name UNION ALL SELECT 'no such name', NULL, NULL, NULL, NULL, false")
def neighbours(spark, d):
    tagged = _tagged(spark, d)
    every = graph.nodes(graph.items(tagged))
    edges_ = written(graph.edges(tagged), "edges")
    return graph.found_neighbours(edges_, every, "llm", 2).unionByName(graph.found_neighbours(edges_, every, "no such name", 2))


@query("g5_heavy_edges", f"WITH {_EDGES} SELECT a, b, weight FROM edges WHERE weight >= 3")
def heavy_edges(spark, d):
    return graph.edges(_tags(spark, d)).where("weight >= 3")


@query("g6_graph_size", f"WITH {_EDGES} SELECT (SELECT count(DISTINCT name) FROM items) AS nodes, (SELECT count(*) FROM edges) AS edges")
def graph_size(spark, d):
    t = _tagged(spark, d)
    return graph.nodes(graph.items(t)).agg(F.count("*").alias("nodes")).join(graph.edges(t).agg(F.count("*").alias("edges")))


@query("r5_graph_leg", f"WITH {_EDGES}, terms AS (SELECT DISTINCT unnest(['llm', 'nothing', 'rag']) AS name), near AS (SELECT b AS name FROM terms JOIN edges ON name = a UNION SELECT a FROM terms JOIN edges ON name = b) SELECT DISTINCT id FROM items WHERE name IN (SELECT name FROM near)")
def graph_leg(spark, d):
    return graph.near_memories(_tagged(spark, d), ["llm", "nothing", "rag"])


@query("r4_hybrid_with_graph", _hybrid_sql("status = 'active' AND id IN (SELECT id FROM items WHERE name IN (SELECT name FROM near_names))", f"WITH {_EDGES}, {VECTORS}, terms AS (SELECT DISTINCT unnest(['llm', 'nothing', 'rag']) AS name), near_names AS (SELECT b AS name FROM terms JOIN edges ON name = a UNION SELECT a FROM terms JOIN edges ON name = b)"))
def hybrid_with_graph(spark, d):
    return _hybrid(spark, d, True)


# Facts --------------------------------------------------------------------------------

T = f"WITH {TRIPLES} "
_VALID = "(valid_from IS NULL OR valid_from <= {0}) AND (valid_to IS NULL OR valid_to >= {0})"


@query("g8_entity_merge", "SELECT c_custkey AS id, list_sort(list_distinct(list_concat([c_mktsegment], CASE WHEN c_custkey % 2 = 0 THEN ['even', c_mktsegment] ELSE [] END)))[1] AS alias, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS note FROM customer")
def entity_merge(spark, d):
    c = table(spark, d, "customer")
    base = c.select(F.col("c_custkey").alias("id"), F.lit("person").alias("type"), F.array("c_mktsegment").alias("aliases"), F.create_map(F.lit("note"), F.lit("old")).alias("properties"))
    new = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit(None).cast("string").alias("type"), F.array(F.lit("even"), "c_mktsegment").alias("aliases"), F.create_map(F.lit("note"), F.lit("new")).alias("properties"))
    return facts.entities_merged(base, new).select("id", F.array_sort("aliases")[0].alias("alias"), F.col("properties")["note"].alias("note"))


@query("g9_triple_upsert", T + ", new AS (SELECT triple, 0.9::DOUBLE AS confidence, 'accepted' AS status, DATE '2030-01-01' AS valid_to FROM triples WHERE triple % 7 = 0) SELECT t.triple, CASE WHEN t.status = 'proposed' AND n.triple IS NOT NULL THEN 'accepted' ELSE t.status END AS status, greatest(t.confidence, coalesce(n.confidence, t.confidence)) AS confidence, strftime(coalesce(n.valid_to, t.valid_to), '%Y-%m-%d') AS valid_to FROM triples t LEFT JOIN new n ON t.triple = n.triple")
def triple_upsert(spark, d):
    t = triples(spark, d)
    new = t.where("triple % 7 = 0").withColumns({"confidence": F.lit(0.9), "status": F.lit("accepted"), "valid_to": F.lit("2030-01-01").cast("date")})
    return facts.upserted(t, new).select("triple", "status", "confidence", F.col("valid_to").cast("string").alias("valid_to"))


@query("g10_invalidate", T + "SELECT triple, strftime(CASE WHEN object = 'Status F' AND valid_to IS NULL THEN DATE '2024-02-01' ELSE valid_to END, '%Y-%m-%d') AS valid_to FROM triples")
def invalidate(spark, d):
    return facts.invalidated(triples(spark, d), F.col("object") == "Status F", "2024-02-01").select("triple", F.col("valid_to").cast("string").alias("valid_to"))


@query("g11_as_of", T + f"SELECT triple, subject, predicate FROM triples WHERE (subject = 'Status O' OR object = 'Status O') AND status = 'accepted' AND {_VALID.format('DATE ' + chr(39) + '1997-06-01' + chr(39))}")
def as_of(spark, d):
    return facts.about(triples(spark, d), "Status O", "1997-06-01").select("triple", "subject", "predicate")


@query("j8_as_of_join", T + f", points AS (SELECT 'customer ' || CAST(c_custkey AS VARCHAR) AS subject, DATE '1995-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS day FROM customer) SELECT p.subject, count(*) AS n, min(triple) AS first FROM points p JOIN triples t ON p.subject = t.subject WHERE {_VALID.format('p.day')} GROUP BY p.subject")
def as_of_join(spark, d):
    points = table(spark, d, "customer").select(F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("subject"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 1000).cast("int")).alias("day"))
    return facts.as_of(points, triples(spark, d)).groupBy("subject").agg(F.count("*").alias("n"), F.min("triple").alias("first"))


@query("g12_timeline", T + "SELECT triple FROM triples ORDER BY coalesce(valid_from, DATE '1970-01-01'), created, triple LIMIT 500")
def timeline(spark, d):
    return facts.timeline(triples(spark, d)).select("triple")


@query("g13_proposed", T + "SELECT triple, created FROM triples WHERE status = 'proposed' ORDER BY created DESC, triple LIMIT 100")
def proposed(spark, d):
    return triples(spark, d).where("status = 'proposed'").orderBy(F.desc("created"), "triple").limit(100).select("triple", "created")


@query("g14_decide", T + "SELECT triple, CASE WHEN status = 'proposed' AND triple % 2 = 0 THEN 'accepted' WHEN status = 'proposed' AND triple % 3 = 0 THEN 'rejected' ELSE status END AS status, CASE WHEN status = 'proposed' AND triple % 2 = 0 THEN greatest(confidence, 1) ELSE confidence END AS confidence FROM triples")
def decide(spark, d):
    p, k = F.col("status") == "proposed", F.col("triple")
    return facts.decided(triples(spark, d), p & (k % 2 == 0), p & (k % 3 == 0)).select("triple", "status", "confidence")


@query("g15_edit", T + "SELECT CASE WHEN triple % 9 = 0 THEN triple + 1000000000000 ELSE triple END AS triple, CASE WHEN triple % 9 = 0 THEN 'changed' ELSE object END AS object, CASE WHEN triple % 9 = 0 THEN 'edited' ELSE status END AS status, CASE WHEN triple % 9 <> 0 AND triple % 10 = 0 THEN 0.5::DOUBLE ELSE confidence END AS confidence FROM triples")
def edit(spark, d):
    """A changed identity replaces the fact by an edited one; other changes are patched in."""
    identity, patch = F.col("triple") % 9 == 0, (F.col("triple") % 9 != 0) & (F.col("triple") % 10 == 0)
    edited_ = facts.edited(triples(spark, d), identity, {"triple": F.col("triple") + 10**12, "object": F.lit("changed")}, patch, {"confidence": F.lit(0.5)})
    return edited_.select("triple", "object", "status", "confidence")


@query("g16_search", T + f"SELECT triple FROM triples WHERE predicate = '1-URGENT' AND status = 'accepted' AND {_VALID.format('DATE ' + chr(39) + '1996-01-01' + chr(39))} ORDER BY created DESC, triple LIMIT 50 OFFSET 10")
def fact_search(spark, d):
    found = triples(spark, d).where((F.col("predicate") == "1-URGENT") & (F.col("status") == "accepted") & facts.valid_at(F.lit("1996-01-01").cast("date")))
    return found.orderBy(F.desc("created"), "triple").offset(10).limit(50).select("triple")


@query("a8_fact_stats", T + "SELECT status, count(*) AS n, count(DISTINCT predicate) AS predicates, count(DISTINCT subject) AS subjects FROM triples GROUP BY status")
def fact_stats(spark, d):
    return triples(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("predicate").alias("predicates"), F.countDistinct("subject").alias("subjects"))


@query("g17_extracted_facts", M + ", f AS (SELECT id, unnest(regexp_extract_all('Project' || platform || ' uses Spark. ' || content, '([A-Za-z0-9_]+ uses [A-Za-z0-9_]+)', 1)[1:8]) AS f FROM memories), p AS (SELECT id, lower(split_part(f, ' uses ', 1)) AS subject, lower(split_part(f, ' uses ', 2)) AS object FROM f) SELECT id, substr(sha256(subject || '|uses|' || object || '|'), 1, 32) AS triple, subject, object, CAST(0.7 AS DOUBLE) AS confidence FROM p")
def extracted_facts(spark, d):
    """``X uses Y`` sentences as proposed facts, at most eight a text."""
    c = F.concat(F.lit("Project"), F.col("platform"), F.lit(" uses Spark. "), F.col("content"))
    found = F.slice(F.regexp_extract_all(c, F.lit(r"(\w+ uses \w+)"), F.lit(1)), 1, 8)
    rows = memories(spark, d).select("id", F.explode(found).alias("f"))
    s, o = F.substring_index("f", " uses ", 1), F.substring_index("f", " uses ", -1)
    return rows.select("id", text.triple_id(F.lower(s), F.lit("uses"), F.lower(o), F.lit(None).cast("date")).alias("triple"), F.lower(s).alias("subject"), F.lower(o).alias("object"), F.lit(0.7).alias("confidence"))


@query("t21_fuzzy_entities", "SELECT s_suppkey AS supplier, n_name AS nation FROM (SELECT s_suppkey, n_name, 1 - CAST(levenshtein(alias, lower(n_name)) AS DOUBLE) / greatest(length(alias), length(n_name)) AS ratio, n_nationkey FROM (SELECT s_suppkey, lower(n.n_name) || CASE WHEN s_suppkey % 3 = 0 THEN 'x' WHEN s_suppkey % 3 = 1 THEN '' ELSE '-unknown-name' END AS alias FROM supplier JOIN nation n ON s_nationkey = n_nationkey), nation) WHERE ratio >= 0.8 QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY ratio DESC, n_nationkey) = 1")
def fuzzy_entities(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    suffix = F.when(F.col("s_suppkey") % 3 == 0, "x").when(F.col("s_suppkey") % 3 == 1, "").otherwise("-unknown-name")
    asked = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("key"), F.concat("n_name", suffix).alias("name"))
    known = n.select(F.col("n_nationkey").alias("entity"), F.col("n_name").alias("name"), F.lit(None).cast("array<string>").alias("aliases"))
    found = fuzzy.resolve(asked, known).select(F.col("key").alias("supplier"), F.col("entity").alias("n_nationkey"))
    return found.join(n, "n_nationkey").select("supplier", F.col("n_name").alias("nation"))


# Briefing and evaluation ------------------------------------------------------------------

_SKILLS = ["ai", "rag", "src3"]
_MEAN = "(SELECT list(x ORDER BY i) FROM (SELECT i, avg(x) AS x FROM (SELECT unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM vectors) GROUP BY i))"
_SCORE = f"0.30::DOUBLE * importance + 0.25::DOUBLE * exp(-greatest(age_days, 0) / 30) + 0.25::DOUBLE * CASE WHEN is_pinned THEN 1 ELSE 0 END + 0.10::DOUBLE * CASE WHEN vector IS NULL THEN 0 ELSE greatest(0, least(1, list_cosine_similarity(vector, mean))) END + 0.10::DOUBLE * CASE WHEN list_has_any(list_concat({_TOPICS}, [platform]), ['ai', 'rag', 'src3']) THEN 1 ELSE 0 END"
_SCORED = f"{MV}, scored AS (SELECT m.id, is_pinned, created_minute, {_SCORE.replace('platform]', 'm.platform]')} AS score FROM (SELECT * FROM memories WHERE status = 'active') m LEFT JOIN vectors v ON m.id = v.id, (SELECT {_MEAN} AS mean))"


def _scored(spark, d, w=fixed.BRIEFING_WEIGHTS):
    v = vectors(spark, d).select("id", "vector")
    mean = briefing.centroid(v).select(F.col("vector").alias("mean"))
    rows = active(memories(spark, d)).join(v, "id", "left").join(F.broadcast(mean))
    cluster = F.greatest(F.lit(0.0), F.least(F.lit(1.0), search.cosine(F.col("vector"), F.col("mean"))))
    names = F.concat(text.topics(F.col("content")), F.array("platform"))
    skill = F.arrays_overlap(F.transform(names, lambda x: F.lower(x)), F.array(*[F.lit(s) for s in _SKILLS]))
    return rows.select("id", "is_pinned", "created_minute", "vector", briefing.score(F.col("importance"), F.col("age_days"), F.col("is_pinned"), cluster, skill, w).alias("score"))


@query("b1_scores", _SCORED + " SELECT id, round(score, 6) AS score FROM scored")
def scores(spark, d):
    return _scored(spark, d).select("id", F.round("score", 6).alias("score"))


@query("b2_cluster_scores", V + f"SELECT id, round(greatest(0, least(1, list_cosine_similarity(vector, mean))), 6) AS cluster FROM vectors, (SELECT {_MEAN} AS mean)")
def cluster_scores(spark, d):
    v = vectors(spark, d).select("id", "vector")
    mean = briefing.centroid(v).select(F.col("vector").alias("mean"))
    return v.join(F.broadcast(mean)).select("id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), search.cosine(F.col("vector"), F.col("mean")))), 6).alias("cluster"))


@query("b5_diverse_selection")
def diverse_selection(spark, d):
    return briefing.select_diverse(_scored(spark, d), 15)


@query("b6_pool", M + "SELECT id FROM (SELECT id FROM memories WHERE is_pinned ORDER BY created_minute DESC, id LIMIT 15) UNION SELECT id FROM (SELECT id FROM memories ORDER BY created_minute DESC, id LIMIT 150)")
def pool(spark, d):
    return briefing.pool(memories(spark, d), 15).select("id")


@query("b7_budgets", "SELECT p_partkey AS part, CASE WHEN p_partkey * 500 < 32000 THEN 400 WHEN p_partkey * 500 < 200000 THEN 800 ELSE 1500 END AS tokens, CASE WHEN p_partkey * 500 < 32000 THEN 8 WHEN p_partkey * 500 < 200000 THEN 15 ELSE 25 END AS rows FROM part")
def budgets(spark, d):
    tokens, rows = briefing.budget(F.col("p_partkey") * 500)
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), tokens.alias("tokens"), rows.alias("rows"))


@query("b9_context_groups", M + "SELECT content_type, id FROM memories WHERE status = 'active' AND content_type IN ('decision', 'learning', 'preference', 'action_item', 'fact') QUALIFY row_number() OVER (PARTITION BY content_type ORDER BY created_minute DESC, id) <= 5")
def context_groups(spark, d):
    order = Window.partitionBy("content_type").orderBy(F.desc("created_minute"), "id")
    rows = active(memories(spark, d)).where(F.col("content_type").isin("decision", "learning", "preference", "action_item", "fact")).select("content_type", "id", "created_minute")
    return rows.withColumn("n", F.row_number().over(order)).where("n <= 5").select("content_type", "id")


@query("b12_skill_tags", M + f"SELECT session_id, array_to_string(list_sort(list_distinct(list_transform(flatten(list({_TOPICS})), lambda t: lower(t))))[1:10], ',') AS tags FROM memories GROUP BY session_id")
def skill_tags(spark, d):
    tags = F.slice(F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_list(text.topics(F.col("content")))), lambda t: F.lower(t)))), 1, 10)
    return memories(spark, d).groupBy("session_id").agg(F.array_join(tags, ",").alias("tags"))


_TOPIC_ROWS = f"SELECT session_id, id, topic, place FROM (SELECT session_id, id, unnest(t) AS topic, generate_subscripts(t, 1) AS place FROM (SELECT session_id, id, {_TOPICS} AS t FROM memories))"


@query("b12_skills", M + f", t AS ({_TOPIC_ROWS}), u AS (SELECT session_id, list(topic ORDER BY id, place) AS t FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY session_id, topic ORDER BY id, place) = 1) GROUP BY session_id), b AS (SELECT session_id, count(*) AS n, string_agg(trim(content), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY id) FILTER (WHERE trim(content) <> '') AS content FROM memories GROUP BY session_id) SELECT b.session_id, coalesce(nullif(substr(regexp_replace(regexp_replace(array_to_string(coalesce(t, [])[1:3], '-'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), ''), 'extracted-skill') AS name, substr('Auto-extracted from ' || n || ' memories' || CASE WHEN t IS NULL THEN '' ELSE ' covering ' || array_to_string(t[1:3], ', ') END, 1, 240) AS description, sha256(coalesce(content, '')) AS content, coalesce(array_to_string(t[1:10], ','), '') AS tags FROM b LEFT JOIN u ON b.session_id = u.session_id")
def skills(spark, d):
    rows = memories(spark, d).select("session_id", F.col("id").alias("place"), "content", text.topics(F.col("content")).alias("topics"))
    made = exchanges.skills(rows)
    return made.select("session_id", "name", "description", F.sha2("content", 256).alias("content"), F.array_join("tags", ",").alias("tags"))


def _ranked_lists(spark, d):
    """For every query vector, id divisible by 20: the ten nearest others, and which have the same label."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    q = e.where("id % 20 = 0")
    top = dedup.nearest_k(q, e, 10).join(e.select(F.col("id").alias("b"), "label"), "b").join(q.select(F.col("id").alias("a"), F.col("label").alias("ql")), "a")
    found = top.groupBy(F.col("a").alias("query")).agg(F.array_sort(F.collect_list(F.struct("rank", "b"))).alias("f"), F.collect_set(F.when(F.col("label") == F.col("ql"), F.col("b"))).alias("gold"))
    return found.select("query", F.transform("f", lambda x: x["b"]).alias("found"), "gold")


@query("v1_retrieval_metrics", f"WITH r AS (SELECT a.vec_id AS query, b.label = a.label AS good, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS.format('CAST(a.embedding AS DOUBLE[])', 'CAST(b.embedding AS DOUBLE[])')} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) SELECT query, CASE WHEN bool_or(good AND rank <= 5) THEN 1.0::DOUBLE ELSE 0 END AS recall, round(coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE good), 0), 6) AS mrr, round(CAST(count(*) FILTER (WHERE good AND rank <= 5) AS DOUBLE) / 5, 6) AS precision FROM r WHERE rank <= 10 GROUP BY query")
def retrieval_metrics(spark, d):
    recall, mrr, precision = briefing.metrics(F.col("found"), F.col("gold"), 5)
    return _ranked_lists(spark, d).select("query", recall.alias("recall"), F.round(mrr, 6).alias("mrr"), F.round(precision, 6).alias("precision"))


@query("v2_evaluation", f"WITH r AS (SELECT a.vec_id AS query, b.label = a.label AS good, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS.format('CAST(a.embedding AS DOUBLE[])', 'CAST(b.embedding AS DOUBLE[])')} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), s AS (SELECT query, CASE WHEN bool_or(good AND rank <= 5) THEN 1.0::DOUBLE ELSE 0 END AS recall, round(coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE good), 0), 6) AS mrr, round(CAST(count(*) FILTER (WHERE good AND rank <= 5) AS DOUBLE) / 5, 6) AS precision FROM r WHERE rank <= 10 GROUP BY query) SELECT count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(mrr), 5) AS mrr, round(avg(precision), 5) AS precision FROM s")
def evaluation(spark, d):
    return retrieval_metrics(spark, d).agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("mrr"), 5).alias("mrr"), F.round(F.avg("precision"), 5).alias("precision"))
