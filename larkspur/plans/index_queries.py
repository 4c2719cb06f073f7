"""Queries through indexes and maintained tables: vectors, names, intent, counts from changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.operators import fuzzy, graph, search
from larkspur.operators.maintained import MaintainedViews, changes, key, where
from larkspur.operators.scratch import scratch_path
from larkspur.operators.store import active
from larkspur.operators.vector_index import VectorIndex
from larkspur.plans.registry import query
from larkspur.plans.search_queries import _COS, _EDGES, _PAIRS, _TOPICS, MV, THRESHOLD, _bm25, _keyword, _query_vector, _tagged
from larkspur.plans.views import MEMORIES, VECTORS, memories, table, vectors


@query("r2_indexed_nearest", f"WITH {VECTORS} SELECT a.id AS a, b.id AS b, round({_COS.format('a.vector', 'b.vector')}, 6) AS score FROM vectors a JOIN vectors b ON a.id <> b.id WHERE a.id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round({_COS.format('a.vector', 'b.vector')}, 12) DESC, b.id) <= 10")
def indexed_nearest(spark, d):
    """The ten nearest of every vector whose id is divisible by 20, exactly, through the index."""
    rows = vectors(spark, d).select("id", "vector")
    found = VectorIndex.build(rows).nearest(rows.where("id % 20 = 0"), 10)
    return found.select("a", "b", F.round("score", 6).alias("score"))


@query("d2_indexed_pairs", f"WITH {VECTORS}, {_PAIRS} SELECT a, b, round(score, 6) AS score FROM pairs WHERE a < b")
def indexed_pairs(spark, d):
    rows = vectors(spark, d).select("id", "vector")
    return VectorIndex.build(rows).pairs(rows, THRESHOLD, later=True).select("a", "b", F.round("score", 6).alias("score"))


_MISSPELT = "CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, 'e', '') WHEN p_partkey % 3 = 1 THEN p_name || 's' ELSE substr(p_name, 2) || 'xy' END"
_KNOWN = "known AS (SELECT p_partkey AS entity, lower(p_name) AS variant FROM part WHERE p_partkey % 2 = 0 UNION SELECT p_partkey, lower(p_brand || ' ' || p_type) FROM part WHERE p_partkey % 2 = 0)"


@query("t21_fuzzy_parts", f"WITH {_KNOWN}, asked AS (SELECT p_partkey AS key, lower(trim({_MISSPELT})) AS name FROM part WHERE p_partkey % 2 = 1), n AS (SELECT DISTINCT name FROM asked), v AS (SELECT variant, min(entity) AS entity FROM known GROUP BY variant), s AS (SELECT name, entity, 1 - CAST(levenshtein(name, variant) AS DOUBLE) / greatest(length(name), length(variant)) AS ratio FROM n, v) SELECT key, entity, round(ratio, 6) AS ratio FROM asked JOIN (SELECT * FROM s WHERE ratio >= 0.8 QUALIFY row_number() OVER (PARTITION BY name ORDER BY ratio DESC, entity) = 1) USING (name)")
def fuzzy_parts(spark, d):
    """Misspelt names of odd parts resolved to even parts, by their names and aliases."""
    p = table(spark, d, "part")
    known = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("name"), F.array(F.concat_ws(" ", "p_brand", "p_type")).alias("aliases"))
    asked = p.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("key"), F.expr(_MISSPELT).alias("name"))
    return fuzzy.resolve(asked, known).select("key", "entity", F.round("ratio", 6).alias("ratio"))


_ASKED = "what did we decide about the rag last week"
_AGED = "CAST(44640 - id * 200 AS DOUBLE) / CAST(1440 AS DOUBLE)"


@query("r4_hybrid_intent", f"""WITH {_EDGES}, {VECTORS}, aged AS (SELECT * REPLACE ({_AGED} AS age_days) FROM memories WHERE status = 'active'), wanted AS (SELECT * FROM aged WHERE content_type = 'decision' AND age_days <= 14),
{_bm25(['the', 'rag'], 'any')}, terms AS (SELECT unnest(string_split('{_ASKED}', ' ')) AS name), near_names AS (SELECT b AS name FROM terms JOIN edges ON name = a UNION SELECT a FROM terms JOIN edges ON name = b),
sem AS (SELECT v.id, {_COS.format('v.vector', '(SELECT vector FROM vectors WHERE id = 0)')} AS score FROM vectors v JOIN wanted USING (id) ORDER BY score DESC, v.id LIMIT 20),
kw AS (SELECT id, round(score, 6) AS score FROM hits JOIN wanted USING (id) ORDER BY 2 DESC, id LIMIT 20),
legs AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sem UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM kw UNION ALL SELECT id, 1 FROM wanted WHERE id IN (SELECT id FROM items WHERE name IN (SELECT name FROM near_names))),
fused AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM legs GROUP BY id),
top AS (SELECT f.id, rrf * coalesce(importance * pow(0.5::DOUBLE, age_days / 90), 1) AS score FROM fused f LEFT JOIN aged m ON f.id = m.id ORDER BY score DESC, f.id LIMIT 10)
SELECT id, round(CASE WHEN max(score) OVER () = 0 THEN score ELSE score / max(score) OVER () END, 4) AS score FROM top""")
def hybrid_intent(spark, d):
    """The types and time that a question implies filter all legs; its cleaned words are searched."""
    intent = search.intent(spark, _ASKED)
    m = active(memories(spark, d)).withColumn("age_days", F.expr(_AGED))
    wanted = search.intended(m, intent)
    ids = wanted.select("id")
    semantic = search.vector_top_k(vectors(spark, d).join(ids, "id", "left_semi"), _query_vector(spark, d), 20)
    words = _keyword(spark, d, intent.terms, "any").select("id", F.round("score", 6).alias("score")).join(ids, "id", "left_semi")
    near = graph.near_memories(_tagged(spark, d), _ASKED.split()).join(ids, "id", "left_semi")
    return search.hybrid(m, semantic, words, near, 10)


_VIEWS = {
    "platform": lambda r: where(r["status"] == "active", F.array(key(r["platform"]))),
    "topic": lambda r: where(r["status"] == "active", F.transform(r["topics"], lambda t: key(t))),
    "collection": lambda r: F.array(key(r["collection"])),
    "type by user": lambda r: F.array(key(r["content_type"], r["user_id"])),
}
_FINAL = f"final AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'moved' ELSE platform END AS platform, CASE WHEN id % 7 = 0 THEN 'archived' ELSE status END AS status, {_TOPICS} AS topics, id % 23 AS collection, content_type, user_id FROM memories WHERE id % 13 <> 0)"


@query("w12_refreshed_counts", f"WITH {MEMORIES}, {_FINAL} SELECT 'platform' AS view, platform AS key, count(*) AS n FROM final WHERE status = 'active' GROUP BY platform UNION ALL SELECT 'topic', topic, count(*) FROM (SELECT unnest(topics) AS topic FROM final WHERE status = 'active') GROUP BY topic UNION ALL SELECT 'collection', CAST(collection AS VARCHAR), count(*) FROM final GROUP BY collection UNION ALL SELECT 'type by user', content_type || ' ' || user_id, count(*) FROM final GROUP BY content_type, user_id")
def refreshed_counts(spark, d):
    """Counts by platform, topic, collection, type and user after inserts, updates, archivals
    and deletes, each taken in as changes."""
    rows = memories(spark, d).select("id", "platform", "status", text.topics(F.col("content")).alias("topics"), (F.col("id") % 23).alias("collection"), "content_type", "user_id")
    views = MaintainedViews(spark, scratch_path(spark, "views"), _VIEWS)
    moved = F.when(F.col("id") % 5 == 0, F.lit("moved")).otherwise(F.col("platform"))
    gone = F.when(F.col("id") % 7 == 0, F.lit("archived")).otherwise(F.col("status"))
    views.refresh(changes(None, rows.where("id % 3 <> 0")), "filled")
    views.refresh(changes(None, rows.where("id % 3 = 0")), "added")
    after = rows.where("id % 5 = 0").withColumn("platform", moved)
    views.refresh(changes(rows.where("id % 5 = 0"), after), "moved")
    archived = rows.withColumn("platform", moved).where("id % 7 = 0")
    views.refresh(changes(archived, archived.withColumn("status", gone)), "archived")
    last = rows.withColumn("platform", moved).withColumn("status", gone).where("id % 13 = 0")
    views.refresh(changes(last, None), "deleted")
    return views.counts().select("view", F.array_join("key", " ").alias("key"), "n")
