"""Queries over collections, skills' sources, context files, and the pinned vector store."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import fixed, text
from larkspur.operators import briefing, store, writers
from larkspur.operators import exchanges as ex
from larkspur.operators.scratch import scratch_path
from larkspur.operators.store import active
from larkspur.operators.vector_store import Refused, VectorStore
from larkspur.plans.registry import query
from larkspur.plans.search_queries import _OVERLAP, _PAIRS, MV, _flagged
from larkspur.plans.store_queries import _TOPICS_SQL, _preview_sql
from larkspur.plans.text_queries import _PAIRS as _EXCHANGES
from larkspur.plans.views import MEMBERS, MEMORIES, members, memories, table, turns

M = f"WITH {MEMORIES} "
_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: length(s) > 30)"


@query("t6_tech_topics", M + f"SELECT id, array_to_string(list_filter({sorted(fixed.TECH_TOPICS)!r}, lambda k: contains(lower(content), k))[1:10], ',') AS topics FROM memories")
def tech_topics(spark, d):
    return memories(spark, d).select("id", F.array_join(text.tech_topics(F.col("content")), ",").alias("topics"))


@query("e4_log_summaries", _EXCHANGES + f", c AS (SELECT conv_id, count(*) AS n, list_filter(list({_LINES}[1] ORDER BY exchange)[1:5], lambda s: s IS NOT NULL) AS heads, list_sort(list_distinct(flatten(list({_TOPICS_SQL.replace('content', 'text')}))))[1:15] AS t FROM x GROUP BY conv_id HAVING count(*) > 2) SELECT conv_id, n, 'Conversation with ' || n || ' exchanges.' || CASE WHEN len(t) > 0 THEN chr(10) || chr(10) || 'Topics: ' || array_to_string(t, ', ') ELSE '' END || CASE WHEN len(heads) > 0 THEN chr(10) || chr(10) || 'Key points:' || chr(10) || array_to_string(list_transform(heads, lambda s: '- ' || substr(s, 1, 150)), chr(10)) ELSE '' END AS summary FROM c")
def log_summaries(spark, d):
    return ex.log_summaries(ex.exchanges(turns(spark, d)), text.topics(F.col("text"))).select("conv_id", "n", "summary")


@query("m1_collections", f"WITH {MEMBERS}, kept AS (SELECT * FROM members WHERE id % 5 <> 0), last AS (SELECT collection, max(position) AS last FROM kept GROUP BY collection), new AS (SELECT CAST(doc_id % 23 AS INTEGER) AS collection, doc_id AS id FROM documents WHERE doc_id % 20 = 0 OR doc_id % 20 = 1 OR doc_id % 4 = 0) SELECT * FROM kept UNION ALL SELECT collection, id, coalesce(last, -1) + row_number() OVER (PARTITION BY collection ORDER BY id) FROM (SELECT * FROM new ANTI JOIN kept USING (collection, id)) LEFT JOIN last USING (collection)")
def collections(spark, d):
    """Members removed, then added, some of which are present already."""
    d_ = table(spark, d, "documents").select((F.col("doc_id") % 23).cast("int").alias("collection"), F.col("doc_id").alias("id"))
    kept = store.members_removed(members(spark, d), d_.where("id % 5 = 0"))
    return store.members_added(kept, d_.where("id % 20 = 0 or id % 20 = 1 or id % 4 = 0"))


_RECENT = "SELECT id, 1 AS asked FROM (SELECT id FROM a WHERE created_minute >= (SELECT max(created_minute) - 100 FROM a) ORDER BY created_minute DESC, id LIMIT 5)"


@query("b9_compact_fallback", M + f", a AS (SELECT * FROM memories WHERE status = 'active') {_RECENT} UNION ALL SELECT id, 2 FROM (SELECT id FROM a ORDER BY importance DESC, created_minute DESC, id LIMIT 5)")
def compact_fallback(spark, d):
    """Recent memories where there are some, the most important ones where there are none."""
    rows = active(memories(spark, d)).select("id", "created_minute", "importance")
    newest = rows.agg(F.max("created_minute")).first()[0] or 0
    recent = briefing.compact(rows, newest - 100).select("id", F.lit(1).alias("asked"))
    return recent.unionByName(briefing.compact(rows, newest + 1).select("id", F.lit(2).alias("asked")))


_DAY = "strftime(make_timestamp((1704067200 + created_minute * 60) * 1000000), '%Y-%m-%d')"
_KIND = "CASE content_type " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in writers.GROUPS.items()) + " END"


@query("k12_context_lines", M + f", a AS (SELECT * FROM memories WHERE status = 'active' AND created_minute >= 40) SELECT {_KIND} || ': ' || {_preview_sql(200, 100)} || ' | ' || platform || ' | ' || {_DAY} AS line FROM (SELECT * FROM a WHERE content_type IN ('decision', 'learning', 'preference', 'action_item', 'fact') QUALIFY row_number() OVER (PARTITION BY content_type ORDER BY created_minute DESC, id) <= 5) UNION ALL SELECT 'Topic: ' || t || ' (' || n || ')' FROM (SELECT t, count(*) AS n FROM (SELECT unnest({_TOPICS_SQL}) AS t FROM a) GROUP BY t ORDER BY n DESC, t LIMIT 10) UNION ALL SELECT 'Source: ' || platform || ' (' || count(*) || ')' FROM a GROUP BY platform")
def context_lines(spark, d):
    rows = active(memories(spark, d)).select("id", "content", "content_type", "platform", "created_minute", text.topics(F.col("content")).alias("topics"))
    return writers.context_lines(rows, 40).select("line")


@query("d9_details", f"{MV}, {_PAIRS} SELECT 'contradiction' AS kind, a, b, round(score, 3) AS value FROM pairs JOIN memories x ON a = x.id JOIN memories y ON b = y.id WHERE x.platform <> y.platform AND {_OVERLAP} < 0.3 UNION ALL SELECT 'importance', id, NULL, new FROM (SELECT id, importance, round(least(exp(-floor(age_days) / 90) * (1 + 0.1::DOUBLE * ln(1 + access_count)), 1), 4) AS new FROM memories) WHERE abs(new - importance) > 0.001")
def report_details(spark, d):
    """What the consolidation report counts, row by row: flagged contradictions with their
    likeness, and updated importance with its new value."""
    from larkspur.operators import dedup

    a, b = F.col("a"), F.col("b")
    both = _flagged(spark, d).select(F.explode(F.array(F.struct("a", "b"), F.struct(b.alias("a"), a.alias("b")))).alias("p"), F.round("score", 3).alias("value"))
    flagged = both.select(F.lit("contradiction").alias("kind"), "p.a", "p.b", "value")
    new = dedup.recomputed_importance(F.col("age_days"), F.col("access_count"), 90.0)
    changed = memories(spark, d).select("id", "importance", new.alias("new")).where("abs(new - importance) > 0.001")
    return flagged.unionByName(changed.select(F.lit("importance").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), F.col("new").alias("value")))


@query("k2_pinned_store", "SELECT vec_id AS id, round(CAST(embedding[1] AS DOUBLE) * CASE WHEN vec_id % 3 = 0 THEN -1 ELSE 1 END, 6) AS first, 64 AS size, 2 AS refused FROM embeddings")
def pinned_store(spark, d):
    """Vectors upserted twice into a store pinned to their model; another model and another size are refused."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    kept, refused = VectorStore(spark, scratch_path(spark, "pinned")), 0
    kept.upsert(rows, "model a", 64)
    kept.upsert(rows.where("id % 3 = 0").withColumn("vector", F.transform("vector", lambda x: -x)), "model a", 64)
    for model, size in (("model b", 64), ("model a", 32)):
        try:
            kept.upsert(rows, model, size)
        except Refused:
            refused += 1
    return kept.read().select("id", F.round(F.col("vector")[0].cast("double"), 6).alias("first"), F.lit(kept.pin()["size"]).alias("size"), F.lit(refused).alias("refused"))


@query("k9_migrated_vectors", "SELECT vec_id AS id, round(CAST(embedding[2] AS DOUBLE), 6) AS second, (SELECT count(*) FROM embeddings WHERE vec_id % 5 = 0) AS orphans FROM embeddings WHERE vec_id % 5 <> 0")
def migrated_vectors(spark, d):
    """A store copied to an empty one in batches; vectors whose memory is gone stay behind."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    source, target = (VectorStore(spark, scratch_path(spark, n)) for n in ("source", "target"))
    source.upsert(rows, "model a", 64)
    report = target.migrate_from(source, rows.where("id % 5 <> 0").select("id"), batches=4)
    return target.read().select("id", F.round(F.col("vector")[1].cast("double"), 6).alias("second"), F.lit(report.orphans).cast("long").alias("orphans"))


@query("m3_jobs", "WITH base AS (SELECT event_id AS id, event_type AS kind, 'queued' AS status, CAST(NULL AS VARCHAR) AS error, user_id AS total FROM events WHERE event_id % 3 <> 0), change AS (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'done' END AS status, CASE WHEN event_id % 10 = 0 THEN 'failed' END AS error, event_id % 7 AS total FROM events WHERE event_id % 4 = 0) SELECT id, kind, coalesce(c.status, b.status) AS status, coalesce(c.error, b.error) AS error, coalesce(c.total, b.total) AS total FROM base b FULL JOIN change c USING (id)")
def jobs(spark, d):
    """Jobs updated field by field: what a change does not say stays, unknown ids are added."""
    e = table(spark, d, "events")
    base = e.where("event_id % 3 <> 0").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.lit("queued").alias("status"), F.lit(None).cast("string").alias("error"), F.col("user_id").alias("total"))
    i = F.col("event_id")
    change = e.where("event_id % 4 = 0").select(i.alias("id"), F.when(i % 2 == 0, "done").alias("status"), F.when(i % 10 == 0, "failed").alias("error"), (i % 7).alias("total"))
    return store.coalesced(base, change)


@query("b11_snippets", M + "SELECT id, '[' || platform || '/' || content_type || '] ' || CASE WHEN length(c) > 280 THEN substr(c, 1, 277) || '...' ELSE c END AS snippet FROM (SELECT *, trim(replace(content, chr(10), ' ')) AS c FROM memories WHERE status = 'active' ORDER BY created_minute DESC, id LIMIT 40) WHERE c <> ''")
def snippets(spark, d):
    return briefing.snippets(active(memories(spark, d)), 40)


@query("k11_skill_files", "SELECT p_partkey AS skill, '---' || chr(10) || 'name: part-' || p_partkey || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'description: ' || p_name || chr(10) END || CASE WHEN p_size % 2 = 0 THEN '' ELSE 'version: 1.' || p_size || '.0' || chr(10) END || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'tags: [' || p_brand || ', ' || p_type || ']' || chr(10) END || '---' || chr(10) || chr(10) || p_name AS body FROM part")
def skill_files(spark, d):
    p, n = table(spark, d, "part"), F.col("p_partkey")
    version = F.when(F.col("p_size") % 2 == 0, "1.0.0").otherwise(F.concat(F.lit("1."), F.col("p_size").cast("string"), F.lit(".0")))
    tags = F.when(n % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand", "p_type"))
    return p.select(n.alias("skill"), writers.skill_markdown(F.concat(F.lit("part-"), n.cast("string")), F.when(n % 3 == 0, "").otherwise(F.col("p_name")), version, tags, F.col("p_name")).alias("body"))
