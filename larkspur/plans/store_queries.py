"""Filters, paging, facets, exports and mutations over the memory store."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions import fixed, text
from larkspur.operators import store
from larkspur.operators.store import SessionFilter, active, newest
from larkspur.plans.registry import query
from larkspur.plans.views import MEMBERS, MEMORIES, members, memories, table

M = f"WITH {MEMORIES} "


@query("f1_session_filter", M + "SELECT id, platform, content_type, confidence FROM memories WHERE status = 'active' AND platform IN ('src1', 'src2', 'src3') AND platform NOT IN ('src3') AND content_type IN ('fact', 'decision', 'learning') AND confidence >= 0.6")
def session_filter(spark, d):
    f = SessionFilter(["src1", "src2", "src3"], ["src3"], ["fact", "decision", "learning"], 0.6)
    return f.apply(active(memories(spark, d))).select("id", "platform", "content_type", "confidence")


@query("f2_active_rows", M + "SELECT id, status FROM memories WHERE status = 'active'")
def active_rows(spark, d):
    return active(memories(spark, d)).select("id", "status")


@query("f3_user_filter", M + "SELECT id, user_id FROM memories WHERE status = 'active' AND user_id = 'user1'")
def user_filter(spark, d):
    return SessionFilter(user_id="user1").apply(active(memories(spark, d))).select("id", "user_id")


@query("f4_filtered_page", M + "SELECT id, content_type, created_minute FROM memories WHERE status = 'active' AND content_type = 'fact' ORDER BY created_minute DESC, id LIMIT 50 OFFSET 5")
def filtered_page(spark, d):
    return newest(SessionFilter(include_types=["fact"]).apply(active(memories(spark, d))), 50, 5).select("id", "content_type", "created_minute")


@query("f5_counts", M + "SELECT count(*) AS total, count(*) FILTER (WHERE platform = 'src1') AS filtered FROM memories WHERE status = 'active'")
def counts(spark, d):
    return active(memories(spark, d)).agg(F.count("*").alias("total"), F.count_if(F.col("platform") == "src1").alias("filtered"))


@query("f6_since", M + "SELECT id, created_minute FROM memories WHERE status = 'active' AND created_minute > 120 ORDER BY created_minute DESC, id LIMIT 100")
def since(spark, d):
    return newest(active(memories(spark, d)).where("created_minute > 120"), 100).select("id", "created_minute")


@query("f7_top_importance", M + "SELECT id, importance FROM memories WHERE status = 'active' ORDER BY importance DESC, created_minute DESC, id LIMIT 5")
def top_importance(spark, d):
    return active(memories(spark, d)).orderBy(F.desc("importance"), F.desc("created_minute"), "id").limit(5).select("id", "importance")


@query("f8_pinned", M + "SELECT id, created_minute FROM memories WHERE status = 'active' AND is_pinned")
def pinned(spark, d):
    return active(memories(spark, d)).where("is_pinned").select("id", "created_minute")


@query("f9_batch_get", M + ", requested AS (SELECT vec_id AS id FROM embeddings WHERE vec_id % 50 = 0 UNION ALL SELECT -1) SELECT r.id, m.platform, m.content_type FROM requested r LEFT JOIN memories m ON r.id = m.id")
def batch_get(spark, d):
    ids = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("id")).unionByName(spark.range(-1, 0))
    return store.batch_get(ids, memories(spark, d).select("id", "platform", "content_type"))


@query("f10_page_with_total", M + "SELECT id, (SELECT count(*) FROM memories WHERE status = 'active') AS total FROM memories WHERE status = 'active' ORDER BY created_minute DESC, id LIMIT 20 OFFSET 40")
def page_with_total(spark, d):
    return store.page_with_total(active(memories(spark, d)), 3, 20).select("id", "total")


@query("f12_unprocessed_files", "SELECT url AS path, sha256(html) AS hash FROM pages WHERE NOT (page_id % 3 = 0)")
def unprocessed_files(spark, d):
    files = table(spark, d, "pages").select("page_id", F.col("url").alias("path"), F.sha2("html", 256).alias("hash"))
    ledger = files.select("path", F.when(F.col("page_id") % 3 == 0, F.col("hash")).otherwise("old").alias("hash"))
    return store.unprocessed(files, ledger).select("path", "hash")


@query("f13_collections", f"WITH {MEMBERS} SELECT n_nationkey AS collection, n_name AS name, count(id) AS n, coalesce(min(position), -1) AS first_position FROM nation LEFT JOIN members ON n_nationkey = collection GROUP BY n_nationkey, n_name")
def collections(spark, d):
    joined = table(spark, d, "nation").join(members(spark, d), F.col("n_nationkey") == F.col("collection"), "left")
    return joined.groupBy(F.col("n_nationkey").alias("collection"), F.col("n_name").alias("name")).agg(F.count("id").alias("n"), F.coalesce(F.min("position"), F.lit(-1).cast("long")).alias("first_position"))


@query("f14_jobs_page", "SELECT event_id AS job, event_type AS status, (SELECT count(*) FROM events) AS total FROM events ORDER BY ts DESC, event_id LIMIT 500")
def jobs_page(spark, d):
    jobs = table(spark, d, "events")
    limit = max(1, min(10_000, 500))
    total = jobs.agg(F.count("*").alias("total"))
    return jobs.orderBy(F.desc("ts"), "event_id").limit(limit).join(F.broadcast(total)).select(F.col("event_id").alias("job"), F.col("event_type").alias("status"), "total")


@query("f15_topic_filter", M + f", t AS (SELECT id, list_filter({fixed.TOPICS!r}, lambda k: contains(lower(content), k))[1:10] AS topics FROM memories WHERE status = 'active') SELECT id FROM t WHERE list_contains(topics, 'ai')")
def topic_filter(spark, d):
    rows = active(memories(spark, d)).select("id", text.topics(F.col("content")).alias("topics"))
    return rows.where(F.exists("topics", lambda t: F.lower(t) == "ai")).select("id")


@query("f16_watcher_log", "SELECT user_id AS tool, CAST(sum(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) AS BIGINT) AS captured FROM events WHERE event_type LIKE 'c%' GROUP BY user_id")
def watcher_log(spark, d):
    """The numbers in the messages of one kind, summed for each tool."""
    log = table(spark, d, "events").where(F.col("event_type").like("c%"))
    return log.groupBy(F.col("user_id").alias("tool")).agg(F.sum(F.regexp_extract("props", "([0-9]+)", 1).cast("long")).alias("captured"))


def _preview_sql(size: int, least: int) -> str:
    flat = "trim(replace(content, chr(10), ' '))"
    head = f"substr({flat}, 1, {size})"
    space = f"({size} + 1 - strpos(reverse({head}), ' '))"
    return f"CASE WHEN length({flat}) <= {size} THEN {flat} ELSE CASE WHEN strpos(reverse({head}), ' ') > 0 AND {space} - 1 > {least} THEN substr({head}, 1, CAST({space} - 1 AS BIGINT)) ELSE {head} END || '...' END"


_COLLAPSED = "trim(regexp_replace(content, '\\s+', ' ', 'g'))"


@query("f17_previews", M + f"SELECT id, {_preview_sql(160, 80)} AS long, {_preview_sql(120, 50)} AS short, CASE WHEN length({_COLLAPSED}) <= 200 THEN {_COLLAPSED} ELSE rtrim(substr({_COLLAPSED}, 1, 199)) || '…' END AS line FROM memories")
def previews(spark, d):
    c = F.col("content")
    return memories(spark, d).select("id", text.preview(c, 160).alias("long"), text.preview(c, 120, 50).alias("short"), text.preview_collapsed(c).alias("line"))


@query("f18_detail_levels", M + "SELECT id, content_type || ' | ' || platform AS label, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN substr(content, 1, 40) ELSE content END AS body FROM memories")
def detail_levels(spark, d):
    level = F.col("id") % 3
    body = F.when(level == 1, F.substring("content", 1, 40)).when(level == 2, F.col("content"))
    return memories(spark, d).select("id", F.concat_ws(" | ", "content_type", "platform").alias("label"), body.alias("body"))


@query("a1_per_platform", M + "SELECT platform, count(*) AS n FROM memories WHERE status = 'active' GROUP BY platform")
def per_platform(spark, d):
    return active(memories(spark, d)).groupBy("platform").agg(F.count("*").alias("n"))


@query("a2_source_share", M + "SELECT platform, count(*) AS n, round(CAST(count(*) * 100.0 AS DOUBLE) / sum(count(*)) OVER (), 1) AS share FROM memories WHERE status = 'active' GROUP BY platform")
def source_share(spark, d):
    return store.facet(active(memories(spark, d)), "platform")


_TOPICS_SQL = f"list_filter({fixed.TOPICS!r}, lambda k: contains(lower(content), k))[1:10]"


@query("a3_topic_facet", M + f"SELECT topic, count(*) AS n FROM (SELECT unnest({_TOPICS_SQL}) AS topic FROM memories WHERE status = 'active') GROUP BY topic")
def topic_facet(spark, d):
    return store.topic_facet(active(memories(spark, d)), text.topics(F.col("content")))


@query("a4_top_topics", M + f"SELECT topic, count(*) AS n FROM (SELECT unnest({_TOPICS_SQL}) AS topic FROM memories WHERE status = 'active') GROUP BY topic ORDER BY n DESC, topic LIMIT 3")
def top_topics(spark, d):
    return store.topic_facet(active(memories(spark, d)), text.topics(F.col("content"))).orderBy(F.desc("n"), "topic").limit(3)


@query("a5_collection_sizes", f"WITH {MEMBERS} SELECT n_nationkey AS collection, count(id) AS n FROM nation LEFT JOIN members ON n_nationkey = collection GROUP BY n_nationkey")
def collection_sizes(spark, d):
    sizes = members(spark, d).groupBy("collection").agg(F.count("*").alias("n"))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("collection")).join(sizes, "collection", "left").select("collection", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("a6_overview", M + f""", {MEMBERS}, a AS (SELECT * FROM memories WHERE status = 'active'), t AS (SELECT unnest({_TOPICS_SQL}) AS topic FROM a)
SELECT 'total' AS part, '' AS name, (SELECT count(*) FROM a) AS n UNION ALL SELECT 'pinned', '', (SELECT count(*) FROM a WHERE is_pinned)
UNION ALL SELECT 'source', platform, count(*) FROM a GROUP BY platform
UNION ALL SELECT 'collection', n_name, (SELECT count(*) FROM members WHERE collection = n_nationkey) FROM nation
UNION ALL SELECT 'watcher', event_type, count(*) FROM events GROUP BY event_type
UNION ALL (SELECT 'topic', topic, count(*) AS n FROM t GROUP BY topic ORDER BY n DESC, topic LIMIT 10)""")
def overview(spark, d):
    """Totals, sources, collection sizes, top topics and watchers, as (part, name, n)."""
    rows = active(memories(spark, d))
    part = lambda df, name, column: df.select(F.lit(name).alias("part"), F.col(column).alias("name"), "n")
    totals = rows.agg(F.count("*").alias("total"), F.count_if("is_pinned").alias("pinned"))
    totals = totals.select(F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.lit("").alias("name"), F.col(c).alias("n")) for c in ("total", "pinned")])).alias("x")).select("x.*")
    sources = rows.groupBy("platform").agg(F.count("*").alias("n"))
    sizes = members(spark, d).groupBy("collection").agg(F.count("*").alias("n"))
    collections_ = table(spark, d, "nation").join(sizes, F.col("n_nationkey") == F.col("collection"), "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n"))
    topics_ = store.topic_facet(rows, text.topics(F.col("content"))).orderBy(F.desc("n"), "topic").limit(10)
    watchers = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return totals.union(part(sources, "source", "platform")).union(part(collections_, "collection", "n_name")).union(part(topics_, "topic", "topic")).union(part(watchers, "watcher", "event_type"))


_RECENT = "w AS (SELECT * FROM memories WHERE status = 'active' AND created_minute > (SELECT max(created_minute) FROM memories) - 48 * 60)"


@query("a7_window_briefing", M + f""", {_RECENT}, t AS (SELECT unnest({_TOPICS_SQL}) AS topic FROM w)
SELECT 'total' AS part, '' AS name, (SELECT count(*) FROM w) AS n UNION ALL SELECT 'platform', platform, count(*) FROM w GROUP BY platform
UNION ALL (SELECT 'topic', topic, count(*) AS n FROM t GROUP BY topic ORDER BY n DESC, topic LIMIT 10)
UNION ALL (SELECT 'latest', CAST(id AS VARCHAR), created_minute FROM w ORDER BY created_minute DESC, id LIMIT 10)""")
def window_briefing(spark, d):
    """The last 48 hours: total, counts by platform, top ten topics, ten latest rows."""
    last = memories(spark, d).agg((F.max("created_minute") - 48 * 60).alias("_from"))
    rows = active(memories(spark, d)).join(F.broadcast(last), F.col("created_minute") > F.col("_from")).drop("_from")
    part = lambda df, name, column, n="n": df.select(F.lit(name).alias("part"), F.col(column).cast("string").alias("name"), F.col(n).alias("n"))
    total = rows.agg(F.count("*").alias("n")).select(F.lit("total").alias("part"), F.lit("").alias("name"), "n")
    platforms = rows.groupBy("platform").agg(F.count("*").alias("n"))
    topics_ = store.topic_facet(rows, text.topics(F.col("content"))).orderBy(F.desc("n"), "topic").limit(10)
    return total.union(part(platforms, "platform", "platform")).union(part(topics_, "topic", "topic")).union(part(newest(rows, 10), "latest", "id", "created_minute"))


@query("a9_watcher_totals", "SELECT event_type AS tool, CAST(sum(event_id % 90) AS BIGINT) AS captured, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_captured, count(*) FILTER (WHERE CAST(ts AS DATE) = DATE '2024-01-31') AS today FROM events GROUP BY event_type")
def watcher_totals(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("tool")).agg(F.sum(F.col("event_id") % 90).alias("captured"), F.unix_timestamp(F.max("ts").cast("timestamp")).alias("last_captured"), F.count_if(F.to_date("ts") == F.lit("2024-01-31").cast("date")).alias("today"))


@query("j2_collection_members", M + f", {MEMBERS} SELECT collection, m.id, platform, row_number() OVER (PARTITION BY collection ORDER BY position, m.id) AS place FROM members JOIN memories m ON members.id = m.id")
def collection_members(spark, d):
    order = Window.partitionBy("collection").orderBy("position", "id")
    return members(spark, d).join(memories(spark, d).select("id", "platform"), "id").select("collection", "id", "platform", F.row_number().over(order).cast("long").alias("place"))


@query("j3_collections_of_memory", f"WITH {MEMBERS} SELECT id, string_agg(n_name, ',' ORDER BY n_name) AS names FROM members JOIN nation ON collection = n_nationkey GROUP BY id")
def collections_of_memory(spark, d):
    joined = members(spark, d).join(F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_name")), F.col("collection") == F.col("n_nationkey"))
    return joined.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@query("j10_siblings", M + "SELECT a.id AS raw, b.id AS enriched FROM memories a JOIN memories b ON a.id + 1 = b.id WHERE a.id % 2 = 0 AND a.platform <> b.platform")
def siblings(spark, d):
    m = memories(spark, d).select("id", "platform")
    raw = m.where("id % 2 = 0").select((F.col("id") + 1).alias("id"), F.col("id").alias("raw"), F.col("platform").alias("_p"))
    return raw.join(m, "id").where("platform <> _p").select("raw", F.col("id").alias("enriched"))


@query("k1_upsert", M + "SELECT id, platform, importance, version FROM (SELECT id, platform, importance, 1 AS version FROM memories WHERE id % 5 <> 0 UNION ALL SELECT id + 0, 'new', CAST(1.0 AS DOUBLE), 2 FROM memories WHERE id % 7 = 0) QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1")
def upsert(spark, d):
    m = memories(spark, d)
    base = m.where("id % 5 <> 0").select("id", "platform", "importance", F.lit(1).alias("version"))
    return store.upsert(base, m.where("id % 7 = 0").select("id", F.lit("new").alias("platform"), F.lit(1.0).alias("importance"), F.lit(2).alias("version")))


@query("k3_vector_delete", "SELECT vec_id AS id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 17 = 0)")
def vector_delete(spark, d):
    gone = table(spark, d, "documents").where("doc_id % 17 = 0").select(F.col("doc_id").alias("id"))
    return store.delete(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), gone)


@query("k5_embedding_pin", "SELECT min(len(embedding)) AS least, max(len(embedding)) AS most, count(*) AS n FROM embeddings")
def embedding_pin(spark, d):
    size = F.size("embedding").cast("long")
    return table(spark, d, "embeddings").agg(F.min(size).alias("least"), F.max(size).alias("most"), F.count("*").alias("n"))


@query("k6_export", M + """SELECT id, '{"id":' || CAST(id AS VARCHAR) || ',"platform":"' || platform || '","type":"' || content_type || '","pinned":' || CASE WHEN is_pinned THEN 'true' ELSE 'false' END || '}' AS json FROM memories WHERE status = 'active' ORDER BY id LIMIT 1000""")
def export(spark, d):
    rows = active(memories(spark, d)).orderBy("id").limit(1000)
    return rows.select("id", F.to_json(F.struct("id", "platform", F.col("content_type").alias("type"), F.col("is_pinned").alias("pinned"))).alias("json"))


@query("k11_skill_markdown", "SELECT p_partkey AS skill, '# ' || p_name || chr(10) || chr(10) || 'Tags: ' || p_brand || ', ' || p_type AS body FROM part")
def skill_markdown(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("skill"), F.concat(F.lit("# "), "p_name", F.lit("\n\nTags: "), F.concat_ws(", ", "p_brand", "p_type")).alias("body"))


@query("m1_batch_status", M + "SELECT id, CASE WHEN id IN (SELECT vec_id FROM embeddings WHERE label = 3) THEN 'archived' ELSE status END AS status, is_pinned OR id % 10 = 1 AS is_pinned FROM memories")
def batch_status(spark, d):
    hit = table(spark, d, "embeddings").where("label = 3").select(F.col("vec_id").alias("id"), F.lit(True).alias("_hit"))
    rows = memories(spark, d).join(hit, "id", "left")
    return store.patched(rows, F.coalesce("_hit", F.lit(False)), status=F.lit("archived")).select("id", "status", (F.col("is_pinned") | (F.col("id") % 10 == 1)).alias("is_pinned"))


@query("m2_soft_delete", M + "SELECT id, CASE WHEN id % 13 = 0 THEN 'archived' ELSE status END AS status, id % 13 <> 0 AND vec_id IS NOT NULL AS has_vector FROM memories LEFT JOIN embeddings ON id = vec_id")
def soft_delete(spark, d):
    """Rows deleted are archived, and their vectors go."""
    m = memories(spark, d).select("id", "status")
    gone = m.where("id % 13 = 0").select("id")
    rows = store.patched(m, F.col("id") % 13 == 0, status=F.lit("archived"))
    left = store.delete(table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), gone)
    return rows.join(left.withColumn("_v", F.lit(True)), "id", "left").select("id", "status", F.coalesce("_v", F.lit(False)).alias("has_vector"))


@query("m3_coalesced_update", "SELECT p_partkey AS skill, coalesce(CASE WHEN p_size > 25 THEN 'renamed ' || p_name END, p_name) AS name FROM part")
def coalesced_update(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("skill"), F.coalesce(F.when(F.col("p_size") > 25, F.concat(F.lit("renamed "), F.col("p_name"))), F.col("p_name")).alias("name"))


@query("r9_access_log", M + ", log AS (SELECT user_id AS id, event_id AS seen FROM events) SELECT m.id, access_count + count(log.id) AS access_count, max(seen) AS last_accessed FROM memories m LEFT JOIN log ON m.id = log.id GROUP BY m.id, access_count")
def access_log(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("at"))
    return store.access_counts(memories(spark, d).select("id", "access_count"), log)


@query("s18_import", f"""WITH i AS (SELECT doc_id AS id, text, CASE WHEN doc_id % 4 = 0 THEN 'nonsense' ELSE 'decision' END AS kind, CASE WHEN doc_id % 5 = 0 THEN 'elsewhere' ELSE source END AS place FROM documents),
ok AS (SELECT *, text IS NOT NULL AND trim(text) <> '' AS good FROM i)
SELECT id, CASE WHEN NOT good THEN 'error' WHEN kind IN ({', '.join(repr(t) for t in fixed.CONTENT_TYPES)}) THEN kind ELSE 'fact' END AS content_type, CASE WHEN place LIKE 'src%' THEN place ELSE 'unknown' END AS platform, count(*) FILTER (WHERE good) OVER () AS imported, count(*) FILTER (WHERE NOT good) OVER () AS errors, count(*) OVER () AS total FROM ok""")
def import_rows(spark, d):
    """Items with unknown types and platforms set to their defaults, blank ones as errors, and the counts."""
    items = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.when(F.col("doc_id") % 4 == 0, "nonsense").otherwise("decision").alias("kind"), F.when(F.col("doc_id") % 5 == 0, "elsewhere").otherwise(F.col("source")).alias("place"))
    rows = store.imported(items, fixed.CONTENT_TYPES, F.col("place").like("src%"))
    counts = rows.agg(F.count_if(F.col("content_type") != "error").alias("imported"), F.count_if(F.col("content_type") == "error").alias("errors"), F.count("*").alias("total"))
    return rows.join(F.broadcast(counts))


@query("x_sales_by_segment", "SELECT c_mktsegment AS segment, count(DISTINCT o_orderkey) AS orders, round(sum(CAST(l_extendedprice * (1 - l_discount) AS DOUBLE)), 0) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY c_mktsegment")
def sales_by_segment(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey", "c_mktsegment"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_extendedprice", "l_discount")
    # One row per order before the joins: the large table shuffles once, pre-aggregated.
    per_order = lines.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    joined = per_order.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("orders"), F.round(F.sum("r"), 0).alias("revenue"))
