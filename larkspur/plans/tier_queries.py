"""Briefing tiers and their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.operators import briefing, graph, ranking, store, tiers
from larkspur.operators.scratch import written
from larkspur.operators.store import active
from larkspur.plans import search_queries as sq
from larkspur.plans.registry import query
from larkspur.plans.store_queries import _COLLAPSED, _TOPICS_SQL, _preview_sql
from larkspur.plans.views import MEMBERS, MEMORIES, members, memories, table

_LINE = f"CASE WHEN length({_COLLAPSED}) <= 200 THEN {_COLLAPSED} ELSE rtrim(substr({_COLLAPSED}, 1, 199)) || '…' END"
_DAY = "strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST(created_minute AS BIGINT)), '%Y-%m-%d')"


def _decimals(score: str) -> str:
    cents = f"CAST(floor(round({score}, 6) * 100 + 0.5) AS BIGINT)"
    return f"CAST({cents} // 100 AS VARCHAR) || '.' || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0')"


_MEMORY_LINE = f"'  - ' || {_LINE} || ' — ' || {_DAY} || CASE WHEN is_pinned THEN ', pinned' ELSE '' END"


def _block(title: str, label: str, lines: str) -> str:
    return f"SELECT '{title}' || chr(10) || '{label}' || chr(10) || string_agg(line, chr(10) ORDER BY place) AS text FROM ({lines})"


def _placed(df: DataFrame, *order) -> DataFrame:
    """A tier's few rows with their place."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)))


_WEIGHED = sq._SCORED.replace("0.30::DOUBLE * importance", "0.5::DOUBLE * importance").replace("0.25::DOUBLE * exp", "0.2::DOUBLE * exp")
assert "0.5::DOUBLE * importance" in _WEIGHED and "0.2::DOUBLE * exp" in _WEIGHED


@query("b4_weights", _WEIGHED + " SELECT id, round(score, 6) AS score FROM scored")
def weights(spark, d):
    """All rows scored with the defaults under a configuration and the values of one call."""
    w = briefing.weights({"importance": 0.4, "recency": "0.2", "unknown": 3}, {"importance": 0.5, "skill": None})
    return sq._scored(spark, d, w).select("id", F.round("score", 6).alias("score"))


@query("b7_tier_budgets", "SELECT p_partkey AS part, tier, CASE WHEN cap > 0 THEN least(cap, t) ELSE t END AS tokens, r AS rows FROM (SELECT p_partkey, tier, p_partkey % 3 * 300 AS cap, CASE tier WHEN 'T0' THEN 120 WHEN 'T1' THEN CASE WHEN p_partkey * 500 < 32000 THEN 400 WHEN p_partkey * 500 < 200000 THEN 800 ELSE 1500 END WHEN 'T2' THEN 500 WHEN 'T3' THEN 1500 ELSE 800 END AS t, CASE tier WHEN 'T0' THEN 0 WHEN 'T1' THEN CASE WHEN p_partkey * 500 < 32000 THEN 8 WHEN p_partkey * 500 < 200000 THEN 15 ELSE 25 END WHEN 'T2' THEN 12 WHEN 'T3' THEN 20 ELSE 15 END AS r FROM part, (VALUES ('T0'), ('T1'), ('T2'), ('T3'), ('T4')) x(tier))")
def tier_budgets(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.explode(F.array(*[F.lit(f"T{i}") for i in range(5)])).alias("tier"))
    tokens, most = briefing.tier_budget(F.col("tier"), F.col("p_partkey") * 500, F.col("p_partkey") % 3 * 300)
    return rows.select(F.col("p_partkey").alias("part"), "tier", tokens.cast("long").alias("tokens"), most.alias("rows"))


@query("b8_t0_persona", "SELECT '# Persona — Ada' || chr(10) || 'Role: engineer' || chr(10) || 'People: ' || (SELECT string_agg(trim(s_name) || ' (' || n_name || ')', ', ' ORDER BY s_suppkey) FROM (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey ORDER BY s_suppkey LIMIT 3)) || chr(10) || 'Projects: ' || (SELECT string_agg(p_name || CASE WHEN p_partkey % 2 = 0 THEN ' [paused]' ELSE '' END, ', ' ORDER BY p_partkey) FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 2)) || chr(10) || 'Remember: tests first; small commits' AS text")
def persona(spark, d):
    n = F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_name"))
    people = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("place"), F.trim("s_name").alias("name"), F.col("n_name").alias("relation"))
    projects = table(spark, d, "part").select(F.col("p_partkey").alias("place"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, "paused").otherwise("active").alias("status"))
    return tiers.persona("Ada", "engineer", people, projects, ["tests first", "small commits"], [])


_TOP_SCORED = f"{sq._SCORED}, top AS (SELECT s.id, s.score, content, m.created_minute, m.is_pinned, row_number() OVER (ORDER BY round(s.score, 9) DESC, s.id) AS place FROM scored s JOIN memories m ON s.id = m.id QUALIFY place <= 8)"


def _lines(spark, d, chosen: DataFrame) -> DataFrame:
    """(place, line) of chosen rows (id, score), best first."""
    rows = chosen.select("id", "score").join(memories(spark, d).select("id", "content", "created_minute", "is_pinned"), "id")
    return _placed(rows, F.desc(F.round("score", 9)), "id").select("place", tiers.memory_line(F.col("content"), F.col("created_minute"), F.col("is_pinned"), F.col("score")).alias("line"))


@query("b10_scored_block", _TOP_SCORED + " " + _block("## T1 — Horizon", "[memories]", f"SELECT place, {_MEMORY_LINE} || ' [score ' || {_decimals('score')} || ']' AS line FROM top"))
def scored_block(spark, d):
    """The lines of the eight best rows, without regard to their likeness."""
    top = sq._scored(spark, d).orderBy(F.desc(F.round("score", 9)), "id").limit(8)
    return tiers.block(_lines(spark, d, top), "## T1 — Horizon", "[memories]", "No memories yet.")


@query("b8_t1_horizon")
def horizon(spark, d):
    """Pool, score, diverse selection, lines: greedy selection has no SQL form."""
    pool = briefing.pool(active(memories(spark, d)), 8).select("id")
    chosen = briefing.select_diverse(sq._scored(spark, d).join(pool, "id", "left_semi"), 8)
    return tiers.block(_lines(spark, d, chosen), "## T1 — Horizon", "[memories]", "No memories yet.")


_ORBIT = f"WITH {MEMORIES}, {MEMBERS}, o AS (SELECT m.* FROM members JOIN memories m ON members.id = m.id WHERE collection = 3 AND status = 'active' AND list_contains({_TOPICS_SQL}, 'ai')), top AS (SELECT *, row_number() OVER (ORDER BY created_minute DESC, id) AS place FROM o QUALIFY place <= 12)"


@query("b8_t2_orbit", _ORBIT + " " + _block("## T2 — Orbit", "[collection:3,topic:ai]", f"SELECT place, {_MEMORY_LINE} AS line FROM top"))
def orbit(spark, d):
    inside = members(spark, d).where("collection = 3").select("id")
    rows = active(memories(spark, d)).join(inside, "id", "left_semi").where(F.array_contains(text.topics(F.col("content")), "ai"))
    top = _placed(store.newest(rows.select("id", "content", "created_minute", "is_pinned"), 12), F.desc("created_minute"), "id")
    return tiers.block(top.select("place", tiers.memory_line(F.col("content"), F.col("created_minute"), F.col("is_pinned")).alias("line")), "## T2 — Orbit", "[collection:3,topic:ai]", "No memories match this collection or topic.")


@query("b8_t3_deep_recall", "WITH found AS (" + sq._hybrid_sql("false") + ") " + f", {MEMORIES.replace('memories AS', 'm AS', 1)} " + _block("## T3 — Deep Recall", "[query:the]", f"SELECT row_number() OVER (ORDER BY score DESC, m.id) AS place, '  - ' || {_LINE} || ' — ' || platform || ', ' || {_DAY} || ' [score ' || {_decimals('score')} || ']' AS line FROM found JOIN m ON found.id = m.id"))
def deep_recall(spark, d):
    rows = sq._hybrid(spark, d, False).join(memories(spark, d).select("id", "content", "platform", "created_minute"), "id")
    lines = _placed(rows, F.desc("score"), "id").select("place", tiers.recall_line(F.col("content"), F.col("platform"), F.col("created_minute"), F.col("score")).alias("line"))
    return tiers.block(lines, "## T3 — Deep Recall", "[query:the]", "No matches for: the")


_ATLAS = f"WITH RECURSIVE {sq._EDGES}, both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), walk AS (SELECT 'llm' AS name, 0 AS depth UNION SELECT b, depth + 1 FROM walk JOIN both_ways ON name = a WHERE depth < 2), r AS (SELECT name, min(depth) AS depth FROM walk GROUP BY name HAVING min(depth) > 0), c AS (SELECT name, count(*) AS n, arg_min(type, created_minute) AS type FROM items GROUP BY name), top AS (SELECT r.name, depth, n, type, row_number() OVER (ORDER BY n DESC, r.name) AS place FROM r JOIN c ON r.name = c.name QUALIFY place <= 15)"


@query("b8_t4_atlas", _ATLAS + " " + _block("## T4 — Atlas", "[entity:llm]", "SELECT place, '  - ' || name || ' (' || type || ', hops=' || CAST(depth AS VARCHAR) || ', seen ' || CAST(n AS VARCHAR) || 'x)' AS line FROM top"))
def atlas(spark, d):
    tagged = sq._tagged(spark, d)
    nodes = graph.nodes(graph.items(tagged))
    near = graph.found_neighbours(written(graph.edges(tagged), "edges"), nodes, "llm", 2).where("found and place <= 15").join(nodes.select("name", "type"), "name")
    lines = near.select("place", tiers.neighbour_line(F.col("name"), F.col("type"), F.col("depth"), F.col("n")).alias("line"))
    return tiers.block(lines, "## T4 — Atlas", "[entity:llm]", "Entity not found in the knowledge graph.")


@query("b10_assembled")
def assembled(spark, d):
    """All tiers, a blank line between."""
    return tiers.assembled([persona(spark, d), horizon(spark, d), orbit(spark, d), deep_recall(spark, d), atlas(spark, d)])


@query("b9_compact_lines", f"WITH {MEMORIES} SELECT id, '[' || content_type || '] ' || {_preview_sql(120, 50)} || ' | ' || platform || ' | ' || {_DAY} AS line FROM memories WHERE status = 'active' AND created_minute > (SELECT max(created_minute) FROM memories) - 48 * 60 ORDER BY created_minute DESC, id LIMIT 5")
def compact_lines(spark, d):
    last = memories(spark, d).agg((F.max("created_minute") - 48 * 60).alias("_from"))
    rows = store.newest(active(memories(spark, d)).join(F.broadcast(last), F.col("created_minute") > F.col("_from")), 5)
    line = F.concat(F.lit("["), "content_type", F.lit("] "), text.preview(F.col("content"), 120, 50), F.lit(" | "), "platform", F.lit(" | "), tiers.day(F.col("created_minute")))
    return rows.select("id", line.alias("line"))


@query("f13_listings", "SELECT 'upload' AS kind, CAST(event_id AS VARCHAR) AS name, row_number() OVER (ORDER BY ts DESC, event_id) AS place FROM events WHERE event_type = 'signup' UNION ALL SELECT 'skill', p_name || ' ' || CAST(p_partkey AS VARCHAR), row_number() OVER (ORDER BY p_size DESC, p_partkey) FROM part UNION ALL SELECT 'file', url, row_number() OVER (ORDER BY url, page_id) FROM pages")
def listings(spark, d):
    """Uploads and skills newest first, files by path, each with its place in its list."""

    def listed(df: DataFrame, kind: str, name, *order) -> DataFrame:
        return ranking.numbered(df, *order).select(F.lit(kind).alias("kind"), name.alias("name"), "place")

    uploads = listed(table(spark, d, "events").where("event_type = 'signup'"), "upload", F.col("event_id").cast("string"), F.desc("ts"), "event_id")
    skills = listed(table(spark, d, "part"), "skill", F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")), F.desc("p_size"), "p_partkey")
    return uploads.unionByName(skills).unionByName(listed(table(spark, d, "pages"), "file", F.col("url"), "url", "page_id"))
