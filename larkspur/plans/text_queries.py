"""Text functions, exchanges and parsers, over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions import fixed, text
from larkspur.operators import exchanges as ex
from larkspur.plans.registry import query
from larkspur.plans.views import MEMORIES, TURNS, memories, table, turns

M = f"WITH {MEMORIES} "


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(map(_quoted, words)) + "]"


#: A planted credential of a different family for each row, so that every pattern is met.
_SECRETS = [" AKIA{}", " ghp_{}{}{}{}", " AIza{}{}abc", " sk-{}{}", " xoxb-{}", " Bearer {}{}", "\nAPI_KEY={}", " postgres://u:{}@h"]


def _secret_spark():
    n = F.lpad(F.col("id").cast("string"), 16, "0")
    parts = [F.concat(*[x for piece in s.split("{}") for x in (F.lit(piece), n)][:-1]) for s in _SECRETS]
    return F.concat(F.col("content"), F.element_at(F.array(*parts), (F.col("id") % 8 + 1).cast("int")))


def _secret_sql() -> str:
    n = "lpad(CAST(id AS VARCHAR), 16, '0')"
    parts = [" || ".join([x for piece in s.replace("\n", "\\n").split("{}") for x in (_quoted(piece).replace("'\\n", "chr(10) || '"), n)][:-1]) for s in _SECRETS]
    return f"content || list_extract([{', '.join(parts)}], CAST(id % 8 + 1 AS BIGINT))"


def _scrub_sql(column: str) -> str:
    """The patterns in order; the two with look-around in a form with groups."""
    for name, pattern, replacement in fixed.CREDENTIALS:
        if name == "aws_secret":
            pattern, replacement = r"(['\"])[A-Za-z0-9/+=]{40}(['\"])", r"\1[REDACTED:aws_secret]\2"
        if name == "hex_secret":
            pattern, replacement = r"(^|[^0-9a-f])[0-9a-f]{64,}($|[^0-9a-f])", r"\1[REDACTED:hex_secret]\2"
        column = f"regexp_replace({column}, {_quoted(pattern)}, {_quoted(replacement.replace('$', chr(92)))}, 'g')"
    return column


@query("t1_scrub", M + f"SELECT id, sha256({_scrub_sql('t')}) AS scrubbed, {_scrub_sql('t')} <> t AS changed FROM (SELECT id, {_secret_sql()} AS t FROM memories)")
def scrub(spark, d):
    rows = memories(spark, d).select("id", _secret_spark().alias("t"))
    rows = rows.select("id", "t", text.scrub(F.col("t")).alias("s"))
    return rows.select("id", F.sha2("s", 256).alias("scrubbed"), (F.col("s") != F.col("t")).alias("changed"))


def _scrub_steps() -> str:
    """SQL expressions of the redactions and of the names that fired, pattern by pattern."""
    counts, names, t = [], [], "t"
    for name, pattern, replacement in fixed.CREDENTIALS:
        if name == "aws_secret":
            pattern, replacement = r"(['\"])[A-Za-z0-9/+=]{40}(['\"])", r"\1[REDACTED:aws_secret]\2"
        if name == "hex_secret":
            pattern, replacement = r"(^|[^0-9a-f])[0-9a-f]{64,}($|[^0-9a-f])", r"\1[REDACTED:hex_secret]\2"
        counts.append(f"len(regexp_extract_all({t}, {_quoted(pattern)}))")
        names.append(f"CASE WHEN len(regexp_extract_all({t}, {_quoted(pattern)})) > 0 THEN {_quoted(name)} END")
        t = f"regexp_replace({t}, {_quoted(pattern)}, {_quoted(replacement.replace('$', chr(92)))}, 'g')"
    return f"{' + '.join(counts)} AS redactions, array_to_string(list_filter([{', '.join(names)}], lambda n: n IS NOT NULL), ',') AS types"


@query("t1_scrub_report", M + f"SELECT id, {_scrub_steps()} FROM (SELECT id, {_secret_sql()} AS t FROM memories)")
def scrub_report(spark, d):
    total, names = text.scrub_report(_secret_spark())
    return memories(spark, d).select("id", total.cast("long").alias("redactions"), F.array_join(names, ",").alias("types"))


_CRED_SQL = " OR ".join(f"regexp_matches(t, {_quoted(p)})" for n, p, _ in fixed.CREDENTIALS if n not in ("aws_secret", "hex_secret"))


@query("t2_has_credentials", M + f"""SELECT id, {_CRED_SQL} OR regexp_matches(t, '[''"][A-Za-z0-9/+=]{{40}}[''"]') OR regexp_matches(t, '(^|[^0-9a-f])[0-9a-f]{{64,}}($|[^0-9a-f])') AS found FROM (SELECT id, CASE WHEN id % 2 = 0 THEN content ELSE {_secret_sql()} END AS t FROM memories)""")
def has_credentials(spark, d):
    t = F.when(F.col("id") % 2 == 0, F.col("content")).otherwise(_secret_spark())
    return memories(spark, d).select("id", text.has_credentials(t).alias("found"))


_STRIPPED = "regexp_replace(t, '^\\s+|\\s+$', '', 'g')"
_POLITE = " OR ".join(f"regexp_matches(s, {_quoted(p)})" for p in fixed.ACKNOWLEDGEMENTS)


_NOISE_SQL = f"""CASE WHEN length(s) < 8 THEN true WHEN length(s) < 100 AND ({_POLITE}) THEN true WHEN length(s) > 200 AND CAST(length(regexp_replace(s, '[^\\p{{L}}]', '', 'g')) AS DOUBLE) / length(s) < 0.3 THEN true WHEN len(string_split(s, chr(10))) > 5 AND CAST(len(list_filter(string_split(s, chr(10)), lambda l: regexp_matches(l, {_quoted(fixed.OUTPUT_LINE.replace(chr(92) + '"', '"'))}))) AS DOUBLE) / len(string_split(s, chr(10))) > 0.6 THEN true ELSE false END"""


@query("t3_noise", f"""WITH {TURNS}, x AS (SELECT conv_id, turn, text AS t FROM turns UNION ALL SELECT doc_id, -1, coalesce(text, '') FROM documents), y AS (SELECT *, {_STRIPPED} AS s FROM x) SELECT conv_id, turn, {_NOISE_SQL} AS noise FROM y""")
def noise(spark, d):
    """Over every turn and, as turn -1, every document."""
    documents = table(spark, d, "documents").select("doc_id", F.lit(-1).cast("long"), F.lit(None).cast("string"), F.coalesce("text", F.lit("")))
    rows = turns(spark, d).union(documents)
    return rows.select("conv_id", "turn", text.is_noise(F.col("text")).alias("noise"))


_SUFFIXES = [" We decided and chose", " def f(): return", " todo: implement", " I prefer my approach", " Turns out a gotcha", " it requires version", ""]


def _suffixed():
    return F.concat(F.col("content"), F.element_at(F.array(*[F.lit(s) for s in _SUFFIXES]), (F.col("id") % 7 + 1).cast("int")))


_SUFFIXED = f"lower(content || list_extract({_list(_SUFFIXES)}, CAST(id % 7 + 1 AS BIGINT)))"
_HITS = {k: f"len(list_filter({_list(w)}, lambda k: contains(t, k)))" for k, w in fixed.TYPE_KEYWORDS.items()}
_BEST = "greatest(" + ", ".join(_HITS.values()) + ")"


@query("t4_classify", M + f"SELECT id, CASE WHEN best = 0 THEN 'raw_exchange' {' '.join(f'WHEN {h} = best THEN {_quoted(k)}' for k, h in _HITS.items())} END AS kind, CASE WHEN best >= 2 THEN CAST(0.85 AS DOUBLE) WHEN best = 1 THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS confidence FROM (SELECT *, {_BEST} AS best FROM (SELECT id, {_SUFFIXED} AS t FROM memories))")
def classify(spark, d):
    kind, confidence = text.classify(_suffixed())
    return memories(spark, d).select("id", kind.alias("kind"), confidence.alias("confidence"))


_RULES = " ".join(f"WHEN len(list_filter({_list(w)}, lambda k: contains(t, k))) > 0 THEN {_quoted(k)}" for k, w in fixed.RULES.items())


@query("t5_rule_type", M + f"SELECT id, CASE {_RULES} ELSE 'raw_exchange' END AS kind FROM (SELECT id, {_SUFFIXED} AS t FROM memories)")
def rule_type(spark, d):
    return memories(spark, d).select("id", text.rule_type(_suffixed()).alias("kind"))


_TOPICS_SQL = f"list_filter({_list(fixed.TOPICS)}, lambda k: contains(lower(content), k))[1:10]"


@query("t6_topics", M + f"SELECT id, array_to_string({_TOPICS_SQL}, ',') AS topics FROM memories")
def topics(spark, d):
    return memories(spark, d).select("id", F.array_join(text.topics(F.col("content")), ",").alias("topics"))


_MARKS = "regexp_replace({}, '([\\p{L}\\p{N}_]+)', chr(2) || '\\1' || chr(3), 'g')"


def _marked(pattern: str) -> str:
    """An entity pattern for texts in which chr(2) begins and chr(3) ends every word, as this
    engine's own word ends are ASCII: marks stand for ends, and inside classes beside word characters."""
    word, space = "\\p{L}\\p{N}_\x02\x03", "[\\s\\p{Z}\\x85\\x1C-\\x1F]+"
    if pattern.startswith(r"\b[\w"):
        pattern = pattern.replace(r"\b[", "[\x02\x03][", 1).replace(r"\.(?:", "\\.\x02(?:").replace(r"\b", "\x03")
    elif pattern.startswith(r"\b[A-Z][a-z]{2,}"):
        pattern = pattern.replace(r"\b", "", 1).replace(r"\b", "").replace("[A-Z][a-z]{2,}", "\x02[A-Z][a-z]{2,}\x03")
    elif pattern.startswith(r"\b"):
        pattern = pattern.replace(r"\b", "\x02", 1).replace(r"\b", "").replace(r"(?:\.\d+)+", "\x03(?:\\.\x02\\d+\x03)+").replace(r"\s+\d+", "\x03\\s+\x02\\d+")
        pattern += "" if "\\d" in pattern else "\x03"
    return pattern.replace(r"\w", word).replace(r"[^\s", "[^\\s\\p{Z}\\x85\\x1C-\\x1F\x02\x03").replace(r"\s+", space).replace(r"\d", "\\p{Nd}")


#: Over marked texts t; the marks are taken out of what is found.
_ENTITY_PARTS = [f"regexp_extract_all({'m' if p.startswith(chr(92) + 'b') else 't'}, {_quoted(_marked(p) if p.startswith(chr(92) + 'b') else _marked(p).replace(chr(2), '').replace(chr(3), ''))}, {g})" for p, g in fixed.ENTITIES]
_ENTITY_PARTS[0] = f"list_filter({_ENTITY_PARTS[0]}, lambda x: contains(x, '.'))"
_ENTITY_ALL = "list_transform(flatten([" + ", ".join(_ENTITY_PARTS) + "]), lambda x: replace(replace(x, chr(2), ''), chr(3), ''))"


@query("t7_entities", M + f"SELECT id, array_to_string(list_filter(e, lambda x, i: list_position(l, lower(x)) = i)[1:15], '|') AS entities FROM (SELECT id, e, list_transform(e, lambda y: lower(y)) AS l FROM (SELECT id, {_ENTITY_ALL} AS e FROM (SELECT id, t, {_MARKS.replace('{}', 't')} AS m FROM (SELECT id, content || ' See https://Docs.Example.com/a and src/été' || CAST(id % 5 AS VARCHAR) || '.py, FastApi fastApi, @scope/pkg' || CAST(id % 3 AS VARCHAR) || ' on Python 3.' || CAST(id % 9 AS VARCHAR) || ' v1.' || CAST(id % 4 AS VARCHAR) || ' by New York Times ' || platform AS t FROM memories))))")
def entities(spark, d):
    n = lambda k: (F.col("id") % k).cast("string")
    t = F.concat("content", F.lit(" See https://Docs.Example.com/a and src/été"), n(5), F.lit(".py, FastApi fastApi, @scope/pkg"), n(3), F.lit(" on Python 3."), n(9), F.lit(" v1."), n(4), F.lit(" by New York Times "), F.col("platform"))
    return memories(spark, d).select("id", F.array_join(text.entities(t), "|").alias("entities"))


_SET = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda w: w <> ''))"


@query("t8_overlap", M + f"SELECT id, CASE WHEN len(x) = 0 OR len(y) = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST(len(list_intersect(x, y)) AS DOUBLE) / len(list_distinct(list_concat(x, y))), 6) END AS overlap FROM (SELECT a.id, {_SET.format('a.content')} AS x, {_SET.format('b.content')} AS y FROM memories a JOIN memories b ON a.id + 1 = b.id)")
def overlap(spark, d):
    m = memories(spark, d).select("id", "content")
    following = m.select((F.col("id") - 1).alias("id"), F.col("content").alias("other"))
    return m.join(following, "id").select("id", F.round(text.overlap(F.col("content"), F.col("other")), 6).alias("overlap"))


_FACTS = f"list_filter(list_transform(regexp_split_to_array(content, '[.!?]+\\s+'), lambda s: trim(s)), lambda s: length(s) BETWEEN 20 AND 300 AND len(list_filter({_list(fixed.FACT_WORDS)}, lambda k: contains(lower(s), k))) > 0)[1:5]"


@query("t9_facts", M + f"SELECT id, len(f) AS n, array_to_string(f, '|') AS facts, round(least(CAST(0.3 AS DOUBLE) + CAST(0.15 AS DOUBLE) * len(f), CAST(1 AS DOUBLE)), 6) AS value FROM (SELECT id, {_FACTS.replace('content', 'c')} AS f FROM (SELECT id, content || '. We decided to keep record ' || CAST(id AS VARCHAR) || '. It must never change! Next time prefer another way now? ok' AS c FROM memories))")
def facts(spark, d):
    c = F.concat(F.col("content"), F.lit(". We decided to keep record "), F.col("id").cast("string"), F.lit(". It must never change! Next time prefer another way now? ok"))
    rows = memories(spark, d).select("id", text.facts(c).alias("f"))
    return rows.select("id", F.size("f").cast("long").alias("n"), F.array_join("f", "|").alias("facts"), F.round(text.fact_value(F.col("f")), 6).alias("value"))


_SENTENCES = "list_filter(list_transform(regexp_split_to_array(regexp_replace(all_text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')) >= 5)"
_WORDS_OF = "list_filter(regexp_split_to_array(lower(sentence), '\\s+'), lambda w: w <> '')"
_DENSITY = f"CAST(len(list_filter({_WORDS_OF}, lambda w: list_contains({_list(fixed.TOPICS)}, w))) AS DOUBLE) / greatest(len({_WORDS_OF}), 1)"


@query("t10_summary", f"""WITH {TURNS}, c AS (SELECT conv_id, count(*) AS n, string_agg(text, ' ' ORDER BY turn) AS all_text, list(text ORDER BY turn) AS texts FROM turns GROUP BY conv_id),
s AS (SELECT conv_id, n, texts, {_SENTENCES} AS sentences FROM c),
u AS (SELECT conv_id, unnest(sentences[1:20]) AS sentence, generate_subscripts(sentences[1:20], 1) AS i FROM s WHERE n >= 2 AND len(sentences) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(1 / (1 + CAST(0.1 AS DOUBLE) * (i - 1)) + 2 * {_DENSITY}, 9) DESC, i DESC) AS rank, count(*) OVER (PARTITION BY conv_id) AS m FROM u),
k AS (SELECT conv_id, 'Key points: ' || string_agg(rtrim(sentence, '.'), '. ' ORDER BY i) || '.' AS summary FROM r WHERE rank <= least(5, greatest(3, m // 3)) GROUP BY conv_id),
p AS (SELECT *, list_filter(list_transform(texts[1:3], lambda t: regexp_replace(substr(t, 1, 150), '^\\s+|\\s+$', '', 'g')), lambda t: t <> '') AS heads FROM s)
SELECT p.conv_id, CASE WHEN n < 2 THEN substr(texts[1], 1, 200) WHEN k.summary IS NOT NULL THEN k.summary WHEN len(heads) > 0 THEN 'Key points: ' || array_to_string(list_transform(heads, lambda t: rtrim(t, '.')), '. ') || '.' ELSE 'Conversation with ' || CAST(n AS VARCHAR) || ' exchanges.' END AS summary FROM p LEFT JOIN k ON p.conv_id = k.conv_id""")
def summary(spark, d):
    return ex.extractive_summaries(turns(spark, d), fixed.TOPICS)


@query("t11_merged_topics", M + f"SELECT session_id, array_to_string(list_sort(list_distinct(flatten(list({_TOPICS_SQL}))))[1:15], ',') AS topics FROM memories GROUP BY session_id")
def merged_topics(spark, d):
    rows = memories(spark, d).select("session_id", text.topics(F.col("content")).alias("t"))
    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("t")))), 1, 15)
    return rows.groupBy("session_id").agg(F.array_join(merged, ",").alias("topics"))


@query("t12_predicates", "SELECT p_partkey AS part, CASE WHEN p = '' THEN 'related_to' ELSE p END AS predicate, lower(trim(p_brand)) AS entity FROM (SELECT p_partkey, p_brand, regexp_replace(regexp_replace(lower(trim(CASE WHEN p_partkey % 9 = 0 THEN ' ?? ' ELSE ' ' || p_type || ' -- ' || p_name END)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS p FROM part)")
def predicates(spark, d):
    p = F.when(F.col("p_partkey") % 9 == 0, " ?? ").otherwise(F.concat(F.lit(" "), "p_type", F.lit(" -- "), "p_name"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), text.predicate(p).alias("predicate"), F.lower(F.trim("p_brand")).alias("entity"))


@query("t14_dates", "SELECT o_orderkey AS k, strftime(TRY_CAST(CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' WHEN o_orderkey % 4 = 1 THEN '2024-13-45' ELSE substr(CAST(o_orderdate AS VARCHAR), 1, 10) END AS DATE), '%Y-%m-%d') AS day FROM orders")
def dates(spark, d):
    k = F.col("o_orderkey")
    s = F.when(k % 4 == 0, "unknown").when(k % 4 == 1, "2024-13-45").otherwise(F.col("o_orderdate").cast("string"))
    return table(spark, d, "orders").select(k.alias("k"), text.iso_date(s).cast("string").alias("day"))


@query("t15_slugs", "SELECT p_partkey AS part, regexp_replace(substr(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), 1, 20), '^-+|-+$', '', 'g') AS slug FROM part")
def slugs(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), text.slug(F.concat("p_name", F.lit(" / "), "p_type"), 20).alias("slug"))


@query("t16_token_estimate", M + "SELECT id, CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, (length(content) + 3) // 4) END AS tokens FROM memories")
def token_estimate(spark, d):
    return memories(spark, d).select("id", text.token_estimate(F.col("content")).cast("long").alias("tokens"))


@query("t17_triple_ids", "SELECT o_orderkey AS k, substr(sha256('customer ' || CAST(o_custkey AS VARCHAR) || '|' || o_orderpriority || '|' || o_orderstatus || '|' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END), 1, 32) AS triple FROM orders")
def triple_ids(spark, d):
    start = F.when(F.col("o_orderkey") % 3 != 0, F.to_date("o_orderdate"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), text.triple_id(F.concat(F.lit("customer "), F.col("o_custkey").cast("string")), F.col("o_orderpriority"), F.col("o_orderstatus"), start).alias("triple"))


_QUESTIONS = ["What did we decide about ", "How did we fix ", "What is our convention for ", "When did we learn about this week ", "recently ", "", "yesterday we discovered "]
_ASKED = f"list_extract({_list(_QUESTIONS)}, CAST(item_id % 7 + 1 AS BIGINT)) || regexp_replace(text, '[^a-zA-Z ]', '', 'g')"
_INTENT_SQL = ", ".join("CASE WHEN " + " OR ".join(f"regexp_matches(q, {_quoted(p)})" for p in ps) + f" THEN {_quoted(k)} END" for k, ps in fixed.INTENTS.items())
_SINCE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(q, '\\b{p}\\b') THEN {n}" for p, n in fixed.TIME_PHRASES.items()) + " END"
_CLEAN_SQL = "q"
for _p in sorted(fixed.DROPPED_PHRASES, key=len, reverse=True):
    _CLEAN_SQL = f"regexp_replace({_CLEAN_SQL}, '\\b{_p}\\b', ' ', 'g')"


@query("t18_intent", f"SELECT item_id, array_to_string(list_filter([{_INTENT_SQL}], lambda x: x IS NOT NULL), ',') AS types, {_SINCE_SQL} AS days, trim(regexp_replace({_CLEAN_SQL}, '\\s+', ' ', 'g')) AS clean FROM (SELECT item_id, lower({_ASKED}) AS q FROM benchmark)")
def intent(spark, d):
    b = table(spark, d, "benchmark")
    q = F.concat(F.element_at(F.array(*[F.lit(x) for x in _QUESTIONS]), (F.col("item_id") % 7 + 1).cast("int")), F.regexp_replace("text", "[^a-zA-Z ]", ""))
    rows = b.select("item_id", q.alias("q"))
    return rows.select("item_id", F.array_join(text.implied_types(F.col("q")), ",").alias("types"), text.since_days(F.col("q")).alias("days"), text.clean_query(F.col("q")).alias("clean"))


_KIND_SQL = f"CASE WHEN {_BEST} = 0 THEN 'raw_exchange' {' '.join(f'WHEN {h} = {_BEST} THEN {_quoted(k)}' for k, h in _HITS.items())} END"
_CONFIDENCE_SQL = f"CASE WHEN {_BEST} >= 2 THEN CAST(0.85 AS DOUBLE) WHEN {_BEST} = 1 THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END"
_OF_LOWER = {k: v.replace("contains(t, k)", "contains(lower(t), k)") for k, v in {"kind": _KIND_SQL, "confidence": _CONFIDENCE_SQL}.items()}


@query("t19_batch_text", M + f"SELECT id, length(t) AS length, {_NOISE_SQL} AS noise, {_OF_LOWER['kind']} AS kind, {_OF_LOWER['confidence']} AS confidence, least(15, len(list_distinct(list_transform({_ENTITY_ALL}, lambda e: lower(e))))) AS entities FROM (SELECT id, t, {_STRIPPED} AS s, {_MARKS.replace('{}', 't')} AS m FROM (SELECT id, {_scrub_sql('content')} AS t FROM memories))")
def batch_text(spark, d):
    """Scrub, noise, class and entities of every text, in one projection."""
    clean = memories(spark, d).select("id", text.scrub(F.col("content")).alias("content"))
    kind, confidence = text.classify(F.col("content"))
    return clean.select("id", F.length("content").alias("length"), text.is_noise(F.col("content")).alias("noise"), kind.alias("kind"), confidence.alias("confidence"), F.size(text.entities(F.col("content"))).alias("entities"))


@query("t20_fences", M + "SELECT id, sha256(trim(regexp_replace(regexp_replace(trim('```json' || chr(10) || content || chr(10) || '```'), '^```[a-zA-Z]*\\s*', ''), '\\s*```$', ''))) AS body, CASE WHEN id % 2 = 0 THEN id END AS n FROM memories")
def fences(spark, d):
    """Fenced texts without their fence, and a field of the fenced JSON (null where it is broken)."""
    raw = F.concat(F.lit("```json\n"), F.col("content"), F.lit("\n```"))
    parsed = F.concat(F.lit('```json\n{"n": '), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, "}").otherwise(","), F.lit("\n```"))
    return memories(spark, d).select("id", F.sha2(text.strip_fence(raw), 256).alias("body"), F.get_json_object(text.strip_fence(parsed), "$.n").cast("long").alias("n"))


_TAGGED = "substr(content, 1, CAST(length(content) // 2 AS BIGINT)) || '<system-reminder>' || chr(10) || 'x</system-reminder>' || repeat(chr(10), 4) || '<command-name>c</command-name>' || substr(content, CAST(length(content) // 2 + 1 AS BIGINT)) || '  '"
_UNTAGGED = _TAGGED
for _t in fixed.NOISE_TAGS:
    _UNTAGGED = f"regexp_replace({_UNTAGGED}, '(?s)<{_t}>.*?</{_t}>', '', 'g')"


@query("s3_noise_tags", M + f"SELECT id, regexp_replace(regexp_replace({_UNTAGGED}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS body FROM memories")
def noise_tags(spark, d):
    half = F.floor(F.length("content") / 2).cast("int")
    c = F.concat(F.substring("content", F.lit(1), half), F.lit("<system-reminder>\nx</system-reminder>\n\n\n\n<command-name>c</command-name>"), F.substring("content", half + 1, F.length("content")), F.lit("  "))
    return memories(spark, d).select("id", text.strip_tags(c).alias("body"))


_HTML = "html"
for _tag in ("script", "style"):
    _HTML = f"regexp_replace({_HTML}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', '', 'g')"
_HTML = f"regexp_replace({_HTML}, '<[^>]+>', ' ', 'g')"
for _e, _c in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " ")):
    _HTML = f"replace({_HTML}, '{_e}', '{_c}')"
_TITLE = "trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'))"
for _e, _c in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''")):
    _TITLE = f"replace({_TITLE}, '{_e}', '{_c}')"


@query("s16_html_text", f"SELECT page_id, {_TITLE} AS title, trim(regexp_replace({_HTML}, '\\s+', ' ', 'g')) AS body FROM pages")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_title(F.col("html")).alias("title"), text.strip_html(F.col("html")).alias("body"))


@query("s6_markdown_blocks", f"WITH {TURNS}, m AS (SELECT conv_id, string_agg('#### ' || role || chr(10) || text, chr(10) ORDER BY turn) AS md FROM turns GROUP BY conv_id), p AS (SELECT conv_id, unnest(regexp_split_to_array(md, '(?m)^####\\s+')) AS part FROM m) SELECT conv_id, trim(split_part(part, chr(10), 1)) AS role, count(*) AS n, CAST(sum(length(part)) AS BIGINT) AS chars FROM p WHERE trim(split_part(part, chr(10), 1)) IN ('user', 'assistant') GROUP BY conv_id, 2")
def markdown_blocks(spark, d):
    line = F.concat(F.lit("#### "), "role", F.lit("\n"), "text")
    md = turns(spark, d).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("md"))
    parts = md.select("conv_id", F.explode(F.split("md", r"(?m)^####\s+")).alias("part"))
    role = F.trim(F.substring_index("part", "\n", 1))
    return parts.where(role.isin("user", "assistant")).groupBy("conv_id", role.alias("role")).agg(F.count("*").alias("n"), F.sum(F.length("part")).alias("chars"))


@query("s21_turn_texts", f"WITH {TURNS} SELECT conv_id, turn, CASE WHEN role = 'user' THEN text ELSE '[' || role || '] ' || text END AS line FROM turns WHERE trim(text) <> ''")
def turn_texts(spark, d):
    return turns(spark, d).where(F.trim("text") != "").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).otherwise(F.concat(F.lit("["), "role", F.lit("] "), "text")).alias("line"))


@query("s22_session_titles", f"WITH {TURNS} SELECT conv_id, arg_min(substr(text, 1, 100), turn) AS title FROM turns WHERE role = 'user' GROUP BY conv_id")
def session_titles(spark, d):
    return turns(spark, d).where("role = 'user'").groupBy("conv_id").agg(F.min_by(F.substring("text", 1, 100), F.col("turn")).alias("title"))


@query("s23_hashes", "SELECT page_id, sha256(html) AS hash FROM pages")
def hashes(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("hash"))


def _exchanges_sql(where: str) -> str:
    return f"""{TURNS}, n AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS exchange FROM turns {where}),
x AS (SELECT conv_id, CAST(exchange AS BIGINT) AS exchange, string_agg(CASE WHEN role = 'user' THEN 'Human: ' ELSE 'Assistant: ' END || text, chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS n_turns, bool_or(role = 'user') AS has_user, bool_or(role <> 'user') AS has_reply FROM n GROUP BY conv_id, exchange)"""


_PAIRS = "WITH " + _exchanges_sql("WHERE role IN ('user', 'assistant')")


@query("e1_exchanges", _PAIRS + " SELECT conv_id, exchange, text, n_turns FROM x WHERE length(text) > 50")
def exchanges(spark, d):
    return ex.accepted(ex.exchanges(turns(spark, d)), 51).select("conv_id", "exchange", "text", "n_turns")


@query("e2_acceptance", "WITH " + _exchanges_sql("WHERE role IN ('user', 'assistant')") + ", " + _exchanges_sql("WHERE role IN ('user', 'assistant') AND length(text) >= 20").replace(TURNS + ", ", "").replace("n AS (", "n2 AS (").replace("x AS (", "x2 AS (").replace("FROM n GROUP", "FROM n2 GROUP") + " SELECT x.conv_id, x.exchange, length(x.text) > 50 AS loose, length(x.text) >= 50 AS hook, coalesce(length(x2.text) >= 200 AND x2.has_user AND x2.has_reply, false) AS strict FROM x LEFT JOIN x2 ON x.conv_id = x2.conv_id AND x.exchange = x2.exchange")
def acceptance(spark, d):
    """Which exchanges each kind of reader takes; the strict one drops turns under 20 characters first."""
    every = ex.exchanges(turns(spark, d)).select("conv_id", "exchange", (F.length("text") > 50).alias("loose"), (F.length("text") >= 50).alias("hook"))
    strict = ex.accepted(ex.exchanges(turns(spark, d).where(F.length("text") >= 20)), 200, both=True).select("conv_id", "exchange", F.lit(True).alias("strict"))
    return every.join(strict, ["conv_id", "exchange"], "left").withColumn("strict", F.coalesce("strict", F.lit(False)))


@query("e3_chunk_attributes", _PAIRS + f" SELECT conv_id, exchange, CASE {_RULES.replace('contains(t,', 'contains(lower(text),')} ELSE 'raw_exchange' END AS kind, array_to_string({_TOPICS_SQL.replace('content', 'text')}, ',') AS topics, CAST(0.9 AS DOUBLE) AS confidence FROM x")
def chunk_attributes(spark, d):
    t = F.col("text")
    return ex.exchanges(turns(spark, d)).select("conv_id", "exchange", text.rule_type(t).alias("kind"), F.array_join(text.topics(t), ",").alias("topics"), F.lit(0.9).alias("confidence"))


@query("e4_summaries", _PAIRS + f" SELECT conv_id, count(*) AS n, array_to_string(list(substr(text, 1, 200) ORDER BY exchange)[1:5], chr(10)) AS summary, array_to_string(list_sort(list_distinct(flatten(list({_TOPICS_SQL.replace('content', 'text')}))))[1:15], ',') AS topics FROM x GROUP BY conv_id HAVING count(*) > 2")
def summaries(spark, d):
    rows = ex.summaries(ex.exchanges(turns(spark, d)), text.topics(F.col("text")))
    return rows.select("conv_id", "n", "summary", F.array_join("topics", ",").alias("topics"))


@query("e5_hook_exchanges", "WITH " + _exchanges_sql("") + " SELECT conv_id, exchange, n_turns, length(text) AS chars FROM x WHERE length(text) >= 50")
def hook_exchanges(spark, d):
    return ex.accepted(ex.exchanges(turns(spark, d), any_reply=True), 50).select("conv_id", "exchange", "n_turns", F.length("text").cast("long").alias("chars"))
