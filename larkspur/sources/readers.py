"""Readers of conversation exports and documents.

Every conversation reader gives (path, conv_id, turn, role, text), blank texts and
other roles than user and assistant dropped, so that ``operators.exchanges`` takes its
output as it is.  Files are read by Spark's readers only, from any store.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import text as T

# Folders that are never searched.
EXCLUDED = [".git", "node_modules", "__pycache__", ".venv", "venv"]
TEXT_TYPES = ["text/plain", "text/markdown", "text/csv", "text/html", "application/json", "application/xml", "text/xml"]
MOST_BYTES = 10 * 1024 * 1024


def discover(spark: SparkSession, path: str, glob: str = "*", exclude: list[str] = EXCLUDED) -> DataFrame:
    """(path, modificationTime, length) of files, newest first; a file goes if one of its
    path's segments matches an excluded glob.  Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "modificationTime", "length")
    patterns = ["^" + re.escape(g).replace(r"\*", ".*").replace(r"\?", ".") + "$" for g in exclude]
    hidden = F.exists(F.split("path", "/"), lambda s: _any(s, patterns))
    return files.where(~hidden).orderBy(F.desc("modificationTime"), "path")


def _any(segment: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | segment.rlike(p)
    return out


def _turns(df: DataFrame) -> DataFrame:
    kept = df.where(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    return kept.select("path", "conv_id", "turn", "role", "text")


def _block_text(v: Column) -> Column:
    """The text of a content variant: a string, or the text blocks of an array."""
    blocks = F.from_json(F.to_json(v), "array<struct<type: string, text: string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: (F.coalesce(b["type"], F.lit("text")) == "text") & b["text"].isNotNull()), lambda b: b["text"]), "\n")
    plain = F.try_variant_get(v, "$", "string")
    return F.when(F.schema_of_variant(v) == "STRING", plain).otherwise(joined)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of turns; lines that are no JSON are skipped.  The role is ``role`` or
    else ``type``; the text is in ``message.content`` or ``content``."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("turn"), F.try_parse_json("value").alias("v")).where("v is not null")
    role = F.coalesce(F.try_variant_get("v", "$.message.role", "string"), F.try_variant_get("v", "$.role", "string"), F.try_variant_get("v", "$.type", "string"))
    content = F.coalesce(F.try_variant_get("v", "$.message.content", "variant"), F.try_variant_get("v", "$.content", "variant"))
    return _turns(lines.select("path", F.col("path").alias("conv_id"), "turn", F.when(role == "human", "user").otherwise(role).alias("role"), T.strip_tags(_block_text(content)).alias("text")))


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def read_tree_export(spark: SparkSession, path: str) -> DataFrame:
    """Exports whose conversations map node ids to messages; ordered by time, a missing one first."""
    message = "struct<author: struct<role: string>, content: struct<parts: array<string>>, create_time: double>"
    schema = f"array<struct<id: string, title: string, mapping: map<string, struct<message: {message}>>>>"
    convs = _whole(spark, path).select("path", F.posexplode(F.from_json("value", schema)).alias("n", "c"))
    nodes = convs.select("path", F.concat_ws("#", "path", F.coalesce("c.id", F.col("n").cast("string"))).alias("conv_id"), F.posexplode(F.map_values("c.mapping")).alias("i", "m"))
    parts = F.array_join(F.filter("m.message.content.parts", lambda p: p.isNotNull()), "\n")
    order = Window.partitionBy("conv_id").orderBy(F.coalesce("m.message.create_time", F.lit(0.0)), "i")
    return _turns(nodes.select("path", "conv_id", F.row_number().over(order).cast("long").alias("turn"), F.col("m.message.author.role").alias("role"), parts.alias("text")))


def read_web_export(spark: SparkSession, path: str) -> DataFrame:
    """Arrays of conversations with ``chat_messages`` of ``sender`` human or assistant."""
    schema = "array<struct<uuid: string, name: string, chat_messages: array<struct<sender: string, text: string, content: string>>>>"
    convs = _whole(spark, path).select("path", F.posexplode(F.from_json("value", schema)).alias("n", "c"))
    rows = convs.select("path", F.concat_ws("#", "path", F.coalesce("c.uuid", F.col("n").cast("string"))).alias("conv_id"), F.posexplode("c.chat_messages").alias("turn", "m"))
    blocks = _block_text(F.try_parse_json("m.content"))
    body = F.when(F.trim(F.coalesce("m.text", F.lit(""))) != "", F.col("m.text")).when(F.try_parse_json("m.content").isNotNull(), blocks).otherwise(F.col("m.content"))
    return _turns(rows.select("path", "conv_id", F.col("turn").cast("long").alias("turn"), F.when(F.col("m.sender") == "human", "user").otherwise(F.col("m.sender")).alias("role"), body.alias("text")))


def read_session_json(spark: SparkSession, path: str) -> DataFrame:
    """``{"messages": [..]}`` or a bare array of turns with ``content`` or ``parts``."""
    v = _whole(spark, path).select("path", F.try_parse_json("value").alias("v")).where("v is not null")
    items = F.from_json(F.to_json(F.coalesce(F.try_variant_get("v", "$.messages", "variant"), F.col("v"))), "array<struct<role: string, content: string, parts: array<struct<text: string>>>>")
    rows = v.select("path", F.posexplode(items).alias("turn", "m"))
    parts = F.array_join(F.transform(F.col("m.parts"), lambda p: p["text"]), "\n")
    content = F.when(F.try_parse_json("m.content").isNotNull() & F.startswith(F.col("m.content"), F.lit("[")), _block_text(F.try_parse_json("m.content"))).otherwise(F.col("m.content"))
    role = F.when(F.col("m.role") == "model", "assistant").otherwise(F.col("m.role"))
    return _turns(rows.select("path", F.col("path").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.coalesce(content, parts).alias("text")))


def read_markdown(spark: SparkSession, path: str, style: str = "blocks") -> DataFrame:
    """Markdown logs: ``blocks`` start with four number signs and a role, ``headings``
    with one or two before user or assistant."""
    pattern = r"(?m)^####\s+" if style == "blocks" else r"(?mi)^#{1,2}\s+(?=(?:user|assistant)\b)"
    rows = _whole(spark, path).select("path", F.posexplode(F.split("value", pattern)).alias("turn", "part"))
    cut = F.split("part", "\n", 2)
    return _turns(rows.select("path", F.col("path").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lower(F.trim(cut[0])).alias("role"), F.regexp_replace(F.try_element_at(cut, F.lit(2)), r"^\s+|\s+$", "").alias("text")))


# Keys of an editor's key-value store that hold chats, and of text inside them.
CHAT_KEYS = ["chat", "composer", "conversation", "aichat"]
TEXT_KEYS = ("text", "content", "message", "richText", "markdown")


def walk_json(value: str | None) -> list[str]:
    """All strings under text keys, at any depth."""
    try:
        todo = [json.loads(value or "null")]
    except ValueError:
        return []
    out = []
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            out += [v for k, v in x.items() if k in TEXT_KEYS and isinstance(v, str) and v.strip()]
            todo += [v for v in reversed(list(x.values())) if isinstance(v, dict | list)]
        elif isinstance(x, list):
            todo += [v for v in reversed(x) if isinstance(v, dict | list)]
    return out


def editor_chunks(table: DataFrame) -> DataFrame:
    """(key, text, confidence) from key-value rows whose key speaks of chats; texts of 50
    characters or more, cut at 4000."""

    @F.pandas_udf("array<string>")
    def walk(values: pd.Series) -> pd.Series:
        return values.map(walk_json)

    chats = table.where(_any(F.lower("key"), CHAT_KEYS))
    texts = chats.select("key", F.explode(walk(F.col("value").cast("string"))).alias("text"))
    return texts.where(F.length("text") >= 50).select("key", F.substring("text", 1, 4000).alias("text"), F.lit(0.6).alias("confidence"))


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while i < len(data) and shift < 70:
        b = data[i]
        value |= (b & 0x7F) << shift
        i, shift = i + 1, shift + 7
        if not b & 0x80:
            return value, i
    raise ValueError("no end")


def readable(text: str) -> bool:
    return bool(text.strip()) and sum(c.isprintable() or c in "\n\r\t" for c in text) / len(text) >= 0.85


def wire_strings(data: bytes, least: int = 10, depth: int = 0) -> list[str]:
    """Readable strings of a wire-format message: length-delimited fields that are text,
    or else messages to look into."""
    out: list[str] = []
    i = 0
    try:
        while i < len(data):
            tag, i = _varint(data, i)
            kind = tag & 7
            if kind == 0:
                _, i = _varint(data, i)
            elif kind in (1, 5):
                i += 8 if kind == 1 else 4
            elif kind == 2:
                n, i = _varint(data, i)
                field = data[i : i + n]
                i += n
                if len(field) < n:
                    break
                try:
                    text = field.decode()
                except UnicodeDecodeError:
                    text = ""
                if len(text) >= least and readable(text):
                    out.append(text)
                elif depth < 30:
                    out += wire_strings(field, least, depth + 1)
            else:
                break
    except ValueError:
        pass
    return out


def binary_chunks(files: DataFrame) -> DataFrame:
    """(path, chunk, text, confidence) from wire-format files (path, content): strings three
    by three, over 50 characters; files without any fall back to runs of printable bytes."""

    @F.pandas_udf("array<string>")
    def strings(content: pd.Series) -> pd.Series:
        return content.map(lambda b: wire_strings(bytes(b)))

    runs = F.regexp_extract_all(F.decode("content", "ISO-8859-1"), F.lit(r"[\x20-\x7e\t\n\r]{20,}"), F.lit(0))
    found = files.select("path", strings("content").alias("s"), runs.alias("r"))
    found = found.select("path", F.posexplode(F.when(F.size("s") > 0, F.col("s")).otherwise(F.col("r"))).alias("i", "text"))
    grouped = found.groupBy("path", F.floor(F.col("i") / 3).alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return grouped.where(F.length("text") > 50).withColumn("confidence", F.lit(0.7))


def read_documents(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """(path, mime, text, hash) of text-like files up to 10 MB, by their extension; HTML is
    stripped, empty texts dropped."""
    types = types or {"txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "html": "text/html", "htm": "text/html", "json": "application/json", "xml": "application/xml"}
    mime = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])[F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = files.where((F.col("length") <= MOST_BYTES) & mime.isin(TEXT_TYPES)).select("path", mime.alias("mime"), F.decode("content", "UTF-8").alias("raw"), F.sha2("content", 256).alias("hash"))
    body = F.when(F.col("mime") == "text/html", T.strip_html(F.col("raw"))).otherwise(F.col("raw"))
    return rows.select("path", "mime", body.alias("text"), "hash").where(F.trim("text") != "")


def frontmatter(text: Column) -> tuple[Column, Column]:
    """(map of fields, body) of a document that opens with a fenced header: scalars without their
    quotes, lists, in brackets or on lines of their own, as JSON arrays.  Line ends and a byte order
    mark do not matter; lines of another form are skipped."""
    plain = F.regexp_replace(F.regexp_replace(text, "\\r\\n?", "\n"), "^\ufeff", "")
    pattern = r"(?s)^---\n(.*?)\n---\n?(.*)$"
    has = plain.rlike(pattern)

    @F.pandas_udf("map<string, string>")
    def fields(heads: pd.Series) -> pd.Series:
        return heads.map(lambda h: None if h is None else header_fields(h))

    head = F.when(has, F.regexp_extract(plain, pattern, 1))
    body = F.regexp_replace(F.regexp_extract(plain, pattern, 2), "^\n+", "")
    return fields(head), F.when(has, body).otherwise(text)


def _unquoted(value: str) -> str:
    value = value.strip()
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value


#: Items between commas; a quoted part may hold some.
_ITEMS = re.compile(r"""((?:"[^"]*"?|'[^']*'?|[^,"'])*),?""")


def header_fields(head: str) -> dict[str, str]:
    out: dict[str, str | list[str]] = {}
    block: list[str] | None = None
    for line in map(str.rstrip, head.split("\n")):
        if not line:
            continue
        if block is not None and (item := re.match(r"\s+-\s+(.*)$", line)):
            block.append(_unquoted(item[1]))
            continue
        block = None
        if not (pair := re.match(r"([A-Za-z_][\w-]*)\s*:\s*(.*)$", line)):
            continue
        value = pair[2].strip()
        if not value:
            out[pair[1]] = block = []
        elif value[0] == "[" and value[-1] == "]":
            out[pair[1]] = [_unquoted(x) for x in _ITEMS.findall(value[1:-1]) if x.strip()]
        else:
            out[pair[1]] = _unquoted(value)
    return {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in out.items()}


# Retrieval corpora ---------------------------------------------------------------


def questions_with_haystacks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sessions, queries) from questions that carry their sessions."""
    turn = "array<struct<role: string, content: string>>"
    schema = f"array<struct<question_id: string, question: string, question_type: string, haystack_session_ids: array<string>, haystack_sessions: array<{turn}>, answer_session_ids: array<string>>>"
    q = _whole(spark, path).select(F.explode(F.from_json("value", schema)).alias("q")).select("q.*")
    queries = q.select(F.col("question_id").alias("id"), F.col("question").alias("text"), F.col("answer_session_ids").alias("gold"), F.col("question_type").alias("category"))
    pairs = q.select(F.explode(F.arrays_zip(F.col("haystack_session_ids").alias("session_id"), F.col("haystack_sessions").alias("turns"))).alias("s"))
    sessions = pairs.select("s.session_id", corpus_chunks(F.col("s.turns")).alias("chunks")).dropDuplicates(["session_id"])
    return sessions, queries


def corpus_chunks(turns: Column) -> Column:
    """User texts as they are, others after their role in brackets; blank ones dropped."""
    kept = F.filter(turns, lambda t: F.trim(F.coalesce(t["content"], F.lit(""))) != "")
    return F.transform(kept, lambda t: F.when(t["role"] == "user", t["content"]).otherwise(F.concat(F.lit("["), t["role"], F.lit("] "), t["content"])))


def passages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sessions, queries) from JSON lines of a question with its context."""
    rows = spark.read.schema("question_id string, question string, context string, source_id string, category string").json(path)
    sessions = rows.select(F.col("source_id").alias("session_id"), F.array("context").alias("chunks")).dropDuplicates(["session_id"])
    return sessions, rows.select(F.col("question_id").alias("id"), F.col("question").alias("text"), F.array("source_id").alias("gold"), "category")


def cross_tool(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sessions, queries) from JSON lines that mix turns and queries."""
    rows = spark.read.schema("role string, tool string, turn int, content string, session_id string, ground_truth_memory_ids array<string>, target_tool string, category string").json(path)
    turns = rows.where("role = 'turn'").groupBy("session_id").agg(F.first("tool").alias("platform"), F.array_sort(F.collect_list(F.struct("turn", "content"))).alias("t"))
    sessions = turns.select("session_id", "platform", F.transform("t", lambda x: x["content"]).alias("chunks"))
    return sessions, rows.where("role = 'query'").select(F.xxhash64("content", "tool").cast("string").alias("id"), F.col("content").alias("text"), F.col("ground_truth_memory_ids").alias("gold"), "category")


def jdbc_key_values(spark: SparkSession, url: str, table: str = "ItemTable") -> DataFrame:
    """(key, value) of an editor's database, for ``editor_chunks``; needs its JDBC driver."""
    return spark.read.format("jdbc").options(url=url, dbtable=table).load().select("key", "value")


def embed_hashed(text: Column, dim: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed word counts in ``dim``
    cells, of unit length; a zero vector for wordless texts."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        import numpy as np
        from zlib import crc32

        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in (t or "").lower().split():
                h = crc32(w.encode())
                v[h % dim] += 1 if h >> 16 & 1 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype("float32").tolist())
        return pd.Series(out)

    return embed(text)


def iterate(df: DataFrame) -> Iterator:
    """Rows one partition at a time, for export to a local consumer."""
    return df.toLocalIterator(prefetchPartitions=True)
