import json

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.operators import writers
from larkspur.sources import corpora, readers


@pytest.fixture
def write(tmp_path):
    def f(name, body):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body if isinstance(body, bytes) else body.encode())
        return str(p)

    return f


def turns(df):
    return [(r.role, r.text) for r in df.orderBy("conv_id", "turn").collect()]


def test_jsonl(spark, write):
    lines = [{"type": "user", "message": {"content": "hello <system-reminder>x</system-reminder>"}}, {"role": "assistant", "content": [{"type": "text", "text": "one"}, {"type": "tool", "text": "no"}, {"type": "text", "text": "two"}]}, {"role": "system", "content": "no"}, {"role": "user", "content": "  "}]
    path = write("a.jsonl", "\n".join([json.dumps(lines[0]), "{broken", *map(json.dumps, lines[1:])]))
    assert turns(readers.read_jsonl(spark, path)) == [("user", "hello"), ("assistant", "one\ntwo")]


def test_tree_export(spark, write):
    node = lambda role, text, t: {"message": {"author": {"role": role}, "content": {"parts": [text]}, "create_time": t}}
    body = [{"title": "t", "mapping": {"x": node("assistant", "late", 5.0), "y": node("user", "early", None), "z": {"message": None}, "w": node("system", "no", 1.0)}}]
    assert turns(readers.read_tree_export(spark, write("c.json", json.dumps(body)))) == [("user", "early"), ("assistant", "late")]


def test_web_export(spark, write):
    body = [{"uuid": "u", "chat_messages": [{"sender": "human", "text": "hi"}, {"sender": "assistant", "text": "", "content": [{"type": "text", "text": "yes"}]}]}]
    assert turns(readers.read_web_export(spark, write("w.json", json.dumps(body)))) == [("user", "hi"), ("assistant", "yes")]


@pytest.mark.parametrize("body", [{"messages": [{"role": "user", "content": "q"}, {"role": "system", "content": "s"}, {"role": "assistant", "content": "a"}]}, [{"role": "user", "parts": [{"text": "q"}]}, {"role": "model", "parts": [{"text": "a"}]}]])
def test_session_json(spark, write, body):
    assert turns(readers.read_session_json(spark, write("s.json", json.dumps(body)))) == [("user", "q"), ("assistant", "a")]


def test_markdown(spark, write):
    assert turns(readers.read_markdown(spark, write("a.md", "intro\n#### user\nq\n#### assistant\na\nb\n#### other\nx"))) == [("user", "q"), ("assistant", "a\nb")]
    assert turns(readers.read_markdown(spark, write("b.md", "# User\nq\n# a heading\n## Assistant\na"), "headings")) == [("user", "q\n# a heading"), ("assistant", "a")]


def test_discover(spark, write, tmp_path):
    write("d/keep/a.md", "x")
    write("d/node_modules/b.md", "x")
    write("d/keep/c.txt", "x")
    got = [r.path.rsplit("/", 1)[-1] for r in readers.discover(spark, str(tmp_path / "d"), "*.md").collect()]
    assert got == ["a.md"]


def _field(n, data):
    def varint(x):
        out = b""
        while x > 127:
            out += bytes([x & 127 | 128])
            x >>= 7
        return out + bytes([x])

    return varint(n << 3 | 2) + varint(len(data)) + data


def test_wire_strings():
    inner = _field(1, b"a readable sentence") + _field(2, bytes([0, 1, 2]))
    data = b"\x08\x96\x01" + _field(3, inner) + b"\x0d\x01\x02\x03\x04" + _field(4, "über zehn Zeichen".encode())
    assert readers.wire_strings(data) == ["a readable sentence", "über zehn Zeichen"]
    assert readers.wire_strings(b"\xff\xff\xff") == []
    assert readers.wire_strings(data[:9]) == []


def test_binary_chunks(spark):
    data = b"".join(_field(1, f"sentence number {i} of a file".encode()) for i in range(4))
    rows = readers.binary_chunks(spark.createDataFrame([("p", data), ("q", b"\xff\x00" + b"printable run of many bytes that is long enough to keep it\x00")], "path string, content binary")).collect()
    assert sorted((r.path, r.chunk) for r in rows) == [("p", 0), ("q", 0)]


def test_editor_chunks(spark):
    value = json.dumps({"tabs": [{"richText": "x" * 60, "other": {"markdown": "y" * 5000}}, {"text": "short"}]})
    rows = readers.editor_chunks(spark.createDataFrame([("aiChat.data", value), ("window", value), ("chat.bad", "{")], "key string, value string")).collect()
    assert sorted(len(r.text) for r in rows) == [60, 4000]


def test_documents(spark, write, tmp_path):
    write("docs/a.html", "<title>T &amp; U</title><script>no()</script><p>A &amp;lt; B</p>")
    write("docs/b.txt", " ")
    write("docs/c.bin", b"\x00")
    rows = readers.read_documents(spark, str(tmp_path / "docs")).collect()
    assert [(r.mime, r.text) for r in rows] == [("text/html", "T & U A < B")]


def test_frontmatter(spark):
    head, body = readers.frontmatter(F.col("t"))
    block = '\ufeff---\r\nname: "a: b"\r\ntags:\r\n  - one\r\n  - \'two, three\'\r\nnone:\r\n- stray\r\nlast: x \r\n---\r\n\r\nbody\r\nmore'
    texts = ["---\nname: a b\ntags: [x, \"y, z\", 'w']\nempty: []\n---\nbody", block, "plain\r\n", "---\nname: open", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(head.alias("h"), body.alias("b")).collect()
    assert rows[0].h == {"name": "a b", "tags": '["x", "y, z", "w"]', "empty": "[]"}
    assert rows[1].h == {"name": "a: b", "tags": '["one", "two, three"]', "none": "[]", "last": "x"}
    assert [r.b for r in rows] == ["body", "body\nmore", *texts[2:]] and not any(r.h for r in rows[2:])


def test_conversation_corpora(spark, write):
    samples = [
        {"sample_id": "A", "conversation": {"session_1": [{"role": "user", "content": " hi "}, {"role": "bot", "content": "yo"}, "text", 5], "session_1_date": "x", "speaker": "n", "session_2": []}, "qa": [{"question": "who?", "evidence": ["session_1", ""], "category": 2}, {"question": " "}, {"question": "one?", "evidence": "session_2"}, "no"]},
        {"conversation": [["only"], []], "qas": [{"question": "none?"}]},
        "no record",
    ]
    for name, content in (("a.json", samples), ("b.json", {"samples": samples})):
        sessions, queries = corpora.samples_with_sessions(spark, write(name, json.dumps(content)))
        assert sorted((r.session_id, r.chunks) for r in sessions.collect()) == [("1::session_1", ["only"]), ("A::session_1", ["hi", "[bot] yo", "text", "5"])]
        assert sorted((r.id, r.text, r.gold, r.category) for r in queries.collect()) == [("1::qa0", "none?", [], None), ("A::qa0", "who?", ["A::session_1"], "2"), ("A::qa2", "one?", ["A::session_2"], None)]
    records = [
        {"id": "1", "question": "q1", "session_id": "s", "conversation": []},
        {"id": "2", "question": "q2", "session_id": "s", "conversation": [{"role": "user", "content": "first"}], "evidence": ["e", "d"]},
        {"id": "3", "question": "q3", "session_id": "s", "conversation": ["later"], "evidence": "x"},
        {"question": "q4", "conversation": ["own"], "category": "c"},
        {"id": "5", "question": ""},
    ]
    for name, content in (("c.json", records), ("d.json", {"data": records})):
        sessions, queries = corpora.questions_with_conversation(spark, write(name, json.dumps(content)))
        assert sorted((r.session_id, r.chunks) for r in sessions.collect()) == [("cm-3", ["own"]), ("s", ["first"])]
        assert sorted((r.id, r.gold, r.category) for r in queries.collect()) == [("1", ["s"], None), ("2", ["d", "e"], None), ("3", ["x"], None), ("cm-3", ["cm-3"], "c")]
    assert corpora.capture_profile("llm") == "enriched" and corpora.capture_profile("dual") == "dual"
    with pytest.raises(ValueError):
        corpora.capture_profile("other")


def test_results_and_context_files(spark, tmp_path):
    records = spark.createDataFrame([("1", "q?", ["b", "a"], None, 0.5)], "question_id string, question string, gold array<string>, category string, recall double")
    writers.write_results(records, str(tmp_path / "r"))
    lines = [json.loads(x) for p in (tmp_path / "r").glob("part-*") for x in p.read_text().splitlines()]
    assert lines == [{"question_id": "1", "question": "q?", "gold": ["a", "b"], "category": None, "recall": 0.5}]
    rows = spark.createDataFrame([(i, f"note {i}", "decision" if i < 8 else "fact", "p", i, ["rag"]) for i in range(10)], "id long, content string, content_type string, platform string, created_minute long, topics array<string>")
    assert writers.write_context(writers.context_lines(rows, 0), str(tmp_path / "c.txt"))
    text_ = (tmp_path / "c.txt").read_text().splitlines()
    assert [x.split(" | ")[0] for x in text_] == [f"Decisions: note {i}" for i in (7, 6, 5, 4, 3)] + ["Facts: note 9", "Facts: note 8", "Topic: rag (10)", "Source: p (10)"]
    assert not writers.write_context(writers.context_lines(rows, 99), str(tmp_path / "none.txt")) and not (tmp_path / "none.txt").exists()


def test_corpora(spark, write):
    q = [{"question_id": "1", "question": "?", "question_type": "t", "haystack_session_ids": ["s"], "haystack_sessions": [[{"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}, {"role": "user", "content": " "}]], "answer_session_ids": ["s"]}]
    sessions, queries = readers.questions_with_haystacks(spark, write("q.json", json.dumps(q)))
    assert sessions.collect()[0].chunks == ["u", "[assistant] a"] and queries.collect()[0].gold == ["s"]
    sessions, queries = readers.passages(spark, write("p.jsonl", json.dumps({"question_id": "1", "question": "?", "context": "c", "source_id": "z", "category": "k"})))
    assert sessions.collect()[0].chunks == ["c"] and queries.collect()[0].gold == ["z"]
    lines = [{"role": "turn", "tool": "a", "turn": 2, "content": "y", "session_id": "s"}, {"role": "turn", "tool": "a", "turn": 1, "content": "x", "session_id": "s"}, {"role": "query", "tool": "b", "content": "?", "ground_truth_memory_ids": ["s"]}]
    sessions, queries = readers.cross_tool(spark, write("x.jsonl", "\n".join(map(json.dumps, lines))))
    assert sessions.collect()[0].chunks == ["x", "y"] and queries.count() == 1


def test_sql_functions(spark):
    text.register_functions(spark)
    r = spark.sql("SELECT word_overlap('a b', 'B c') AS o, token_estimate('abcde') AS t, cosine(array(1f, 0f), array(1f, 1f)) AS c").first()
    assert (round(r.o, 6), r.t, round(r.c, 6)) == (0.333333, 2, 0.707107)


def test_hashed_embeddings(spark):
    a, b, c = (r.v for r in spark.createDataFrame([("one two",), ("two one",), (None,)], "t string").select(readers.embed_hashed(F.col("t"), 16).alias("v")).collect())
    assert a == b and sum(c) == 0


def test_skill_files_are_written_where_tools_look(spark, tmp_path):
    rows = spark.createDataFrame([("a-b", "one"), ("c", None), ("../evil", "x"), ("Upper", "x"), (None, "x")], "name string, text string")
    folders = {"t": str(tmp_path / "t"), "u": str(tmp_path / "u")}
    for _ in range(2):
        got = sorted(map(tuple, writers.write_skills(rows, folders).collect()))
        assert got == [(n, k, f"{folders[k]}/{n}") for n in ("a-b", "c") for k in ("t", "u")]
    assert {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("SKILL.md")} == {"t/a-b/SKILL.md": "one", "u/a-b/SKILL.md": "one", "t/c/SKILL.md": "", "u/c/SKILL.md": ""}
