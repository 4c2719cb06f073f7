import json

from pyspark.sql import functions as F

from larkspur.streaming import capture
from larkspur.streaming.changelog import ChangeLog


def event(session, texts, kind="delta", tool="a", **more):
    return json.dumps({"schema": 1, "type": kind, "tool": tool, "session_id": session, "sent_at": f"2024-01-0{len(texts)}", "event_data": {"last_n_messages": [{"role": r, "content": t} for r, t in texts]}} | more)


LONG = "a question that is long enough to be worth keeping, number "


def test_capture_equals_one_batch(spark, tmp_path):
    files = [
        [event("s", [("user", LONG + "1"), ("tool", "answer")]), "not json"],
        [event("s", [("user", LONG + "1"), ("tool", "answer")]), event("t", [("user", LONG + "2")]), event("u", [("user", LONG + "3")], kind="session")],
        [event("t", [("user", LONG + "4")], tool="off"), event("v", [("user", "ok")]), event("w", [("user", LONG + "5")], schema=2)],
    ]
    for i, lines in enumerate(files):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.jsonl").write_text("\n".join(lines))
        capture.capture(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), disabled=["off"])
    (tmp_path / "cp2").mkdir()
    capture.capture(spark, str(tmp_path / "in"), str(tmp_path / "all"), str(tmp_path / "cp2"), disabled=["off"])
    got, once = ({(r.session_id, r.hash) for r in spark.read.parquet(str(tmp_path / x)).collect()} for x in ("out", "all"))
    assert got == once and {s for s, _ in got} == {"s", "t"}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert spark.read.json(str(tmp_path / "out.quarantine")).count() == 2


def test_what_is_sent_again_is_skipped_and_logged(spark, tmp_path):
    log, store = ChangeLog(spark, str(tmp_path / "log")), str(tmp_path / "out")
    words = "apples grow on old trees near the river while children read long books about ships and distant stars"
    near, other = words + " today", "completely different words that talk of engines and winter roads in the northern mountains"
    batches = [
        [event("s", [("user", words)], tool="codex"), event("x", [("user", words)], tool="off")],
        [event("s", [("user", near)], tool="codex"), event("s", [("user", other)], tool="codex"), event("t", [("user", near)], tool="codex")],
        [event("s", [("user", words)], tool="codex")],
    ]
    for i, lines in enumerate(batches):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.jsonl").write_text("\n".join(lines))
        capture.capture(spark, str(tmp_path / "in"), store, str(tmp_path / "cp"), disabled=["off"], log=log)
    got = sorted((r.session_id, r.text.removeprefix("Human: ")) for r in spark.read.parquet(store).collect())
    assert got == sorted([("s", words), ("s", other), ("t", near)])
    said = sorted(r.message for r in log.read().collect())
    assert [m for m in said if m.startswith("dedup")] == ["dedup skipped 1/1 chunks in session s", "dedup skipped 1/2 chunks in session s"]
    assert [m for m in said if m.startswith("ingested")] == ["ingested 1 memory/memories", "ingested 2 memory/memories"]
    assert "ignored 1 delta events (watcher not enabled)" in said
    rows = spark.createDataFrame([("codex",), ("nothing",), (None,)], "tool string")
    assert [r.p for r in rows.select(capture.platform(F.col("tool")).alias("p")).collect()] == ["codex_cli", "unknown", "unknown"]


def test_rewritten_sessions_yield_new_turns_once(spark, tmp_path):
    def snapshot(n, name):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(json.dumps({"session_id": "s", "messages": [{"role": "user", "content": f"m{i}"} for i in range(n)]}))

    def run():
        q = capture.new_turns(capture.session_snapshots(spark, str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    for i, n in enumerate((2, 5, 3)):
        snapshot(n, f"{i}.json")
        run()
    assert sorted(r.turn for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3, 4]


def test_sessions_in_a_stream_equal_the_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "user_id")
    want = {(r.user_id, r.start, r.n) for r in capture.sessions(events).collect()}
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = capture.sessions(stream).writeStream.format("memory").queryName("sess").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.user_id, r.start, r.n) for r in spark.table("sess").collect()} == want
    assert spark.table("sess").agg(F.sum("n")).first()[0] == events.count()
