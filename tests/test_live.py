"""Timers, recent vectors, the change log and maintained views."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import dedup
from larkspur.operators.maintained import MaintainedViews, Refresher, changes, key, where
from larkspur.streaming import recent
from larkspur.streaming.changelog import ChangeLog, ProgressToLog, ring
from larkspur.streaming.timers import fired, settled

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def drive(spark, tmp_path, batches, ddl, plan, name):
    """What ``plan`` yields when a folder gets one batch after the other."""
    folder, out = tmp_path / f"{name}-in", []
    folder.mkdir()
    stream = plan(spark.readStream.schema(ddl).parquet(str(folder)))

    def take(df, _):
        out.append([tuple(r) for r in df.collect()])

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(folder))
        q = stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        out.append(i)
    return out


def flat(out):
    return [r for x in out if isinstance(x, list) for r in x]


CHANGES = "path string, at timestamp"


def test_a_burst_is_one_row(spark, tmp_path):
    batches = [
        [("a", at(0)), ("a", at(1)), ("b", at(0))],
        [("a", at(3)), ("clock", at(6))],  # a is not quiet yet
        [("clock", at(30))],
        [("a", at(31)), ("clock", at(60))],
        [("clock", at(100))],
    ]
    out = drive(spark, tmp_path, batches, CHANGES, lambda s: settled(s, 5, clock="event"), "settled")
    rows = [r for r in flat(out) if r[0] != "clock"]
    assert sorted(rows) == [("a", at(0), at(3), 3), ("a", at(31), at(31), 1), ("b", at(0), at(0), 1)]
    assert ("a", at(0), at(3), 3) not in [r for x in out[: out.index(0)] if isinstance(x, list) for r in x]


def test_settled_on_the_wall_clock(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", at(0)), ("a", at(1))], CHANGES).write.mode("append").parquet(str(tmp_path / "in"))
    got = []
    q = settled(spark.readStream.schema(CHANGES).parquet(str(tmp_path / "in")), 1.0).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    q.awaitTermination(25)
    q.stop()
    assert [(r.path, r.n) for r in got] == [("a", 2)]


def test_changes_let_through_keep_their_distance(spark, tmp_path):
    r = random.Random(3)
    times = {p: sorted(r.sample(range(200), 40)) for p in "ab"}
    every = sorted((t, p) for p, ts in times.items() for t in ts)
    batches = [[(p, at(t)) for t, p in every[i : i + 16]] for i in range(0, len(every), 16)]
    got = flat(drive(spark, tmp_path, batches, CHANGES, lambda s: fired(s, 7), "fired"))
    want = []
    for p, ts in times.items():
        last = None
        for t in ts:
            if last is None or t - last >= 7:
                last = t
                want.append((p, at(t)))
    assert sorted(got) == sorted(want)


CHUNKS = "id long, platform string, session string, at timestamp, vector array<double>"


def chunk_rows(n=120, seed=1):
    r, g = random.Random(seed), np.random.default_rng(seed)
    bases = g.standard_normal((12, 8))
    rows = []
    for i in range(n):
        v = (bases[r.randrange(12)] + g.standard_normal(8) * r.choice([0.02, 0.4])).tolist()
        v = r.choice([v] * 10 + [None, v[:3], [float("nan")] * 8])
        rows.append((i, f"p{i % 2}", r.choice([f"s{i % 5}", f"s{i % 3}", None]), at(i * 10), v))
    return rows


def decided(rows, threshold, keep, scope):
    held, out = {}, []
    for i, platform, session, when, v in rows:
        mine = held.setdefault((platform, session) if scope == "session" else platform, [])
        mine[:] = [m for m in mine if m[2] >= when - dt.timedelta(seconds=keep)]
        if v is None:
            out.append((i, "embed_failed", None))
            continue
        if len(v) != 8 or not np.isfinite(v).all():
            out.append((i, "search_failed", None))
            continue
        x = np.array(v) / np.linalg.norm(v)
        best = max(mine, key=lambda m: (round(float(m[3] @ x), 12), -m[0]), default=None)
        reason = "no_match"
        if best:
            near = round(float(best[3] @ x), 12) >= threshold
            other = session is not None and best[1] is not None and session != best[1]
            reason = "different_session" if other else "near_duplicate" if near else "below_threshold"
        out.append((i, reason, best[0] if reason == "near_duplicate" else None))
        if reason != "near_duplicate":
            mine.append((i, session, when, x))
    return sorted(out, key=str)


@pytest.mark.parametrize(("scope", "keep"), [("session", 10**6), ("platform", 10**6), ("platform", 300)])
def test_decisions_of_a_stream(spark, tmp_path, scope, keep):
    rows = chunk_rows()
    batches = [rows[i : i + 30] for i in range(0, 120, 30)]
    got = flat(drive(spark, tmp_path, batches, CHUNKS, lambda s: recent.decisions(s, 8, 0.95, keep, scope=scope), "recent"))
    want = decided(rows, 0.95, keep, scope)
    assert sorted(((r[0], r[4], r[6]) for r in got), key=str) == want
    batch = recent.decisions(spark.createDataFrame(rows, CHUNKS), 8, 0.95, keep, scope=scope).collect()
    assert sorted(((r.id, r.reason, r.matched) for r in batch), key=str) == want
    if scope == "platform" and keep > 1000:
        assert {reason for _, reason, _ in want} == set(recent.REASONS)


def test_decisions_equal_those_of_the_batch_operator(spark, tmp_path):
    g = np.random.default_rng(8)
    vectors = g.standard_normal((40, 8))
    store = [(i, f"p{i % 4}", f"s{i % 3}", at(i), vectors[i].tolist()) for i in range(40)]
    # One new row for each platform, so that none meets another: three near, one far, odd ones.
    new = [(100 + i, f"p{i}", f"s{s}", at(900), v) for i, (s, v) in enumerate([(0 % 3, vectors[0].tolist()), (2, vectors[1].tolist()), (2, (vectors[2] + 0.2 * g.standard_normal(8)).tolist()), (0, None)])]
    new += [(110, "p7", "s", at(900), vectors[0].tolist()), (111, "p8", "s", at(900), [1.0])]
    df = lambda x: spark.createDataFrame(x, CHUNKS)
    want = sorted((r.id, r.reason, r.matched) for r in dedup.watcher_decisions(df(new), df(store), 0.999, 8).collect())
    got = flat(drive(spark, tmp_path, [store, new], CHUNKS, lambda s: recent.decisions(s, 8, 0.999, scope="platform"), "eq"))
    assert all(r[4] != "near_duplicate" for r in got if r[0] < 100)
    assert sorted(((r[0], r[4], r[6]) for r in got if r[0] >= 100), key=lambda r: r[0]) == want
    assert {r[1] for r in want} == set(recent.REASONS)


def events(spark, n, tool="a", kind="daemon_status", start=0):
    return spark.range(start, start + n).select(F.lit(kind).alias("kind"), (F.lit(T0).cast("timestamp") + F.make_dt_interval(secs=F.col("id"))).alias("at"), F.lit(tool).alias("tool"), F.lit("info").alias("level"), F.concat(F.lit("ingested "), "id", F.lit(" memory/memories")).alias("message"), F.lit("{}").alias("data"))


def test_consumers_read_every_event_once(spark, tmp_path):
    path, seen = str(tmp_path / "log"), {"x": [], "y": []}

    def take(name, fail=False):
        consumer = ChangeLog(spark, path).consumer(name, ["daemon_status"])  # a new one each time, as after a restart
        rows, upto = consumer.poll()
        got = [(r.n, r.message) for r in rows.collect()]
        if not fail:
            consumer.acknowledge(upto)
            seen[name] += got
        return got

    log = ChangeLog(spark, path)
    log.append(events(spark, 3), "first")
    assert log.append(events(spark, 3), "first") == 1  # run again
    assert len(take("x", fail=True)) == 3 and len(take("x")) == 3 and take("x") == []
    log.append(events(spark, 2, start=10))
    log.append(events(spark, 2, kind="memory_created", start=20))
    take("y")
    take("x")
    log.compact(2)
    log.append(events(spark, 1, start=30))
    take("x")
    take("y")
    assert sorted(seen["x"]) == sorted(seen["y"]) and len(set(seen["x"])) == 6
    assert log.read().count() == 3
    assert [(r.tool, r.captured) for r in log.captured("2024-01-01").collect()] == [("a", 20 + 21 + 30)]
    with pytest.raises(ValueError):
        log.append(events(spark, 1, kind="nonsense"))
    with pytest.raises(ValueError):
        log.consumer("x").acknowledge(1)


def test_ring_keeps_the_newest_of_each_tool(spark):
    log = events(spark, 50).unionByName(events(spark, 5, "b")).withColumn("n", F.lit(1).cast("long"))
    got = sorted((r.tool, int(r.message.split()[1])) for r in ring(log, 7, parts=3).collect())
    assert got == [("a", i) for i in range(43, 50)] + [("b", i) for i in range(5)]


def test_progress_is_logged_once_a_batch(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"))
    listener = ProgressToLog(log, "watcher")
    spark.createDataFrame([(1,), (2,)], "x int").write.parquet(str(tmp_path / "in"))

    class Event:
        class progress:  # noqa: N801
            numInputRows, batchId, id = 2, 0, "q"

    listener.onQueryProgress(Event)
    listener.onQueryProgress(Event)
    assert [r.message for r in log.read().collect()] == ["processed 2 rows"]


ROWS = "id long, platform string, status string, topics array<string>"
VIEWS = {
    "platforms": lambda r: where(r["status"] == "active", F.array(key(r["platform"]))),
    "topics": lambda r: where(r["status"] == "active", F.transform(r["topics"], lambda t: key(t))),
    "pairs": lambda r: F.array(key(r["status"], r["platform"])),
}


def test_views_follow_changes(spark, tmp_path):
    r = random.Random(2)
    row = lambda i: (i, r.choice(["p", "q", None]), r.choice(["active", "archived"]), r.sample(["a", "b", "c"], r.randrange(4)))
    df = lambda rows: spark.createDataFrame(rows, ROWS)
    views, now = MaintainedViews(spark, str(tmp_path / "views"), VIEWS), {}
    for step in range(4):
        after = {i: row(i) for i in r.sample(range(30), 12)}
        gone = set(r.sample(sorted(now), 4)) - set(after) if now else set()
        before = [now[i] for i in [*after, *gone] if i in now]
        views.refresh(changes(df(before) if before else None, df(list(after.values()))), f"batch {step}")
        assert views.refresh(changes(None, df(list(after.values()))), f"batch {step}") == step + 1  # not twice
        now = {i: x for i, x in (now | after).items() if i not in gone}
    fresh = MaintainedViews(spark, str(tmp_path / "fresh"), VIEWS)
    fresh.refresh(changes(None, df(list(now.values()))))
    assert sorted(map(str, views.counts().collect())) == sorted(map(str, fresh.counts().collect()))
    assert {tuple(x.key): x.n for x in views.view("platforms").collect()} == {(p,): n for p in ("p", "q", None) if (n := sum(x[1] == p and x[2] == "active" for x in now.values()))}


def test_refresh_when_dirty():
    clock, runs = [0.0], []
    refresher = Refresher(lambda: runs.append(clock[0]), lambda: clock[0])
    for now, mark in ((1, False), (2, True), (3, False), (10, True), (61, False), (62, False), (63, True), (130, False)):
        clock[0] = now
        if mark:
            refresher.mark()
        refresher.tick()
    assert runs == [2, 62, 130]
