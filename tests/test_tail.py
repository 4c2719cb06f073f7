"""The tail source against files that grow, shrink, go and come back."""

import random

import pytest

from larkspur.streaming.tail import Stretch, TailReader, TailSource


def lines_of(reader, start, end):
    return [(b["path"].rsplit("/", 1)[1], b["start"], b["line"]) for s in reader.partitions(start, end) for batch in reader.read(s) for b in batch.to_pylist()]


@pytest.mark.parametrize(("split", "most", "block"), [(1 << 20, 0, 1 << 16), (7, 0, 5), (13, 40, 8), (3, 1, 4)])
def test_every_line_once(tmp_path, monkeypatch, split, most, block):
    monkeypatch.setattr("larkspur.streaming.tail.BLOCK", block)
    r = random.Random(split)
    reader = TailReader({"path": str(tmp_path), "pattern": "*.jsonl", "splitBytes": str(split), "maxBytesPerTrigger": str(most)})
    (tmp_path / "other.txt").write_text("no\n")
    at, got, content = reader.initialOffset(), [], {f"{n}.jsonl": b"" for n in "abc"}
    for step in range(30):
        for name in content:
            if step < 12 and r.random() < 0.7:
                content[name] += "".join(r.choice(["x", "é", "yz", "\n", "\r\n"]) for _ in range(r.randrange(25))).encode()
                # A write may end inside a character.
                (tmp_path / name).write_bytes(content[name][: len(content[name]) - r.randrange(2) * (step < 11)])
        for name in content if step == 12 else ():
            (tmp_path / name).write_bytes(content[name])
        end = reader.latestOffset()
        got += lines_of(reader, at, end)
        reader.commit(end)
        at = end
    want = []
    for name, data in content.items():
        place = 0
        for line in data.split(b"\n")[:-1]:
            want.append((name, place, line.removesuffix(b"\r").decode("utf-8", "replace")))
            place += len(line) + 1
    if not most or most > 1:
        assert sorted(got) == sorted(want)
    else:  # a line a trigger: a part of all, none twice
        assert len(set(got)) == len(got) > 20 and set(got) <= set(want)


def test_shrunken_and_lost_files(tmp_path):
    file, options = tmp_path / "a.log", {"path": str(tmp_path), "positions": str(tmp_path / "p" / "x.json"), "pattern": "*.log"}
    (tmp_path / "p").mkdir()
    reader, at = TailReader(options), {}

    def step(reader, at):
        end = reader.latestOffset()
        got = [line for *_, line in lines_of(reader, at, end)]
        reader.commit(end)
        return got, end

    file.write_text("one\ntwo\nthr")
    got, at = step(reader, at)
    assert got == ["one", "two"]
    file.write_text("one\n")
    assert step(reader, at)[0] == []
    reader = TailReader(options)  # a restart while the file is short
    got, at = step(reader, at)
    assert got == []
    file.write_text("one\ntwo\nthree\n")
    got, at = step(reader, at)
    assert got == ["three"]
    file.unlink()
    got, at = step(reader, at)
    assert got == [] and at == {}
    file.write_text("new\n")
    assert step(reader, at)[0] == ["new"]


def test_reading_a_stretch_again_gives_the_same(tmp_path):
    (tmp_path / "a").write_text("1\n22\n333\n")
    reader = TailReader({"path": str(tmp_path)})
    s = Stretch(str(tmp_path / "a"), 0, 9, 9, True)
    assert [b.to_pylist() for b in reader.read(s)] == [b.to_pylist() for b in reader.read(s)]


def test_stream_equals_batch(spark, tmp_path):
    spark.dataSource.register(TailSource)
    (tmp_path / "in").mkdir()
    r, written = random.Random(1), {"a.jsonl": [], "b.jsonl": []}

    def run():
        stream = spark.readStream.format("tail").option("path", str(tmp_path / "in")).option("pattern", "*.jsonl").option("positions", str(tmp_path / "positions.json")).option("splitBytes", "64").load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    for step in range(4):
        for name, lines in written.items():
            lines += [f'{{"step": {step}, "n": {i}, "t": "{"é" * r.randrange(30)}"}}' for i in range(r.randrange(1, 9))]
            (tmp_path / "in" / name).write_text("\n".join(lines) + "\n" + '{"step": ')
        run()
    got = [(x.path.rsplit("/", 1)[1], x.start, x.line) for x in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted((n, line) for n, _, line in got) == sorted((n, line) for n, lines in written.items() for line in lines)
    for name, start, line in got:
        assert (tmp_path / "in" / name).read_bytes()[start:].startswith(line.encode() + b"\n")
