"""A streaming source that follows growing files by byte offset.

``spark.dataSource.register(TailSource)``, then ``spark.readStream.format("tail")`` with the
options ``path`` (a folder that driver and executors reach alike), ``pattern`` (of file names),
``positions`` (a file that keeps the furthest position of every file over restarts; without it a
file that shrank while the query was down is read again from its new end), ``maxBytesPerTrigger``
and ``splitBytes``.  Rows are (path, start, line), ``start`` being the line's byte offset.

An offset is the end of the last whole line taken from each file, so a last line without its
newline waits.  A file that shrank yields nothing until it has grown past the furthest position;
one that is gone is forgotten, and read from its start if it comes back.  Long additions are
split over tasks, each of which reads the lines that begin in its stretch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BLOCK = 1 << 16
SCHEMA = "path string, start bigint, line string"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def last_line_end(f: pa.NativeFile, begin: int, end: int) -> int:
    """Where the last whole line within [begin, end) ends; ``begin`` without one."""
    while end > begin:
        at = max(begin, end - BLOCK)
        f.seek(at)
        found = f.read(end - at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        end = at
    return begin


def next_line_start(f: pa.NativeFile, at: int, end: int) -> int:
    """Where the first line beginning after ``at - 1`` begins, at most ``end``."""
    while at < end:
        f.seek(at)
        data = f.read(min(BLOCK, end - at))
        found = data.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(data)
    return end


class Stretch(InputPartition):
    def __init__(self, path: str, begin: int, end: int, stop: int, first: bool):
        self.path, self.begin, self.end, self.stop, self.first = path, begin, end, stop, first


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.pattern = options["path"], options.get("pattern", "*")
        self.most = int(options.get("maxBytesPerTrigger", 0)) or None
        self.split = int(options.get("splitBytes", 32 << 20))
        self.positions = options.get("positions")
        self.furthest: dict[str, int] = self._load()

    def _load(self) -> dict[str, int]:
        if self.positions:
            files, at = _open(self.positions)
            if files.get_file_info(at).type == pafs.FileType.File:
                with files.open_input_stream(at) as f:
                    return json.loads(f.read())
        return {}

    def _keep(self) -> None:
        if self.positions:
            files, at = _open(self.positions)
            with files.open_output_stream(f"{at}.new") as f:
                f.write(json.dumps(self.furthest).encode())
            files.move(f"{at}.new", at)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, folder = _open(self.folder)
        out, room = {}, self.most
        infos = files.get_file_info(pafs.FileSelector(folder, allow_not_found=True, recursive=True))
        for info in sorted(infos, key=lambda i: i.path):
            if info.type != pafs.FileType.File or not fnmatch(info.base_name, self.pattern):
                continue
            known = self.furthest.get(info.path, 0)
            out[info.path] = known
            if info.size <= known or room == 0:
                continue
            with files.open_input_file(info.path) as f:
                stop = info.size if room is None else min(info.size, known + room)
                end = last_line_end(f, known, stop)
                if end == known and stop < info.size:  # one line alone exceeds the room
                    end = next_line_start(f, stop, info.size)
                    f.seek(end - 1)
                    end = end if f.read(1) == b"\n" else known
            out[info.path] = end
            room = None if room is None else max(0, room - (end - known))
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for path in [p for p in self.furthest if p not in end and p in start]:
            del self.furthest[path]  # gone
        for path, stop in end.items():
            begin = start.get(path, 0)
            out += [Stretch(path, a, min(a + self.split, stop), stop, a == begin) for a in range(begin, stop, self.split)]
            self.furthest[path] = max(begin, stop, self.furthest.get(path, 0))
        return out

    def commit(self, end: dict) -> None:
        self._keep()

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        files, _ = _open(self.folder)
        with files.open_input_file(partition.path) as f:
            at = partition.begin if partition.first else next_line_start(f, partition.begin - 1, partition.stop)
            f.seek(at)
            rest, starts, lines = b"", [], []
            place = at
            while at < partition.end:
                data = f.read(min(BLOCK, partition.stop - place))
                place += len(data)
                *whole, rest = (rest + data).split(b"\n")
                for line in whole:
                    if at >= partition.end:
                        break
                    starts.append(at)
                    lines.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                    at += len(line) + 1
                if not data:
                    break
                if len(starts) >= 1000:
                    yield self._batch(partition.path, starts, lines)
                    starts, lines = [], []
            yield self._batch(partition.path, starts, lines)

    @staticmethod
    def _batch(path: str, starts: list[int], lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array(lines, pa.string())], names=["path", "start", "line"])


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:  # noqa: ANN001
        return TailReader(dict(self.options))
