"""Numbered manifests in a shared folder: each is written once, and the newest one counts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has published in the meantime; nothing of this one is visible."""


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) in Hadoop's terms."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(at)


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Give a file or folder a name that must be free; False, and nothing done, if it is not."""
    jvm = spark._jvm
    fs, old = hadoop_path(spark, source)
    _, new = hadoop_path(spark, target)
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(old, new, none)
    except Exception:
        if fs.exists(new):
            return False
        raise
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, at = hadoop_path(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    fs, at = hadoop_path(spark, path)
    fs.mkdirs(at.getParent())
    out = fs.create(at, overwrite)
    out.write(bytearray(text.encode()))
    out.close()


class Manifests:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/manifests"

    def names(self) -> list[str]:
        fs, home = hadoop_path(self.spark, self.path)
        if not fs.exists(home):
            return []
        found = (s.getPath().getName() for s in fs.listStatus(home))
        return sorted(x for x in found if x.endswith(".json") and not x.startswith("."))

    def newest(self) -> dict | None:
        names = self.names()
        return json.loads(read_text(self.spark, f"{self.path}/{names[-1]}")) if names else None

    def publish(self, version: int, manifest: dict) -> None:
        """Make ``manifest`` the newest, if its number is still free."""
        draft = f"{self.path}/.draft-{uuid.uuid4().hex}"
        write_text(self.spark, draft, json.dumps(manifest | {"version": version}))
        if not rename_new(self.spark, draft, f"{self.path}/{version:012d}.json"):
            fs, at = hadoop_path(self.spark, draft)
            fs.delete(at, False)
            raise Conflict(f"version {version} of {self.path} is taken")

    def forget_older(self) -> None:
        for name in self.names()[:-1]:
            fs, at = hadoop_path(self.spark, f"{self.path}/{name}")
            fs.delete(at, False)
