"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark cuts the Arrow batches it hands to Python at so many bytes, whatever the columns
#: hold, so that long texts and long lists never meet by the ten thousand.
BATCH_BYTES = 4 << 20


def small_arrow(spark: SparkSession) -> None:
    """Bound what Spark puts into one Arrow batch by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch_base(spark: SparkSession) -> str:
    """The folder under ``spark.checkpoint.dir`` of this application's intermediate tables.

    Where that setting is absent, a local folder is used if all executors are this process
    (tests); on a cluster, whose executors would not see it, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), f"larkspur-{os.getuid()}")
    return f"{base.rstrip('/')}/larkspur/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in ``scratch_base``."""
    return f"{scratch_base(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application: results that are not yet
    written can no longer be read afterwards."""
    discard(spark, scratch_base(spark))


def written_at(df: DataFrame, path: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to ``path`` and read it back."""
    small_arrow(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps reuse the
    files, and a lost executor costs none of them."""
    return written_at(df, scratch_path(df.sparkSession, name), compression)


def fingerprint(spark: SparkSession, *paths: str) -> tuple:
    """Names, sizes and times of the files of ``paths``: another table has another one."""
    out = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))
