"""Helpers shared by the text operators: scratch tables, null rules, row batches.

Every operator takes a ``documents``-like DataFrame and works on ``doc_id`` and
``text`` alone, so further columns never clash with its own.  A null text counts
as an empty text unless the operator says otherwise; a null ``doc_id`` is kept
and sorts first.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.scratch import clear_scratch, discard, scratch_base, scratch_path, small_arrow, written, written_at  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_number() -> Column:
    """A number of the row in its partition of the input, as the last of several sort keys: rows
    that are alike in all others, however many, then spread over partitions."""
    return F.monotonically_increasing_id()


def text_bytes(name: str = "text") -> Column:
    """The UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def keyed_texts(docs: DataFrame) -> DataFrame:
    small_arrow(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))


def texts_kept(docs: DataFrame, keep: list[str] | tuple[str, ...]) -> DataFrame:
    """(doc_id, text as it is, ``_<name>`` of every other column named in ``keep``)."""
    small_arrow(docs.sparkSession)
    others = [F.col(c).alias(f"_{c}") for c in keep if c != "text"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *others)


def kept_ddl(rows: DataFrame, keep: list[str] | tuple[str, ...]) -> str:
    """The columns that ``kept_columns`` adds, for a schema."""
    types = {f"_{f.name}" if f.name == "text" else f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return "".join(f", `_{c}` {types[f'_{c}']}" for c in keep)


def kept_columns(made: pa.RecordBatch, batch: pa.RecordBatch, keep: list[str] | tuple[str, ...], text: pa.Array | None = None) -> pa.RecordBatch:
    """``made`` with the columns named in ``keep`` of the batch it was made from, as
    ``_<name>``; ``text`` takes the place of the text."""
    for c in keep:
        column = batch.column(f"_{c}") if c != "text" else batch.column("text") if text is None else text
        made = made.append_column(f"_{c}", column)
    return made


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    """The bytes of a batch's texts, null as empty."""
    return pc.fill_null(batch.column("text").cast(pa.binary()), b"").to_pylist()


def row_key() -> Column:
    """What stands for a row in several readings of one table: a 128-bit hash of its
    ``doc_id`` and ``text``.  Rows that agree in both are alike in every result."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).cast("binary"), F.lit(b"\x00"), text_bytes())))


def small_batches(batches: Iterator[pa.RecordBatch], size: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the bytes of the column ``size`` stay near ``limit``
    (one row may exceed it)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(size)), 0).to_pylist()
        first, total = 0, 0
        for i, n in enumerate(lengths):
            if total and total + n > limit:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += n
        if first < len(lengths):
            yield batch.slice(first)


def map_columns(make: Callable[[pa.RecordBatch], dict[str, object]], schema: pa.Schema, size: str = "text", limit: int = 1 << 20):
    """A ``mapInArrow`` function from one that turns a small batch into columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, size, limit):
            yield pa.RecordBatch.from_pydict(make(batch), schema=schema)

    return run


_held: tuple[object, object] | None = None


def worker_cache(key: object, make: Callable[[], object]) -> object:
    """The one object that a worker process keeps between tasks: what another operator
    kept is let go first, so that caches of several operators never add up."""
    global _held
    if _held is None or _held[0] != key:
        drop_worker_cache()
        _held = (key, make())
    return _held[1]


def drop_worker_cache() -> None:
    """Let go of what is kept and give its memory back to the system."""
    global _held
    if _held is not None:
        _held = None
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL("libc.so.6").malloc_trim(0)
