"""Similarity joins on vectors: near-duplicates, corroboration, contradiction, merging.

Pairs above a threshold come from blocks of vectors: both sides are cut into blocks of
bounded size by a hash of the id, and a task multiplies one block of each as matrices.
No vector passes through the driver, and no pair below the threshold leaves a task.

A table that meets itself (``unlike_pairs``, ``nearest_above``) is dealt in larger blocks of which
every two meet once, so a row is shuffled once for each ``SELF_ROWS`` rows of the table, and a task
searches tiles of scores in single precision before it scores what it found in double.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.components import components
from larkspur.operators.scratch import discard, scratch_path, written, written_at
from larkspur.operators.skew import join_counted

BLOCK_ROWS = 8192
#: Rows of a block of a table that meets itself; smaller tables are cut so that all cores work.
SELF_ROWS, LEAST_ROWS = 32_768, 2048
#: Bits of a sketch of a word set; candidates that are scored, and best partners that are held, at once.
SKETCH_BITS, PART, HELD = 4096, 16_384, 4_000_000
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64())])


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(rows):
        return np.zeros((0, 1))
    lengths = pc.unique(pc.list_value_length(rows))
    if len(lengths) > 1 or lengths.null_count:
        raise ValueError("vectors must be of one length")
    m = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), lengths[0].as_py())
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _above(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, score) of the unit rows of ``x`` and ``y`` with cosine >= threshold, in parts; with
    ``same`` both are one block, of which each two rows meet once."""
    u, v = x.astype(np.float32), np.ascontiguousarray(y.astype(np.float32).T)
    least = np.float32(threshold - 2e-7 * (x.shape[1] + 8))  # single precision is off by less
    for a in range(0, len(x), 512):
        for b in range(a // 4096 * 4096 if same else 0, len(y), 4096):
            scores = u[a : a + 512] @ v[:, b : b + 4096]
            near = np.flatnonzero(scores.ravel() >= least)
            for at in range(0, len(near), PART):
                i, j = np.divmod(near[at : at + PART], scores.shape[1])
                i, j = i + a, j + b
                if same:
                    i, j = i[i < j], j[i < j]
                score = np.einsum("ij,ij->i", x[i], y[j])
                keep = score >= threshold
                yield i[keep], j[keep], score[keep]


def _meeting(rows: DataFrame, n: int, task: Callable[[pa.Table, pa.Table, bool], Iterator[pa.RecordBatch]], schema: str, block_rows: int) -> DataFrame:
    """What ``task`` gives for every two blocks of the ``n`` rows (id, vector, more), and for every
    block with itself (marked by true)."""
    blocks = max(1, -(-n // block_rows), min(8, n // LEAST_ROWS))
    own, other = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = rows.select("*", own.alias("_own"), other.alias("_other")).withColumns({"_l": F.least("_own", "_other"), "_r": F.greatest("_own", "_other")}).drop("_other")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(batches)
        if not both.num_rows:
            return
        low, high = both.column("_l")[0].as_py(), both.column("_r")[0].as_py()
        own = both.column("_own").to_numpy()
        x = both.filter(pa.array(own == low))
        yield from task(x, x if low == high else both.filter(pa.array(own == high)), low == high)

    return dealt.groupBy("_l", "_r").applyInArrow(meet, schema)


def _with_vector(df: DataFrame) -> DataFrame:
    return df.where("id is not null and vector is not null")


def _blocks(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
    """Rows with their block, once for every block of the other side."""
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias(own)
    return df.select(F.col("id").alias(f"id_{own}"), F.col("vector").alias(f"vector_{own}"), block, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, score) with a from ``left``, b from ``right``, a <> b and cosine >= threshold.
    Rows with a null id or vector are left out; vectors must be of one length."""
    left, right = (df.where("id is not null and vector is not null").select("id", "vector") for df in (left, right))
    n, m = (max(1, -(-df.count() // block_rows)) for df in (left, right))

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return PAIRS.empty_table()
        ids, others = x.column("id_l").to_numpy(), y.column("id_r").to_numpy()
        matrix, found = _unit(y.column("vector_r")).T, []
        rows = _unit(x.column("vector_l"))
        for start in range(0, len(ids), 512):
            scores = rows[start : start + 512] @ matrix
            i, j = np.nonzero(scores >= threshold)
            keep = ids[start + i] != others[j]
            i, j = i[keep], j[keep]
            found.append(pa.Table.from_pydict({"a": ids[start + i], "b": others[j], "score": scores[i, j]}, schema=PAIRS))
        return pa.concat_tables(found)

    a = _blocks(left, "l", n, "r", m).groupBy("l", "r")
    b = _blocks(right, "r", m, "l", n).groupBy("l", "r")
    return a.cogroup(b).applyInArrow(compare, "a long, b long, score double")


def nearest(left: DataFrame, right: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, alike) of every row of ``left``: its greatest cosine to a row of ``right``.
    A task gives one row for each of its left rows; vectors must be of one length."""
    n, m = (max(1, -(-df.count() // block_rows)) for df in (left, right))
    schema = pa.schema([("id", pa.int64()), ("alike", pa.float64())])

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return schema.empty_table()
        rows, matrix = _unit(x.column("vector_l")), _unit(y.column("vector_r")).T
        most = np.concatenate([(rows[i : i + 512] @ matrix).max(1) for i in range(0, len(rows), 512)])
        return pa.Table.from_arrays([x.column("id_l").cast(pa.int64()), pa.array(most)], schema=schema)

    a, b = _blocks(left, "l", n, "r", m).groupBy("l", "r"), _blocks(right, "r", m, "l", n).groupBy("l", "r")
    return a.cogroup(b).applyInArrow(compare, "id long, alike double").groupBy("id").agg(F.max("alike").alias("alike"))


def nearest_k(left: DataFrame, right: DataFrame, k: int, within: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, score, rank): the ``k`` rows of ``right`` nearest to each row of ``left``, itself
    left out, ties to the lower id; with ``within`` only rows alike in that column, which then is
    cut into blocks key by key (a null is alike to nothing).  A task keeps the ``k`` best of its
    block for each of its left rows, so what is shuffled does not grow with the pairs."""
    key = F.lit("") if within is None else F.col(within).cast("string")
    left, right = (df.where("id is not null and vector is not null").select("id", "vector", key.alias("key")).where("key is not null") for df in (left, right))
    parts = lambda df, c: df.groupBy("key").agg(F.count("*").alias("n")).select("key", "n", F.ceil(F.col("n") / block_rows).cast("int").alias(c))
    of_left, of_right = parts(left, "_l"), parts(right, "_r")
    held = of_left.select("key", "_l", F.col("n").alias("_nl")).join(of_right.select("key", "_r", F.col("n").alias("_nr")), "key")

    def blocks(df: DataFrame, own: str, other: str) -> DataFrame:
        """Rows of the keys that both sides hold, with their block, once for each of the other side."""
        keyed = join_counted(df, held, ["key"], df.count(), f"_n{own}")
        block = F.pmod(F.xxhash64("id"), f"_{own}").cast("int").alias(own)
        return keyed.select("key", F.col("id").alias(f"id_{own}"), F.col("vector").alias(f"vector_{own}"), block, F.explode(F.sequence(F.lit(0), F.col(f"_{other}") - 1)).alias(other))

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return PAIRS.empty_table()
        y = y.sort_by("id_r")
        ids, others = x.column("id_l").to_numpy(), y.column("id_r").to_numpy()
        rows, matrix, found = _unit(x.column("vector_l")), _unit(y.column("vector_r")).T, []
        for start in range(0, len(ids), 512):
            scores = rows[start : start + 512] @ matrix
            own = ids[start : start + 512]
            scores[own[:, None] == others[None]] = -np.inf
            top = np.argsort(-np.round(scores, 12), axis=1, kind="stable")[:, :k]
            value = np.take_along_axis(scores, top, 1)
            keep = np.isfinite(value)
            found.append(pa.Table.from_pydict({"a": np.repeat(own, top.shape[1])[keep.ravel()], "b": others[top][keep], "score": value[keep]}, schema=PAIRS))
        return pa.concat_tables(found)

    a, b = blocks(left, "l", "r").groupBy("key", "l", "r"), blocks(right, "r", "l").groupBy("key", "l", "r")
    return best(a.cogroup(b).applyInArrow(compare, "a long, b long, score double"), k)


def unlike_pairs(vectors: DataFrame, rows: DataFrame, threshold: float, overlap: float, block_rows: int = SELF_ROWS) -> DataFrame:
    """(a, b, score) with a < b of the ``vectors`` (id, vector) with cosine >= threshold whose
    ``rows`` (id, platform, words: once each) are of different platforms and have an overlap of
    words below ``overlap``; two rows without words have none.

    Into the blocks go sketches in place of words: a bit for each hash of a word.  A bit of one
    sketch that the other lacks stands for a word that the other lacks, so two sketches and the
    numbers of words bound the overlap from above, which settles almost all pairs of unlike texts.
    Only the pairs that the bound leaves open meet the words themselves, as 64-bit hashes."""
    hashed = rows.where("id is not null and platform is not null and words is not null").select("id", "platform", F.transform("words", lambda w: F.xxhash64(w)).alias("words"))
    hashed = written(hashed.withColumn("row", F.monotonically_increasing_id()), "words")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                words = part.column("words")
                size = words.value_lengths().to_numpy(zero_copy_only=False)
                bits = np.zeros((len(size), SKETCH_BITS), np.uint8)
                bits[np.repeat(np.arange(len(size)), size), words.flatten().to_numpy() % SKETCH_BITS] = 1
                packed = pa.array([row.tobytes() for row in np.packbits(bits, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "row", "platform")), pa.array(size, pa.int32()), packed], names=["id", "row", "platform", "n", "sketch"])

    def sides(t: pa.Table) -> tuple[np.ndarray, ...]:
        sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(t.num_rows, -1)
        return t.column("id").to_numpy(), t.column("row").to_numpy(), np.array(t.column("platform").to_pylist(), object), t.column("n").to_numpy().astype(np.int64), sketches

    def compare(x: pa.Table, y: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        ids, at, own, n, s = sides(x)
        others, to, other, m, t = sides(y)
        unit = _unit(x.column("vector"))
        for i, j, score in _above(unit, unit if same else _unit(y.column("vector")), threshold, same):
            keep = (ids[i] != others[j]) & (own[i] != other[j])
            i, j, score = i[keep], j[keep], score[keep]
            lacked = lambda p, q: np.bitwise_count(p & ~q).sum(1, dtype=np.int64)
            shared = np.minimum(n[i] - lacked(s[i], t[j]), m[j] - lacked(t[j], s[i]))
            sure = shared / np.maximum(1, n[i] + m[j] - shared) < overlap
            a, b = np.minimum(ids[i], others[j]), np.maximum(ids[i], others[j])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(score), pa.array(at[i], mask=sure), pa.array(to[j], mask=sure)], names=["a", "b", "score", "x", "y"])

    usable = _with_vector(vectors).select("id", "vector")
    sketched = usable.join(hashed.mapInArrow(sketch, "id long, row long, platform string, n int, sketch binary"), "id")
    found = written(_meeting(sketched, usable.count(), compare, "a long, b long, score double, x long, y long", block_rows), "near-pairs")
    x, y = (hashed.select(F.col("row").alias(c), F.col("words").alias(f"_{c}")) for c in ("x", "y"))
    met = found.where("x is not null").join(x, "x").join(y, "y").withColumn("_both", F.size(F.array_intersect("_x", "_y")))
    checked = met.where(F.col("_both") / F.greatest(F.lit(1), F.size("_x") + F.size("_y") - F.col("_both")) < overlap)
    return found.where("x is null").select("a", "b", "score").unionByName(checked.select("a", "b", "score"))


def nearest_above(rows: DataFrame, k: int, threshold: float, block_rows: int = SELF_ROWS) -> DataFrame:
    """(a, b, score, rank): the ``k`` other rows (id, vector) nearest to each row, of those with
    cosine >= threshold, ties to the lower id.  A task keeps the ``k`` best of its two blocks for
    each row."""

    def top(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        a, b, score = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((b, -np.round(score, 12), a))
        a, b, score = a[order], b[order], score[order]
        keep = np.arange(len(a)) - np.searchsorted(a, a) < k
        return a[keep], b[keep], score[keep]

    def compare(x: pa.Table, y: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        ids, others = x.column("id").to_numpy(), y.column("id").to_numpy()
        unit = _unit(x.column("vector"))
        parts, held, bound = [], 0, HELD
        for i, j, score in _above(unit, unit if same else _unit(y.column("vector")), threshold, same):
            a, b = ids[i], others[j]
            keep = a != b
            a, b, score = a[keep], b[keep], score[keep]
            parts += [(a, b, score), (b, a, score)]
            held += 2 * len(a)
            if held > bound:
                parts = [top(parts)]
                held = len(parts[0][0])
                bound = max(HELD, 2 * held)
        if held:
            a, b, score = top(parts)
            for at in range(0, len(a), PART):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + PART]) for c in (a, b, score)], schema=PAIRS)

    usable = _with_vector(rows).select("id", "vector")
    return best(_meeting(usable, usable.count(), compare, "a long, b long, score double", block_rows), k)


def best(pairs: DataFrame, k: int) -> DataFrame:
    """The k best partners of each ``a``, ties to the lower id."""
    order = Window.partitionBy("a").orderBy(F.desc(F.round("score", 12)), "b")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recomputed_importance(age_days: Column, accesses: Column, half_life: float) -> Column:
    """Falls with whole days of age, grows with the logarithm of accesses, at most 1."""
    value = F.exp(-F.floor(age_days) / half_life) * (1 + 0.1 * F.log1p(accesses))
    return F.round(F.least(value, F.lit(1.0)), 4)


#: Pairs that are left to the walk in tasks, component by component; more are settled in rounds.
WALKED_PAIRS = 100_000


def greedy_merges(pairs: DataFrame, rows: DataFrame, walked: int | None = None) -> DataFrame:
    """(kept, gone) by walking each platform's rows from newest to oldest: a row that is gone when
    its turn comes is skipped; in its turn it meets its partners (b of its pairs) that are not yet
    gone, most alike first, and of each two the less confident goes (the partner on ties).

    Turns depend on earlier ones only through rows they share.  A round settles at once all turns
    that come first for each of their rows, drops the pairs of rows that went, and leaves the rest
    to the next round, so it is joins and aggregations whatever the size of a component.  When at
    most ``walked`` pairs are left their components are walked in tasks."""
    spark = pairs.sparkSession
    walked = WALKED_PAIRS if walked is None else walked
    info = rows.select("id", "platform", "confidence", "created_minute")
    a, b = (info.select(*[F.col(c).alias(f"{s}_{c}") for c in info.columns]) for s in ("a", "b"))
    full = pairs.join(a, pairs["a"] == F.col("a_id")).join(b, pairs["b"] == F.col("b_id")).where("a_platform = b_platform and a <> b")
    turn = F.struct((-F.col("a_created_minute")).alias("newest"), F.col("a").alias("id")).alias("turn")
    at = scratch_path(spark, "merge-pairs")
    left = written_at(full.select("a", "b", "score", (F.col("a_confidence") >= F.col("b_confidence")).alias("stays"), turn), at)
    merges = pairs.sparkSession.createDataFrame([], MERGE)
    kept = F.when(F.col("stays"), F.col("a")).otherwise(F.col("b")).alias("kept")
    gone = F.when(F.col("stays"), F.col("b")).otherwise(F.col("a")).alias("gone")
    while (n := left.count()) > walked:
        touched = left.select(F.col("a").alias("v"), "a", "turn").unionByName(left.select(F.col("b").alias("v"), "a", "turn"))
        first = touched.groupBy("v").agg(F.min("turn").alias("first"), F.count("*").alias("n"))
        waiting = join_counted(touched, first, ["v"], 2 * n).where("turn > first").select("a").distinct()
        settled = written(left.join(waiting, "a", "left_anti").select(kept, gone, "a"), "merged")
        merges = merges.unionByName(settled.select("kept", "gone"))
        lost = settled.select("gone").distinct()
        rest = left.join(waiting, "a", "left_semi").join(lost, F.col("a") == F.col("gone"), "left_anti").join(lost, F.col("b") == F.col("gone"), "left_anti")
        before, at = at, scratch_path(spark, "merge-pairs")
        left = written_at(rest, at)
        discard(spark, before)
    return merges.unionByName(_walked(left)) if n else merges


def _walked(left: DataFrame) -> DataFrame:
    """The same walk over each connected component in a task."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        gone: set[int] = set()
        out = []
        pdf = pdf.sort_values(["newest", "a", "score", "b"], ascending=[True, True, False, True])
        current, skipped = None, False
        for a, b, stays in zip(pdf["a"], pdf["b"], pdf["stays"], strict=True):
            if a != current:
                current, skipped = a, a in gone
            if not skipped and b not in gone:
                out.append((a, b) if stays else (b, a))
                gone.add(out[-1][1])
        return pd.DataFrame(out, columns=["kept", "gone"])

    named = components(left.select(F.col("a").alias("u"), F.col("b").alias("v")), "merge-groups")
    grouped = left.select("a", "b", "score", "stays", F.col("turn.newest").alias("newest")).join(named, left["a"] == named["node"]).drop("node")
    return grouped.groupBy("component").applyInPandas(walk, MERGE)


MERGE = "kept long, gone long"


def without_near(new: DataFrame, near: DataFrame, overlap: Column, score: float, least_overlap: float) -> DataFrame:
    """Rows of ``new`` that have, among their neighbours in ``near`` (a, b, score, columns that
    ``overlap`` names), none above both bounds."""
    same = near.where((F.col("score") > score) & (overlap > least_overlap)).select(F.col("a").alias("id")).distinct()
    return new.join(same, "id", "left_anti")


def watcher_decisions(new: DataFrame, store: DataFrame, threshold: float, size: int) -> DataFrame:
    """(id, reason, score, matched) of new rows (id, vector, platform, session) from their
    nearest row of the store on the same platform: only near duplicates are skipped."""
    usable = F.col("vector").isNotNull() & (F.size("vector") == size)
    near = nearest_k(new.where(usable), store, 1, "platform").join(store.select(F.col("id").alias("b"), F.col("session").alias("_s")), "b")
    rows = new.join(near.select(F.col("a").alias("id"), "b", "score", "_s"), "id", "left")
    reason = (
        F.when(F.col("vector").isNull(), "embed_failed")
        .when(F.size("vector") != size, "search_failed")
        .when(F.col("b").isNull(), "no_match")
        .when(F.col("_s") != F.col("session"), "different_session")
        .when(F.col("score") >= threshold, "near_duplicate")
        .otherwise("below_threshold")
    )
    return rows.select("id", reason.alias("reason"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"), F.when(reason == "near_duplicate", F.col("b")).alias("matched"))


def corroborated(store: DataFrame, near: DataFrame, boost: float = 0.1) -> DataFrame:
    """(id, confidence, corroborated_by) of the store: rows that are near (b) a new row of
    another ``platform`` gain ``boost`` once, and those platforms."""
    by = near.groupBy(F.col("b").alias("id")).agg(F.array_sort(F.collect_set("platform")).alias("_by"))
    rows = store.join(by, "id", "left")
    grown = F.when(F.col("_by").isNotNull(), F.least(F.lit(1.0), F.col("confidence") + boost)).otherwise(F.col("confidence"))
    return rows.select("id", grown.alias("confidence"), F.coalesce("_by", F.array().cast("array<string>")).alias("corroborated_by"))


def superseding(rows: DataFrame, contradictions: DataFrame) -> DataFrame:
    """(id, status, supersedes): of ``contradictions`` (a: new, b: active) the first new row
    supersedes b, which is then no longer active for others."""
    first = contradictions.groupBy("b").agg(F.min("a").alias("a"))
    lists = first.groupBy(F.col("a").alias("id")).agg(F.array_sort(F.collect_list("b")).alias("supersedes"))
    out = rows.join(first.select(F.col("b").alias("id"), F.lit(True).alias("_gone")), "id", "left").join(lists, "id", "left")
    return out.select("id", F.when(F.col("_gone"), "superseded").otherwise(F.col("status")).alias("status"), F.coalesce("supersedes", F.array().cast("array<bigint>")).alias("supersedes"))
