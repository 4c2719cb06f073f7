"""An index of vectors: inverted lists around trained centroids, with exact bounds.

Centroids are trained on a bounded sample (``SAMPLE_ROWS``) and there are at most ``MAX_LISTS``,
so they are small enough to send to every task; every row is filed in the list of its nearest
centroid, and a list knows the widest angle between its centroid and a row.  Lists are held in
groups of about ``BLOCK`` rows.  A search sends each query once to every group with a list that may
answer it, and with it a bit for each list of the group; tasks compare the lists' rows with their
own queries as matrices and hand on the best only.  So a query is shuffled at most once for each
``BLOCK`` rows, however many lists it must read.

* ``pairs`` (all above a cosine) is exact: the angle of a query to any row of a list is at
  least its angle to the centroid less the list's widest angle.
* ``nearest`` with ``exact=False`` reads the ``probes`` nearest lists, a number chosen on the
  sample so that ``TARGET`` of the true neighbours are found there.  With ``exact=True`` a second
  pass reads those further lists whose bound is below the k-th best found.

How much the bounds save depends on the data: clustered vectors are pruned to a few lists,
directions that are spread evenly are not, and then all lists are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import scratch
from larkspur.operators.dedup import PAIRS, _above, _unit, best

SAMPLE_ROWS, MAX_LISTS, ROUNDS, TARGET = 20_000, 4096, 10, 0.95
#: Rows and queries that meet in one task; queries and rows of a list that are compared at once.
BLOCK, ASKED, READ = 32_768, 1024, 4096


def train(sample: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means; a list that runs empty starts again
    at the vector that is farthest from its own centroid."""
    r = np.random.default_rng(seed)
    centroids = sample[r.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        scores = sample @ centroids.T
        own = scores.argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(size == 0)
        far = np.argsort(scores[np.arange(len(sample)), own])[: len(empty)]
        sums[empty[: len(far)]], size[empty[: len(far)]] = sample[far], 1.0
        centroids = sums / np.where(size == 0, 1, size)[:, None]
    return centroids


def needed_probes(sample: np.ndarray, centroids: np.ndarray, k: int = 10, queries: int = 200) -> int:
    """How many nearest lists hold ``TARGET`` of the k nearest rows, over some rows of the sample."""
    asked = sample[:queries]
    scores = asked @ sample.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argsort(-scores, 1)[:, : min(k, len(sample) - 1)]
    if not near.size:
        return 1
    own = (sample @ centroids.T).argmax(1)
    rank = np.argsort(np.argsort(-(asked @ centroids.T), 1), 1)
    places = np.sort(np.take_along_axis(rank, own[near], 1).ravel())
    return int(places[min(len(places) - 1, math.ceil(TARGET * len(places)) - 1)]) + 1


@dataclass
class VectorIndex:
    rows: DataFrame  #: id, vector, list, and the other columns of the table
    lists: DataFrame  #: list, n, widest
    centroids: np.ndarray
    probes: int

    @classmethod
    def build(cls, vectors: DataFrame, lists: int | None = None, sample_rows: int = SAMPLE_ROWS, name: str = "vector-index") -> VectorIndex:
        """File the rows (id, vector, more) that have a vector; all vectors are of one length."""
        spark = vectors.sparkSession
        usable = vectors.where("id is not null and vector is not null")
        n = usable.count()
        share = min(1.0, 1.2 * sample_rows / max(n, 1))
        drawn = usable.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000)).select("vector").limit(sample_rows)
        sample = _unit(drawn.toArrow().column("vector")) if n else np.zeros((0, 1))
        k = min(MAX_LISTS, lists or max(1, round(math.sqrt(n))))
        centroids = train(sample, k) if len(sample) else np.zeros((0, 1))
        sent = spark.sparkContext.broadcast(centroids)

        def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = _unit(batch.column("vector")) @ sent.value.T
                own = scores.argmax(1)
                angle = np.arccos(np.clip(scores[np.arange(len(own)), own], -1, 1))
                yield batch.append_column("list", pa.array(own, pa.int32())).append_column("angle", pa.array(angle))

        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in usable.schema.fields)
        filed = usable.mapInArrow(file, f"{ddl}, list int, angle double") if n else usable.select("*", F.lit(0).alias("list"), F.lit(0.0).alias("angle"))
        rows = scratch.written(filed.repartitionByRange("list", "id").sortWithinPartitions("list", "id"), name)
        held = scratch.written(rows.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("widest")), f"{name}-lists")
        return cls(rows.drop("angle"), held, centroids, needed_probes(sample, centroids) if len(sample) else 1)

    def _grouped(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every list its rows, widest angle (-1: empty) and group, and every group's number of parts:
        lists in order, up to ``BLOCK`` rows together (fewer in small tables, so that all cores work); a
        longer list is a group by itself, in parts."""
        n, widest = np.zeros(len(self.centroids), np.int64), np.full(len(self.centroids), -1.0)
        for r in self.lists.collect():  # at most MAX_LISTS rows
            n[r.list], widest[r.list] = r.n, r.widest
        most = min(BLOCK, max(2048, int(n.sum()) // 6))
        group, sizes = np.zeros(len(n), np.int64), [0]
        for i, size in enumerate(n):
            if sizes[-1] and sizes[-1] + size > most:
                sizes.append(0)
            sizes[-1] += int(size)
            group[i] = len(sizes) - 1
        return n, widest, group, np.maximum(1, -(-np.array(sizes) // BLOCK))

    def _routed(self, queries: DataFrame, keep) -> DataFrame:
        """(q, qv, grp, asked) of every query and each group with a list that ``keep`` marks in
        (queries, lists), given the angles, the lists' widest angles and the batch; asked holds a bit
        for each list of the group."""
        kind = queries.schema["vector"].dataType.simpleString()
        schema = f"q long, qv {kind}, grp int, asked binary"
        if not len(self.centroids):
            return queries.sparkSession.createDataFrame([], schema)
        _, widest, group, parts = self._grouped()
        starts = np.searchsorted(group, np.arange(len(parts) + 1))
        sent = queries.sparkSession.sparkContext.broadcast((self.centroids, widest, starts))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids, widest, starts = sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    angles = np.arccos(np.clip(_unit(part.column("vector")) @ centroids.T, -1, 1))
                    kept = keep(angles, widest, part) & (widest >= 0)
                    for g in range(len(starts) - 1):
                        of_group = kept[:, starts[g] : starts[g + 1]]
                        i = np.flatnonzero(of_group.any(1))
                        if len(i):
                            asked = pa.array([row.tobytes() for row in np.packbits(of_group[i], axis=1)], pa.binary())
                            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(i)), part.column("vector").take(pa.array(i)), pa.array(np.full(len(i), g), pa.int32()), asked], names=["q", "qv", "grp", "asked"])

        return queries.mapInArrow(route, schema)

    def _compared(self, routed: DataFrame, found, n: int, later: bool = False) -> DataFrame:
        """(a, b, score) that ``found`` picks from the ids and unit vectors of queries and of rows of a
        list; ``n`` is the number of queries, which are cut into parts of about ``BLOCK``.
        With ``later`` rows up to the least id of the queries at hand are passed over."""
        if not len(self.centroids):
            return routed.sparkSession.createDataFrame([], "a long, b long, score double")
        _, _, group, parts = self._grouped()
        cut = max(1, -(-n // BLOCK), min(4, n // 512))
        of = routed.sparkSession.createDataFrame([(i, int(g), int(parts[g])) for i, g in enumerate(group)], "list int, grp int, _n int")
        every = lambda c: F.explode(F.sequence(F.lit(0), c - 1))
        rows = self.rows.select("id", "vector", "list").join(F.broadcast(of), "list")  # at most MAX_LISTS rows
        rows = rows.select("id", "vector", "list", F.lit(None).cast("binary").alias("asked"), "grp", F.pmod(F.xxhash64("id"), "_n").cast("int").alias("part"), every(F.lit(cut)).alias("qpart"))
        queries = routed.join(F.broadcast(of.select("grp", "_n").distinct()), "grp")
        queries = queries.select(F.col("q").alias("id"), F.col("qv").alias("vector"), F.lit(None).cast("int").alias("list"), "asked", "grp", every(F.col("_n")).alias("part"), F.pmod(F.xxhash64("q"), F.lit(cut)).cast("int").alias("qpart"))
        sent = routed.sparkSession.sparkContext.broadcast(np.searchsorted(group, np.arange(len(parts))))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            both = pa.Table.from_batches(batches)
            query = pc.is_null(both.column("list"))
            x, y = both.filter(query).sort_by("id"), both.filter(pc.invert(query)).sort_by([("list", "ascending"), ("id", "ascending")])
            if not x.num_rows or not y.num_rows:
                return
            ids, others, lists = x.column("id").to_numpy(), y.column("id").to_numpy(), y.column("list").to_numpy()
            own, held = _unit(x.column("vector")), _unit(y.column("vector"))
            bits = np.frombuffer(b"".join(x.column("asked").to_pylist()), np.uint8).reshape(len(ids), -1)
            first = int(sent.value[x.column("grp")[0].as_py()])
            for value in np.unique(lists):
                at, bit = divmod(int(value) - first, 8)
                asking = np.flatnonzero(bits[:, at] >> (7 - bit) & 1)
                start, end = np.searchsorted(lists, [value, value + 1])
                for k in range(0, len(asking), ASKED):
                    which = asking[k : k + ASKED]
                    after = np.searchsorted(others[start:end], ids[which[0]], "right") if later else 0
                    for low in range(start + after, end, READ):
                        high = min(end, low + READ)
                        for i, j, score in found(ids[which], own[which], others[low:high], held[low:high]):
                            if len(i):
                                yield pa.RecordBatch.from_arrays([pa.array(ids[which[i]]), pa.array(others[low + j]), pa.array(score)], schema=PAIRS)

        return queries.unionByName(rows).groupBy("grp", "part", "qpart").applyInArrow(compare, "a long, b long, score double")

    def pairs(self, queries: DataFrame, cosine: float, later: bool = False) -> DataFrame:
        """(a, b, score): every query (id, vector) with every other row at ``cosine`` or above; with
        ``later`` with rows of a greater id only, so that a table meets itself once."""
        most = math.acos(cosine) + 1e-9
        routed = self._routed(queries.select("id", "vector"), lambda angles, widest, _: angles - widest <= most)

        def near(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
            for i, j, score in _above(x, y, cosine, False):
                keep = ids[i] < others[j] if later else ids[i] != others[j]
                yield i[keep], j[keep], score[keep]

        return self._compared(routed, near, queries.count(), later)

    def nearest(self, queries: DataFrame, k: int, probes: int | None = None, exact: bool = True) -> DataFrame:
        """(a, b, score, rank): the ``k`` nearest other rows of each query, ties to the lower id."""
        n, asked = probes or self.probes, queries.count()
        few = lambda angles: np.argsort(np.argsort(angles, 1, kind="stable"), 1) < n

        def top(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
            scores = x @ y.T
            scores[ids[:, None] == others[None]] = -np.inf
            at = np.argsort(-np.round(scores, 12), 1, kind="stable")[:, :k]
            i = np.repeat(np.arange(len(scores)), at.shape[1])
            keep = np.isfinite(scores[i, at.ravel()])
            i, j = i[keep], at.ravel()[keep]
            yield i, j, scores[i, j]

        first = best(self._compared(self._routed(queries.select("id", "vector"), lambda angles, *_: few(angles)), top, asked), k)
        if not exact:
            return first
        first = scratch.written(first, "probed")
        bound = first.where(F.col("rank") == k).select(F.col("a").alias("id"), F.col("score").alias("bound"))
        again = queries.select("id", "vector").join(bound, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(-1.0)))

        def further(angles: np.ndarray, widest: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
            most = np.arccos(np.clip(batch.column("bound").to_numpy(), -1, 1))
            return ~few(angles) & (angles - widest <= most[:, None] + 1e-9)

        more = self._compared(self._routed(again, further), top, asked)
        return best(first.drop("rank").unionByName(more), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(recall): the share of the rows (a, b) of ``exact`` that are in ``found``."""
    both = exact.select("a", "b").join(found.select("a", "b").withColumn("hit", F.lit(1)), ["a", "b"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
