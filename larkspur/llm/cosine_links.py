"""Links between vectors of one label at a least cosine, by random-hyperplane sign hashing.

1. Equal vectors of one label become one class.  A class hashes in several tables to the signs
   of its products with random normals; bits and tables follow from the number of classes so
   that a pair at the threshold meets in no table with probability ``MISS``.
2. In every bucket each class is compared with the bucket's least: verified links join most of
   a dense group to one core (connected components), at one row for each class and table.
3. Cores that share a bucket are compared by their roots and radii: the angle of two members
   is at least that of the roots less both radii, so a pair of cores beyond it holds no link.
4. Members of one core, and of pairs of cores left, are compared exactly as matrices, in parts
   of ``PART_ROWS``.  Tasks hand on each member's number of links and one link for each pair of
   cores; pairs of vectors never leave a task.
5. Components over the cores give the least id; all rows take the result of their class.

Keys that may be hot (a vector of a third of the rows, a bucket, a core, a component) are
broadcast by count (``join_counted``).  The links inside one core of m different vectors cost
m * m products of vectors, as their counts depend on every pair; what is shuffled for them is m
rows for each of m / PART_ROWS parts.  Cores of one bucket are likewise compared in parts.

Rules: a row without label, or whose vector is null, empty, zero or holds a null, NaN or infinity,
links with nothing; vectors of different lengths do not link.  Repeated rows count as other
vectors.  A row without id takes part; the least id of a component is taken over those that have
one, null if none has.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common
from larkspur.operators.components import components
from larkspur.operators.skew import join_counted

MISS, PART_ROWS = 1e-7, 1024
SEED = 12


def tables_and_bits(n: int, cosine: float) -> tuple[int, int]:
    """How many tables of how many sign bits ``n`` vectors get."""
    bits = min(60, max(8, math.ceil(math.log2(max(n, 2)))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return max(1, math.ceil(math.log(MISS) / math.log1p(-agree))), bits


def _keyed(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, key, space, raw): ``raw`` is the vector's bytes, ``key`` stands for label and
    vector and ``space`` for label and length; all three are null where nothing can link."""
    schema = pa.schema([("vec_id", pa.int64()), ("key", pa.binary()), ("space", pa.int64()), ("raw", pa.binary())])

    def columns(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for label, v in zip(batch.column("label").to_pylist(), batch.column("vector"), strict=True):
            x = None
            if label is not None and v.is_valid and len(v.values) and not v.values.null_count:
                x = v.values.to_numpy(zero_copy_only=False) + 0.0  # no negative zeros
            if x is None or not np.isfinite(x).all() or not x.any():
                out.append((None, None, None))
                continue
            space = hashlib.md5(f"{label}:{len(x)}".encode()).digest()
            out.append((hashlib.md5(space + x.tobytes()).digest(), int.from_bytes(space[:8], "little", signed=True), x.tobytes()))
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), *(pa.array([r[i] for r in out], t) for i, t in enumerate(schema.types[1:]))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                yield columns(batch.slice(at, 1024))

    made = vectors.mapInArrow(run, "vec_id long, key binary, space long, raw binary")
    return common.written(made.withColumn("row", F.monotonically_increasing_id()), "vectors")


def _units(raws: list[bytes], dtype: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raws), dtype).astype(np.float64).reshape(len(raws), -1)
    x /= np.abs(x).max(1, keepdims=True)  # squares of very large or small numbers stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@lru_cache(2)
def _normals(size: int, n: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((size, n))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers that spreads their differences."""
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return x ^ (x >> np.uint64(31))


def buckets(classes: DataFrame, dtype: str, tables: int, bits: int) -> DataFrame:
    """(cid, bucket): a row for each table of every class (cid, space, raw)."""
    weights = (np.uint64(1) << np.arange(bits, dtype=np.uint64))[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raws, cids = part.column("raw").to_pylist(), part.column("cid").to_numpy()
                spaces = part.column("space").to_numpy().astype(np.uint64)
                sizes = np.array([len(r) for r in raws])
                for size in np.unique(sizes):
                    own = np.flatnonzero(sizes == size)
                    x = _units([raws[i] for i in own], dtype)
                    signs = (x @ _normals(x.shape[1], tables * bits) > 0).reshape(len(own), tables, bits)
                    keys = (signs.astype(np.uint64) @ weights)[:, :, 0]
                    keys = _mixed(keys ^ _mixed(spaces[own, None] + np.arange(tables, dtype=np.uint64)))
                    yield pa.RecordBatch.from_pydict({"cid": np.repeat(cids[own], tables), "bucket": keys.ravel().view(np.int64)})

    return classes.select("cid", "space", "raw").mapInArrow(run, "cid long, bucket long")


def _angles(rows: DataFrame, dtype: str) -> DataFrame:
    """(cid, other, angle) of rows (cid, other, raw, other_raw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                a, b = part.column("raw").to_pylist(), part.column("other_raw").to_pylist()
                sizes = np.array([len(x) for x in a])
                angle = np.full(len(a), np.pi)
                for size in np.unique(sizes):
                    own = [i for i in np.flatnonzero(sizes == size) if len(b[i]) == size]
                    if own:
                        cosine = (_units([a[i] for i in own], dtype) * _units([b[i] for i in own], dtype)).sum(1)
                        angle[own] = np.arccos(np.clip(cosine, -1, 1))
                yield pa.RecordBatch.from_arrays([part.column("cid"), part.column("other"), pa.array(angle)], names=["cid", "other", "angle"])

    return rows.select("cid", "other", "raw", "other_raw").mapInArrow(run, "cid long, other long, angle double")


def _with_other(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """``rows`` (cid, other, raw), ``other`` perhaps very frequent, with ``other_raw``."""
    counts = rows.groupBy("other").agg(F.count("*").alias("n"))
    keys = counts.join(vectors.select(F.col("cid").alias("other"), F.col("raw").alias("other_raw")), "other")
    return join_counted(rows, keys, ["other"], rows.count())


def _groups(rows: DataFrame, keys: list[str], columns: list[str], found: Callable[[tuple, dict[str, list]], Iterator[tuple]], ddl: str) -> DataFrame:
    """What ``found`` makes of every group of ``keys``, of bounded size: a task reads its groups
    one after the other."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in columns}
        group: tuple | None = None
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(schema.types)], schema=schema)

        for batch in batches:
            named = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            values = [batch.column(c).to_pylist() for c in columns]
            for key, *row in zip(named, *values, strict=True):
                if key != group:
                    if group is not None and len(held[columns[0]]) > 1:
                        out += found(group, held)
                    held, group = {c: [] for c in columns}, key
                for c, x in zip(columns, row, strict=True):
                    held[c].append(x)
            yield made()
            out = []
        if group is not None and len(held[columns[0]]) > 1:
            out += found(group, held)
        yield made()

    return rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, *columns).mapInArrow(run, ddl)


def _near_cores(shared: DataFrame, roots: DataFrame, dtype: str, angle: float) -> DataFrame:
    """(a, b), a < b: cores that share a bucket and may hold a link, from (bucket, core) rows and
    ``roots`` (core, raw, radius)."""
    sizes = shared.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    held = join_counted(shared, sizes.withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int")), ["bucket"], shared.count())
    held = held.withColumn("part", F.pmod(F.xxhash64("core"), "parts").cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = held.select("bucket", "core", "part", F.least("part", "_o").alias("p"), F.greatest("part", "_o").alias("q")).join(roots, "core")

    def near(group: tuple, rows: dict[str, list]) -> Iterator[tuple]:
        ids, part, radius = np.array(rows["core"]), np.array(rows["part"]), np.array(rows["radius"])
        sizes = np.array([len(x) for x in rows["raw"]])
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            x = _units([rows["raw"][i] for i in own], dtype)
            apart = np.arccos(np.clip(x @ x.T, -1, 1))
            could = np.triu(apart <= angle + radius[own, None] + radius[None, own] + 1e-9, 1)
            if group[1] != group[2]:
                could &= part[own, None] != part[None, own]
            for i, j in zip(*np.nonzero(could), strict=True):
                a, b = int(ids[own[i]]), int(ids[own[j]])
                yield min(a, b), max(a, b)

    return _groups(met, ["bucket", "p", "q"], ["core", "part", "radius", "raw"], near, "a long, b long").distinct()


def _counted(members: DataFrame, pairs: DataFrame, dtype: str, cosine: float) -> DataFrame:
    """(cid, links, other) from members (cid, core, part, parts, n, raw) and ``pairs`` (a, b) of
    cores, a = b for the members of one: numbers of linked rows, and for a < b a row
    (a, null, b) where a link was found."""
    parts = members.select("core", "parts").distinct()
    a, b = parts.select(F.col("core").alias("a"), F.col("parts").alias("_m")), parts.select(F.col("core").alias("b"), F.col("parts").alias("_n"))
    items = pairs.join(a, "a").join(b, "b")
    items = items.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("i"), "_n").select("a", "b", "i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("j"))
    items = items.where("a <> b or i <= j")
    left = items.select("a", "b", "i", "j", F.col("a").alias("core"), F.col("i").alias("part"), F.lit(0).alias("side"))
    right = items.where("a <> b or i <> j").select("a", "b", "i", "j", F.col("b").alias("core"), F.col("j").alias("part"), F.lit(1).alias("side"))
    rows = left.unionByName(right).join(members.select("core", "part", "cid", "n", "raw"), ["core", "part"])

    def count(group: tuple, held: dict[str, list]) -> Iterator[tuple]:
        x, ids, n = _units(held["raw"], dtype), np.array(held["cid"]), np.array(held["n"], np.int64)
        side = np.array(held["side"])
        if side.any():
            u, v = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            hit = x[u] @ x[v].T >= cosine
            sums = ((ids[u], hit @ n[v]), (ids[v], hit.T @ n[u]))
        else:
            hit = x @ x.T >= cosine
            np.fill_diagonal(hit, False)
            sums = ((ids, hit @ n),)
        for who, links in sums:
            at = np.flatnonzero(links)
            yield from zip(who[at].tolist(), links[at].tolist(), [None] * len(at), strict=True)
        if group[0] != group[1] and hit.any():
            yield group[0], None, group[1]

    return _groups(rows, ["a", "b", "i", "j"], ["side", "cid", "n", "raw"], count, "cid long, links long, other long")


def cosine_links(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, vector: array of
    float or double, label)."""
    dtype = "<f4" if vectors.schema["vector"].dataType.elementType.typeName() == "float" else "<f8"
    common.small_arrow(vectors.sparkSession)
    cast = "array<float>" if dtype == "<f4" else "array<double>"
    rows = _keyed(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast(cast).alias("vector"), F.col("label").cast("string").alias("label")))
    told = rows.where("key is not null").groupBy("key").agg(F.min("row").alias("cid"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    told = common.written(told, "classes")
    total = told.count()
    tables, bits = tables_and_bits(total, cosine)
    classes = common.written(told.select("cid", "n", "least").join(rows.select(F.col("row").alias("cid"), "space", "raw"), "cid"), "class-vectors")
    vecs = classes.select("cid", "raw")

    # Cores: what verified links to the least of each bucket join.
    keys = common.written(buckets(classes, dtype, tables, bits), "sign-buckets")
    leaders = keys.groupBy("bucket").agg(F.min("cid").alias("other"), F.count("*").alias("n")).where("n > 1")
    star = join_counted(keys, leaders, ["bucket"], total * tables).where("cid <> other").select("cid", "other").distinct()
    star = common.written(star.join(vecs, "cid"), "stars")
    angle = math.acos(cosine)
    linked = _angles(_with_other(star, vecs), dtype).where(F.col("angle") <= angle)
    cores = components(linked.select(F.col("cid").alias("u"), F.col("other").alias("v")), "cores")
    placed = classes.join(cores.select(F.col("node").alias("cid"), F.col("component").alias("core")), "cid", "left").withColumn("core", F.coalesce("core", "cid"))
    placed = common.written(placed, "placed")

    # Radii around the roots, which are the least of each core.
    grown = placed.where("cid <> core").select("cid", F.col("core").alias("other"), "raw")
    radius = _angles(_with_other(grown, vecs), dtype).groupBy(F.col("other").alias("core")).agg(F.max("angle").alias("radius"), (F.count("*") + 1).alias("size"))
    radius = common.written(radius, "radii")
    roots = placed.where("cid = core").select("core", "raw").join(radius, "core", "left").select("core", "raw", F.coalesce("radius", F.lit(0.0)).alias("radius"))
    shared = common.written(keys.join(placed.select("cid", "core"), "cid").select("bucket", "core").distinct(), "shared-buckets")
    near = _near_cores(shared, roots, dtype, angle)

    pairs = common.written(near.unionByName(radius.select(F.col("core").alias("a"), F.col("core").alias("b"))), "core-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("core")).distinct()
    parts = wanted.join(radius.select("core", "size"), "core", "left").select("core", F.ceil(F.coalesce("size", F.lit(1)) / PART_ROWS).cast("int").alias("parts"), F.coalesce("size", F.lit(1)).alias("_size"))
    members = join_counted(placed.select("cid", "core", "n", "raw"), parts, ["core"], total, "_size").withColumn("part", F.pmod(F.xxhash64("cid"), "parts").cast("int"))
    found = common.written(_counted(common.written(members, "members"), pairs, dtype, cosine), "found-links")

    joined = components(found.where("links is null").select(F.col("cid").alias("u"), F.col("other").alias("v")), "core-links")
    links = found.where("links is not null").groupBy("cid").agg(F.sum("links").alias("links"))
    whole = placed.select("cid", "n", "least", "core").join(links, "cid", "left")
    whole = whole.withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("n") - 1)
    of_core = whole.groupBy("core").agg(F.min("least").alias("least"), F.count("*").alias("_size"))
    of_core = of_core.join(joined.select(F.col("node").alias("core"), "component"), "core", "left").withColumn("component", F.coalesce("component", "core"))
    of_core = common.written(of_core, "core-ids")
    least = of_core.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    of_core = join_counted(of_core.select("core", "_size", "component"), least, ["component"], total).select("core", "_size", "component_id")
    done = join_counted(whole.select("cid", "core", "n_links"), of_core, ["core"], total, "_size").select("cid", "n_links", "component_id")

    answer = told.select("key", "cid", "n").join(done, "cid").select("key", "n", "n_links", "component_id")
    some = join_counted(rows.where("key is not null").select("vec_id", "key"), answer, ["key"], rows.count()).select("vec_id", "n_links", "component_id")
    none = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
