"""Near-duplicates: SimHash fingerprints linked through covering hashing.

A fingerprint has 64 bits voted by the hashes of all word shingles.  For radius
r, bit i is given a vector f(i) of r + 1 bits; for each non-zero v of the
2**(r+1) - 1 vectors, the mask of bits with f(i).v odd makes one table.  Two
fingerprints that differ in at most r bits agree under some mask: r linear
conditions on r + 1 bits have a non-zero solution.

Only distinct fingerprints are compared.  A bucket of up to ``LARGE`` of them is
compared in blocks inside a task, which keeps one link for each newly joined
pair of groups, not all pairs.  A larger bucket is divided further without loss:
fingerprints that agree after clearing r of the bits left free by the mask are
within the radius, and such subgroups hold at most 2**r, so all their members
are linked to the least one.

Rules: null and wordless texts have fingerprint zero and are linked like any
other; rows with a null ``doc_id`` keep their fingerprint, and their component is
the least ``doc_id`` reachable (null if there is none).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common
from larkspur.operators.components import components
from larkspur.operators.skew import join_counted

LARGE = 8192


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included, of the text with A-Z lowered."""
    from xxhash import xxh64_intdigest

    split = text.lower().split()
    if not split:
        return np.empty(0, np.uint64)
    joined = b" ".join(split)
    if len(split) <= words:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(split) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in spans), np.uint64, len(split) - words + 1)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each 1 if set in over half of the hashes."""
    if not len(hashes):
        return 0
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        bits += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp: signed 64-bit) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def columns(batch: pa.RecordBatch) -> dict[str, object]:
        common.drop_worker_cache()
        found = [majority(shingle_hashes(t, words)) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "fp": np.array(found, np.uint64).view(np.int64)}

    return common.keyed_texts(docs).mapInArrow(common.map_columns(columns, schema), "doc_id long, fp long")


def masks(radius: int, bits: int = 64) -> list[int]:
    """The covering masks of so many bits, as unsigned integers."""
    vectors = range(1, 1 << (radius + 1))
    of_bit = [vectors[i % len(vectors)] for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (of_bit[i] & v).bit_count() & 1) for v in vectors]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, radius: int, block: int = 512) -> list[tuple[int, int]]:
    """Links that join all fingerprints reachable within ``radius``, at most one
    fewer than there are, from blockwise comparison."""
    x = fps.view(np.uint64)
    parent = np.arange(len(x))
    links = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a in range(0, len(x), block):
        for b in range(a, len(x), block):
            near = np.bitwise_count(x[a : a + block, None] ^ x[None, b : b + block]) <= radius
            for i, j in zip(*np.nonzero(near), strict=True):
                if a + i < b + j:
                    p, q = root(a + i), root(b + j)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        links.append((int(fps[a + i]), int(fps[b + j])))
    return links


def _bucket_links(buckets: DataFrame, radius: int) -> DataFrame:
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for fps in batch.column("fps") for x in forest(fps.values.to_numpy(), radius)]
            yield pa.RecordBatch.from_pydict({"u": [u for u, _ in found], "v": [v for _, v in found]}, schema=schema)

    return buckets.select("fps").mapInArrow(link, "u long, v long")


def links(distinct: DataFrame, radius: int = 2, large: int = LARGE) -> DataFrame:
    """(u, v) links that connect all ``fp`` of ``distinct`` within ``radius``, none lost."""
    tables = masks(radius)
    literal = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(tables)])
    keyed = distinct.select("fp", F.explode(literal).alias("x")).select("fp", F.col("x.t").alias("t"), F.col("x.mask").bitwiseAND(F.col("fp")).alias("key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    sized = join_counted(keyed, sizes.withColumn("held", F.col("n")), ["t", "key"], distinct.count() * len(tables)).withColumnRenamed("held", "n")
    small = sized.where(F.col("n") <= large).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
    found = _bucket_links(small, radius)
    free = [[i for i in range(64) if not m >> i & 1] for m in tables]
    holes = F.create_map(*[y for t, bits in enumerate(free) for y in (F.lit(t), F.array(*[F.lit(_signed(~sum(1 << i for i in c) & (1 << 64) - 1)) for c in combinations(bits, radius)]))]) if radius else None
    if holes is not None:
        big = sized.where(F.col("n") > large).select("t", "key", "fp", F.explode(holes[F.col("t")]).alias("hole"))
        groups = big.groupBy("t", "hole", F.col("fp").bitwiseAND(F.col("hole")).alias("rest")).agg(F.collect_set("fp").alias("fps"), F.min("fp").alias("v"))
        found = found.unionByName(groups.where(F.size("fps") > 1).select(F.explode("fps").alias("u"), "v"))
    return found.where("u <> v")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, large: int = LARGE) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``."""
    prints = common.written(fingerprints(docs, words), "fingerprints")
    distinct = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "distinct-fingerprints")
    grouped = components(links(distinct.select("fp"), radius, large).distinct(), "links")
    classes = distinct.join(grouped.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    total = prints.count()
    named = join_counted(classes, least, ["component"], total).select("fp", "rows", "component_id")
    return join_counted(prints, named, ["fp"], total, "rows").select("doc_id", "fp", "component_id")


# Similarity of shingle sets ----------------------------------------------------------
#
# A set is fingerprinted as above, over its distinct shingles and in as many bits as are
# needed: ``PRINT_BITS`` to compare by and further blocks to meet by.  At similarity s a bit
# differs with probability arccos(2s / (1 + s)) / pi, 0.15 at 0.8, so no radius that covering
# masks can hold reaches over a whole fingerprint.  They are laid over each block instead: sets
# whose prints differ in at most ``BLOCK_RADIUS`` bits of any block agree under a mask there and
# are compared by their prints.  ``block_plan`` takes as many blocks as leave a pair at 0.8
# apart in all with a probability of ``MISSED``, and blocks so long that a mask's bucket holds
# about ``BUCKET`` sets.  A pair at 0.8 has over ``MOST_BITS`` different bits in its prints with
# a probability of 4e-8, an unlike pair as few as these with 2e-8.  What prints join is a
# cluster; inside it a pair is linked only if the exact similarity of its sets of distinct
# shingles is at least ``LEAST_ALIKE``.  Tasks keep one link for each newly joined pair of
# groups, so no step makes more rows than the buckets hold.

LEAST_ALIKE, BLOCK_RADIUS, MISSED, BUCKET = (4, 5), 1, 1e-6, 1024
PRINT_BITS, MOST_BITS = 192, 58
#: Shingles of a cluster that one task compares, in bytes.
PART_BYTES = 1 << 24


def block_plan(count: int, least: tuple[int, int] = LEAST_ALIKE) -> tuple[int, int]:
    """(blocks, bits of each) for so many sets."""
    s = least[0] / least[1]
    third = max(2, math.ceil(math.log2(max(count, BUCKET) / BUCKET) / 2))
    # Three masks, each of two thirds of a block: one agrees if two thirds or all of them do.
    agrees = (1 - math.acos(2 * s / (1 + s)) / math.pi) ** third
    met = 3 * agrees**2 * (1 - agrees) + agrees**3
    return math.ceil(math.log(MISSED) / math.log(1 - met)), 3 * third


@functools.cache
def _mixers(words: int) -> np.ndarray:
    return np.random.default_rng(1).integers(0, 1 << 64, (2, words), np.uint64) | np.uint64(1)


def wide_majority(hashes: np.ndarray, bits: int) -> np.ndarray:
    """So many bits, each 1 if set in over half of the hashes, which are widened to as many."""
    words = -(-bits // 64)
    flip, times = _mixers(words)
    votes = np.zeros(words * 64, np.int64)
    for i in range(0, len(hashes), 255):  # so many are counted in a byte
        x = (hashes[i : i + 255, None] ^ flip) * times
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        votes += np.unpackbits(x.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return (votes * 2 > len(hashes))[:bits]


def block_prints(shingles: np.ndarray, blocks: int, bits: int) -> tuple[bytes, bytes]:
    """The print of a set, and its blocks as 32-bit numbers, none for an empty set."""
    if not len(shingles):
        return bytes(PRINT_BITS // 8), b""
    found = wide_majority(shingles, PRINT_BITS + blocks * bits)
    numbers = found[PRINT_BITS:].reshape(blocks, bits) @ (1 << np.arange(bits, dtype=np.uint32))
    return np.packbits(found[:PRINT_BITS]).tobytes(), numbers.astype(np.uint32).tobytes()


def prints_of(found: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(found), np.uint64).reshape(len(found), PRINT_BITS // 64)


def _sets(texts: DataFrame, words: int, of: Callable[[np.ndarray], tuple], types: str) -> DataFrame:
    """(doc_id, text_key, node, what ``of`` makes of the distinct shingles): equal sets have one ``node``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = f"doc_id long, text_key binary, node long, {types}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def columns(batch: pa.RecordBatch) -> dict[str, object]:
        from xxhash import xxh3_64_digest

        common.drop_worker_cache()
        sets = [np.unique(shingle_hashes(t, words)) for t in batch.column("text").to_pylist()]
        nodes = np.frombuffer(b"".join(xxh3_64_digest(x.tobytes()) for x in sets), np.int64)
        made = zip(*map(of, sets), strict=True)
        return {"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "node": nodes} | dict(zip(schema.names[3:], made, strict=True))

    return texts.mapInArrow(common.map_columns(columns, schema), ddl)


def _block_keys(nodes: DataFrame, bits: int) -> DataFrame:
    """(key, node, print) for every block of ``nodes`` and covering mask."""
    ddl = "key long, node long, print binary"
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("print", pa.binary())])
    cover = np.array(masks(BLOCK_RADIUS, bits), np.int64)

    def columns(batch: pa.RecordBatch) -> dict[str, object]:
        found = [np.frombuffer(x, np.uint32) for x in batch.column("blocks").to_pylist()]
        row = pa.array(np.repeat(np.arange(len(found)), [len(x) * len(cover) for x in found]))
        numbers = np.concatenate([np.empty(0, np.int64), *found]).astype(np.int64)
        block = np.concatenate([np.empty(0, np.int64), *(np.arange(len(x)) for x in found)])
        table = block[:, None] * len(cover) + np.arange(len(cover))
        keys = (numbers[:, None] & cover) | table << 32
        return {"key": keys.ravel(), "node": batch.column("node").take(row), "print": batch.column("print").take(row)}

    return nodes.select("node", "print", "blocks").mapInArrow(common.map_columns(columns, schema, "blocks", 1 << 18), ddl)


def print_forest(node: np.ndarray, part: np.ndarray, prints: np.ndarray, most: int, block: int = 256) -> list[tuple[int, int]]:
    """Links that join all rows reachable through pairs with at most ``most`` different bits:
    at most one link fewer than rows.  If there are several parts, only rows of different
    ones are compared."""
    one = part.min() == part.max()
    root, found = np.arange(len(node)), []
    for a in range(0, len(node), block):
        apart = sum(np.bitwise_count(prints[a : a + block, None, w] ^ prints[None, a:, w]) for w in range(prints.shape[1]))
        near = apart <= most
        if not one:
            near &= part[a : a + block, None] != part[None, a:]
        for i in np.flatnonzero(near.sum(1) > one).tolist():  # one: itself
            u = a + i
            at = np.flatnonzero(near[i, i + 1 :]) + u + 1
            for v in at[root[at] != root[u]].tolist():
                if root[v] != root[u]:
                    found.append((int(node[u]), int(node[v])))
                    root[root == root[v]] = root[u]
    return found


def print_links(nodes: DataFrame, bits: int, most: int, large: int = LARGE) -> DataFrame:
    """(u, v) links that connect all ``nodes`` (node, print, blocks of so many bits) that meet
    in a bucket and have at most ``most`` different bits in their prints."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links_of(bucket: list[np.ndarray]) -> list[tuple[int, int]]:
            return print_forest(*bucket, most) if len(bucket[0]) > 1 else []

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"u": [u for u, _ in found], "v": [v for _, v in found]}, schema=schema)

        held: list[np.ndarray] = []  # rows of the last bucket seen, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [*(batch.column(c).to_numpy() for c in ("bucket", "node", "part")), prints_of(batch.column("print").to_pylist())]
            if held:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            cuts = np.append(0, np.flatnonzero(np.diff(rows[0])) + 1).tolist()
            yield out([x for a, b in zip(cuts[:-1], cuts[1:], strict=True) for x in links_of([r[a:b] for r in rows[1:]])])
            held = [r[cuts[-1] :] for r in rows]
        if held:
            yield out(links_of(held[1:]))

    # Keys of many sets are few; a bucket over the bound is dealt in parts that all meet.
    keyed = _block_keys(nodes, bits)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > large)
    dealt = _in_parts(keyed.join(F.broadcast(sizes), "key", "left"), F.coalesce(F.ceil(F.col("size") * 2 / large), F.lit(1)))
    bucket = F.when(F.col("size").isNull(), F.col("key")).otherwise(F.xxhash64("key", "p", "q"))
    placed = dealt.select(bucket.alias("bucket"), "part", "node", "print")
    return placed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "u long, v long").distinct()


def like_forest(rows: list[tuple], least: tuple[int, int], most: int, one: bool) -> list[tuple[int, int]]:
    """Links that join all rows (node, n, part, print, shingles) reachable through pairs of
    similar size with at most ``most`` different bits in their prints whose sets are alike to
    ``least``: at most one link fewer than rows.  Unless ``one``, only rows of different parts
    are compared."""
    node, n, part = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    prints = prints_of([r[3] for r in rows])
    # Shingles as numbers from 0, of all rows in turn.
    _, ids = np.unique(np.frombuffer(b"".join(r[4] for r in rows), np.int64), return_inverse=True)
    ends = np.cumsum(n)
    mark = np.zeros(int(ids.max(initial=-1)) + 1, bool)
    root, found = np.arange(len(rows)), []
    for u in range(len(rows) - 1):
        small, large = np.minimum(n[u + 1 :], n[u]), np.maximum(n[u + 1 :], n[u])
        could = (root[u + 1 :] != root[u]) & (small * least[1] >= large * least[0])
        if not one:
            could &= part[u + 1 :] != part[u]
        at = np.flatnonzero(could) + u + 1
        at = at[np.bitwise_count(prints[at] ^ prints[u]).sum(1) <= most]
        if len(at):
            own = ids[ends[u] - n[u] : ends[u]]
            mark[own] = True
            sizes = n[at]
            stop = np.cumsum(sizes)
            hit = mark[ids[np.repeat(ends[at] - stop, sizes) + np.arange(stop[-1])]]
            both = np.add.reduceat(hit, stop - sizes, dtype=np.int64)
            mark[own] = False
            at = at[both * sum(least) >= (n[u] + sizes) * least[0]]
        for v in at.tolist():
            if root[v] != root[u]:
                found.append((int(node[u]), int(node[v])))
                root[root == root[v]] = root[u]
    return found


def _forests(dealt: DataFrame, keys: list[str], columns: list[str], least: tuple[int, int], most: int) -> DataFrame:
    """The links (u, v) of every group of ``keys``, of which the last two are the parts that meet."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group: tuple | None = None
        found: list[tuple[int, int]] = []
        for batch in batches:
            named = zip(*(batch.column(c).to_pylist() for c in keys), strict=True)
            for key, row in zip(named, zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True):
                if key != group:
                    if len(held) > 1:
                        found += like_forest(held, least, most, group[-1] == group[-2])
                    held, group = [], key
                held.append(row)
            yield pa.RecordBatch.from_pydict({"u": [u for u, _ in found], "v": [v for _, v in found]}, schema=schema)
            found = []
        if len(held) > 1:
            found = like_forest(held, least, most, group[-1] == group[-2])
        yield pa.RecordBatch.from_pydict({"u": [u for u, _ in found], "v": [v for _, v in found]}, schema=schema)

    return dealt.repartition(*keys).sortWithinPartitions(*keys).select(*keys, *columns).mapInArrow(run, "u long, v long").distinct()


def _in_parts(rows: DataFrame, parts) -> DataFrame:
    """``rows`` with their ``part`` of ``parts`` and, once for each other part that they meet, p and q."""
    numbered = rows.withColumn("_parts", F.greatest(parts, F.lit(1)).cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int"))
    met = numbered.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return met.withColumn("p", F.least("part", "_other")).withColumn("q", F.greatest("part", "_other"))


def text_key(name: str = "text"):
    """What tells texts of one ``doc_id`` apart."""
    return F.unhex(F.md5(common.text_bytes(name)))


def similar_documents(docs: DataFrame, words: int = 5, least: tuple[int, int] = LEAST_ALIKE, large: int = LARGE) -> DataFrame:
    """(doc_id, component_id) of every row with a ``doc_id``: the least ``doc_id`` reachable
    through texts whose sets of shingles are alike to ``least`` (numerator, denominator)."""
    return similar_rows(docs.where("doc_id is not null"), words, least, large).select("doc_id", F.col("first.doc_id").alias("component_id"))


def similar_rows(docs: DataFrame, words: int = 5, least: tuple[int, int] = LEAST_ALIKE, large: int = LARGE) -> DataFrame:
    """(doc_id, text_key, first) of every row: ``first`` (absent, doc_id, text_key) is the
    least such row that is linked to it, rows without a ``doc_id`` after all others."""
    from_texts = common.keyed_texts(docs).withColumn("text_key", F.unhex(F.md5("text")))
    blocks, bits = block_plan(docs.count(), least)
    rows = common.written(_sets(from_texts, words, lambda x: (len(x), *block_prints(x, blocks, bits)), "n long, print binary, blocks binary"), "prints")
    # Equal sets are one node.  Nodes that agree under a mask of a block are compared by their
    # prints inside tasks, which join them to clusters.
    nodes = rows.groupBy("node").agg(F.min("text_key").alias("text_key"), *[F.first(c).alias(c) for c in ("n", "print", "blocks")])
    nodes = common.written(nodes, "nodes")
    edges = print_links(nodes, bits, MOST_BITS, large)
    cluster = common.written(components(edges, "clusters").withColumnRenamed("component", "cluster"), "cluster-nodes")

    # Within a cluster the sets themselves are compared, in parts of bounded size.
    wanted = common.written(nodes.drop("blocks").join(cluster, "node"), "wanted")
    # Texts are shuffled at any size: a broadcast of their keys would grow with the clusters.
    again = _sets(from_texts.join(wanted.select("text_key").hint("merge"), "text_key", "left_semi"), words, lambda x: (x.tobytes(),), "shingles binary")
    sets = again.groupBy("node").agg(F.first("shingles").alias("shingles"))
    sizes = wanted.groupBy("cluster").agg(F.sum(F.col("n") * 8).alias("bytes"))
    held = _in_parts(wanted.join(sizes, "cluster"), F.ceil(F.col("bytes") * 2 / PART_BYTES)).join(sets, "node")
    links = _forests(held, ["cluster", "p", "q"], ["node", "n", "part", "print", "shingles"], least, MOST_BITS)

    row = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_key")
    held = rows.groupBy("node").agg(F.min(row).alias("first"), F.count("*").alias("rows"))
    groups = common.written(held.join(components(links, "set-links"), "node", "left").withColumn("component", F.coalesce("component", "node")), "groups")
    total = rows.count()
    least = groups.groupBy("component").agg(F.min("first").alias("first"), F.count("*").alias("n"))
    named = join_counted(groups.select("node", "rows", "component"), least, ["component"], total).select("node", "rows", "first")
    return join_counted(rows.select("doc_id", "text_key", "node"), named, ["node"], total, "rows").select("doc_id", "text_key", "first")


def hexed(name: str = "fp"):
    """16 lowercase hex digits of a signed 64-bit column."""
    return F.lower(F.lpad(F.hex(F.col(name)), 16, "0"))
