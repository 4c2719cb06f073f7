"""Spelling variants: words of a collection grouped with the frequent words one edit away.

Words are counted inside tasks and summed.  The vocabulary, sorted by length, is cut into
shards of bounded size, each a compact trie: nodes in breadth-first order, the labels in one
string and the children of a node side by side.  Groups of shards of at most ``GROUP_BYTES``
are broadcast in turn.  Every word within a group's lengths is run against every trie of it:
a depth-first walk that keeps, beside the node, the states of the word's distance-one
Levenshtein automaton, and emits the accepting words.  A task reduces them to their count and
the most frequent one, and so does Spark over the groups.  Forms are followed to their roots by
pointer doubling; a form occurs at least twice as often, so chains are short.

Passes over the vocabulary grow with the number of groups, but a word is read in those of its
own length and one more or less only.

Rules: a null text has no words; a null ``doc_id`` hashes as an empty one; repeated rows count
each; ties between forms go to the smaller word in code-point order.  An empty table or one
without words gives an empty result.  Words may be of any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common

#: Characters of the words of one trie, bytes of the tries of one broadcast, words of one task.
SHARD_CHARS, GROUP_BYTES, TASK_WORDS = 1 << 20, 32 << 20, 4000
#: Distinct words, and their characters, that a task holds before it hands on their counts.
HELD_WORDS, HELD_CHARS = 200_000, 8 << 20
#: Words of more characters are walked with sets of states.
LONG = 64
RUN = re.compile("[a-zÀ-ÿ]+")
_TO_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def variant(doc_id: int | None, run: str, every: int) -> str:
    """The lower-cased run, without one code point where ``every`` divides its hash."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    at = h % len(run)
    return run if h % every else run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, every: int = 97, least_chars: int = 5) -> DataFrame:
    """(word, n) of all words of at least ``least_chars`` code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

        for batch in batches:
            for doc, data in zip(batch.column("doc_id").to_pylist(), common.texts_of(batch), strict=True):
                for word, n in Counter(RUN.findall(data.translate(_TO_LOWER).decode())).items():
                    if len(word) >= least_chars and len(word := variant(doc, word, every)) >= least_chars:
                        if word not in held:
                            size += len(word)
                        held[word] += n
                if len(held) > HELD_WORDS or size > HELD_CHARS:
                    yield out()
                    held.clear()
                    size = 0
        yield out()

    return common.keyed_texts(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Trie:
    """A compact trie of distinct words with their counts; node 0 is the root."""

    def __init__(self, labels: str, starts: bytes, counts: bytes):
        self.labels = labels
        self.starts = np.frombuffer(starts, np.int32).tolist()
        self.counts = np.frombuffer(counts, np.int64).tolist()

    @staticmethod
    def columns(words: dict[str, int]) -> tuple[str, bytes, bytes]:
        """Labels; where each node's children begin; each node's count, 0 where no word ends."""
        ordered = sorted(words)
        labels, starts, counts = ["\0"], [], []
        nodes = [(0, len(ordered), 0)]  # stretches of words alike in so many first characters
        for first, end, depth in nodes:
            starts.append(len(nodes))
            counts.append(0)
            if first < end and len(ordered[first]) == depth:
                counts[-1] = words[ordered[first]]
                first += 1
            while first < end:
                label, after = ordered[first][depth], first + 1
                while after < end and ordered[after][depth] == label:
                    after += 1
                nodes.append((first, after, depth + 1))
                labels.append(label)
                first = after
        starts.append(len(nodes))
        return "".join(labels), np.array(starts, np.int32).tobytes(), np.array(counts, np.int64).tobytes()

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """(other, count) of every word exactly one insertion, deletion or replacement away.

        A depth-first walk along the states of the word's automaton: the path on which no edit is
        used yet, and at each of its nodes the walks after one edit.  Those are followed at once, as a
        single state admits one label; words over ``LONG``, whose walks may overlap for long, are
        followed with sets of states."""
        if len(word) > LONG:
            yield from self._near_long(word)
            return
        starts, find, counts, size = self.starts, self.labels.find, self.counts, len(word)
        node, seen = 0, set()
        for depth in range(size + 1):
            first, end = starts[node], starts[node + 1]
            if depth < size:
                own, after = word[depth], word[depth + 1 : depth + 2]
                exact = find(own, first, end)
                v = node
                for label in word[depth + 1 :]:  # own is left out
                    v = find(label, starts[v], starts[v + 1])
                    if v < 0:
                        break
                else:
                    if counts[v] and v not in seen:
                        seen.add(v)
                        yield word[:depth] + word[depth + 1 :], counts[v]
                for child in range(first, end):
                    low, high = starts[child], starts[child + 1]
                    v = find(own, low, high)
                    if v >= 0:  # the child is inserted
                        for label in word[depth + 1 :]:
                            v = find(label, starts[v], starts[v + 1])
                            if v < 0:
                                break
                        else:
                            if counts[v] and v not in seen:
                                seen.add(v)
                                yield word[:depth] + self.labels[child] + word[depth:], counts[v]
                    if child == exact:
                        continue
                    if not after:
                        v = child
                    elif (v := find(after, low, high)) < 0:
                        continue
                    for label in word[depth + 2 :]:  # the child takes the place of own
                        v = find(label, starts[v], starts[v + 1])
                        if v < 0:
                            break
                    else:
                        if counts[v] and v not in seen:
                            seen.add(v)
                            yield word[:depth] + self.labels[child] + word[depth + 1 :], counts[v]
                if exact < 0:
                    return
                node = exact
            else:
                for child in range(first, end):
                    if counts[child] and child not in seen:
                        yield word + self.labels[child], counts[child]

    def _near_long(self, word: str) -> Iterator[tuple[str, int]]:
        """``near`` in time proportional to the word: states at a node are ``exact``, whether its
        path is the word's own beginning, and the positions in the word that one edit has led to."""
        labels, starts, counts, size = self.labels, self.starts, self.counts, len(word)
        path = [""] * (size + 1)
        stack: list[tuple[int, int, bool, tuple[int, ...]]] = [(0, 0, True, ())]
        while stack:
            node, depth, exact, edited = stack.pop()
            if depth:
                path[depth - 1] = labels[node]
            if counts[node] and (size in edited or (exact and depth == size - 1)):
                yield "".join(path[:depth]), counts[node]
            if depth > size:
                continue
            first, end = starts[node], starts[node + 1]
            if exact:
                own = word[depth] if depth < size else ""
                skipped = word[depth + 1] if depth + 1 < size else ""
                for child in range(first, end):
                    label = labels[child]
                    then = {p + 1 for p in edited if p < size and word[p] == label}
                    then.add(depth)  # inserted
                    if label == skipped:
                        then.add(depth + 2)  # the word's next is left out
                    if label != own and own:
                        then.add(depth + 1)  # replaced
                    stack.append((child, depth + 1, label == own, tuple(then)))
            else:
                for label in {word[p] for p in edited if p < size}:
                    child = labels.find(label, first, end)
                    if child >= 0:
                        stack.append((child, depth + 1, False, tuple(p + 1 for p in edited if p < size and word[p] == label)))


SHARD = "least int, most int, bytes long, labels string, starts binary, counts binary"


def shards(words: DataFrame, parts: int) -> DataFrame:
    """Tries over (word, n, length), each of words of neighbouring lengths: ``SHARD``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        size = 0

        def out() -> pa.RecordBatch:
            made = Trie.columns(held)
            lengths = [len(w) for w in held]
            row = (min(lengths), max(lengths), len(made[0]) * 4 + len(made[1]) + len(made[2]), *made)
            types = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["least", "most", "bytes", "labels", "starts", "counts"])

        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                held[word] = n
                size += len(word)
                if size >= SHARD_CHARS:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    ordered = words.repartitionByRange(parts, "length", "word").sortWithinPartitions("length", "word").select("word", "n")
    return ordered.mapInArrow(run, SHARD)


def _groups(sizes: list[tuple[int, int]]) -> list[list[int]]:
    """Ids of (id, bytes) in groups of at most ``GROUP_BYTES``; a larger shard is one alone."""
    out: list[list[int]] = []
    room = 0
    for i, size in sizes:
        if size > room:
            out.append([])
            room = GROUP_BYTES
        out[-1].append(i)
        room -= size
    return out


def neighbours(words: DataFrame, total: int) -> DataFrame:
    """(word, n_near, near_n, near) of the ``total`` words (word, n, length) that have near words:
    their number and the most frequent one, the smaller of equals."""
    spark = words.sparkSession
    parts = -(-total // TASK_WORDS)
    tries = common.written(shards(words, -(-total // 100_000)).withColumn("id", F.monotonically_increasing_id()), "tries")
    path = common.scratch_path(spark, "near-words")
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])
    # One row for each shard of a million characters, without its trie.
    sizes = tries.select("id", "bytes").orderBy("least", "most", "id").collect()
    for group in _groups([(r.id, r.bytes) for r in sizes]):
        rows = tries.where(F.col("id").isin(group)).collect()  # at most GROUP_BYTES
        least, most = min(r.least for r in rows), max(r.most for r in rows)
        sent = spark.sparkContext.broadcast([(r.least, r.most, r.labels, bytes(r.starts), bytes(r.counts)) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held = [(a, b, Trie(*columns)) for a, b, *columns in sent.value]
            for batch in batches:
                found = []
                for word in batch.column("word").to_pylist():
                    n = best = 0
                    form = ""
                    for a, b, trie in held:
                        if a - 1 <= len(word) <= b + 1:
                            for other, count in trie.near(word):
                                n += 1
                                if count > best or (count == best and other < form):
                                    best, form = count, other
                    if n:
                        found.append((word, n, best, form))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], schema.types[i]) for i in range(4)], schema=schema)

        here = words.where(F.col("length").between(least - 1, most + 1)).select("word").repartition(parts, "word")
        here.mapInArrow(run, "word string, n_near long, near_n long, near string").write.mode("append").parquet(path)
        sent.destroy()
    found = spark.read.schema("word string, n_near long, near_n long, near string").parquet(path)
    reduced = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("x"))
    return reduced.select("word", "n_near", (-F.col("x.least")).alias("near_n"), F.col("x.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every (word, form): forms are followed to the last."""
    at = common.scratch_path(forms.sparkSession, "roots")
    current = common.written_at(forms.select("word", F.col("form").alias("root")), at)
    while True:
        ahead = current.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        moved = current.join(ahead, F.col("root") == F.col("_w"), "left")
        before, at = at, common.scratch_path(forms.sparkSession, "roots")
        current = common.written_at(moved.select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), at)
        common.discard(forms.sparkSession, before)
        if current.where("moved").isEmpty():
            return current.select("word", "root")


def variants(docs: DataFrame, every: int = 97, least_chars: int = 5, least_count: int = 3, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least ``least_chars`` code
    points and ``least_count`` occurrences.  ``form`` is its most frequent near word if that
    occurs ``times`` as often or more; ``root`` the last form, the word itself without one."""
    counted = word_counts(docs, every, least_chars).where(F.col("n") >= least_count)
    words = common.written(counted.withColumn("length", F.length("word")), "words")
    total = words.count()
    if not total:
        return words.select("word", F.lit("").alias("form"), F.lit("").alias("root"), "n", F.col("n").alias("n_near"), F.col("n").alias("form_n"))
    near = words.join(neighbours(words, total), "word", "left")
    formed = F.col("near_n") >= times * F.col("n")
    named = near.select("word", F.when(formed, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("near_n")).alias("form_n"))
    named = common.written(named, "forms")
    last = roots(named.where("form is not null"))
    return named.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
