"""Token counts from a tokenizer compiled to finite-state transducers.

Two layers are compiled from a byte-level BPE file.  The outer one divides text
into units - white space and the word after it - and units into pre-tokens.  The
inner one is a deterministic transducer over bytes: a state stands for a prefix
of a pre-token, remembers the last token of that prefix's encoding, and the
transition into it carries the change of the token count.  States are made when
first reached; which token ends a prefix follows from the state before that token,
as exactly one choice agrees with the merge order.

A text is cut into chunks of ``CHUNK`` characters at any place.  A chunk maps the
unit left open before it to the unit open behind it and the tokens emitted on the
way; such maps compose associatively and are joined by a parallel prefix scan, so
one very long text spreads over many tasks.  Chunks that lie inside one run without
white space are put together once, before the scan; pre-tokens of over ``LONG`` bytes
are walked by an automaton of all tokens that keeps only the states within a token's
length, so that a run needs memory in proportion to its length.

Rules: null text counts as empty; a row's identity is its place in the input, so
null or repeated ``doc_id`` values are counted each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common

CHUNK = 1 << 16
REMEMBERED, STATES = 400_000, 1_200_000
LONG = 1024  # longer pre-tokens and units are not remembered

#: White space of the pre-token pattern, and the pattern itself.
WIDE_SPACE = "\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = r"\t\n\x0b\x0c\r " + WIDE_SPACE
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

_plain_units = re.compile(rb"[\t\n\x0b\x0c\r ]*[^\t\n\x0b\x0c\r ]+|[\t\n\x0b\x0c\r ]+\Z").findall
_wide_units = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+\\Z").findall
_wide = re.compile(f"[{WIDE_SPACE}]").search


def byte_letters() -> dict[str, int]:
    """The printable letter by which a vocabulary file writes each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Transducer:
    """Counts of pre-tokens by a deterministic transducer over bytes, built lazily."""

    def __init__(self, merges: list[tuple[bytes, bytes]], vocabulary: set[bytes]):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.vocabulary = vocabulary
        self.longest = max(map(len, vocabulary), default=1)
        self.joins: dict[tuple[bytes, bytes], bool] = {}
        self.stable: dict[bytes, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.next: dict[int, int] = {}  # state * 256 + byte: following state
        self.count, self.last = [0], [b""]

    def encode(self, data: bytes) -> list[bytes]:
        """The merges in order of rank; used on one or two tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.rank.get((parts[i], parts[i + 1]), 1 << 60), i))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _fits(self, before: bytes, token: bytes) -> bool:
        if not before:
            if (known := self.stable.get(token)) is None:  # no more of them than tokens
                known = self.stable[token] = self.encode(token) == [token]
            return known
        pair = before, token
        if (known := self.joins.get(pair)) is None:
            if len(self.joins) > REMEMBERED:
                self.joins.clear()
            known = self.joins[pair] = self.encode(before + token) == [before, token]
        return known

    def run(self, word: bytes) -> int:
        """Emitted tokens of a whole pre-token."""
        if len(word) > LONG:
            return self._walk(word)
        if len(self.count) > STATES:
            self.reset()
        state, path = 0, [0]
        for i, byte in enumerate(word):
            follow = self.next.get(state << 8 | byte)
            if follow is None:
                follow = self._extend(state, path, word, i)
            state = follow
            path.append(state)
        return self.count[state]

    @cached_property
    def automaton(self):
        """Finds all tokens that end at a byte, the longest first."""
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for token in self.vocabulary:
            automaton.add_word(token.decode("latin-1"), token)
        automaton.make_automaton()
        return automaton

    def _walk(self, word: bytes) -> int:
        """``run`` without states: of each prefix, the last token and the count stay in
        reach for as many bytes as a token can have."""
        reach = self.longest + 1
        last, count = [b""] * reach, [0] * reach
        done = 0
        for end, token in self.automaton.iter(word.decode("latin-1")):
            if end < done:
                continue  # a longer token fitted
            if end > done:
                break
            origin = (end + 1 - len(token)) % reach
            if self._fits(last[origin], token):
                done = end + 1
                last[done % reach], count[done % reach] = token, count[origin] + 1
        if done < len(word):
            raise ValueError(f"no token ends at byte {done}")
        return count[done % reach]

    def _extend(self, state: int, path: list[int], word: bytes, i: int) -> int:
        for size in range(min(self.longest, i + 1), 0, -1):
            token = word[i + 1 - size : i + 1]
            if token in self.vocabulary:
                origin = path[i + 1 - size]
                if self._fits(self.last[origin], token):
                    break
        else:
            raise ValueError(f"no token ends {word[: i + 1]!r}")
        new = self.next[state << 8 | word[i]] = len(self.count)
        self.count.append(self.count[origin] + 1)
        self.last.append(token)
        return new


class _Memo(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) > REMEMBERED:
            self.clear()
        value = self.make(key)
        if len(key) <= LONG:
            self[key] = value
        return value


class Counter:
    """Counts of units, and chunk maps."""

    def __init__(self, path: str):
        import regex

        from tokenizers import Tokenizer

        spec = json.loads(Tokenizer.from_file(path).to_str())
        letters = byte_letters()
        to_bytes = lambda t: bytes(letters[c] for c in t)
        special = [t["content"] for t in spec["added_tokens"]]
        vocabulary = {to_bytes(t) for t in spec["model"]["vocab"] if t not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.transducer = Transducer([(to_bytes(a), to_bytes(b)) for a, b in pairs], vocabulary)
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.pre_tokens = regex.compile(PRE_TOKEN).findall
        self.words = _Memo(lambda w: self.transducer.run(w.encode()))
        self.unit = _Memo(self._unit).__getitem__

    def _unit(self, unit: bytes) -> int:
        text = unit.decode()
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.words[w] for part in parts for w in self.pre_tokens(part))

    def units(self, text: bytes) -> list[bytes]:
        if text.isascii() or not _wide(decoded := text.decode()):
            return _plain_units(text)
        return [u.encode() for u in _wide_units(decoded)]

    def count(self, text: bytes) -> int:
        return sum(map(self.unit, self.units(text)))

    def chunk(self, text: bytes) -> Map:
        return self._closed(self.units(text), 0, None)

    def _closed(self, units: list[bytes], more: int, tail: bytes | None) -> Map:
        """Map whose first unit is open to the left; with ``tail``, all units are closed to the right."""
        if not units:
            return (b"", more, tail)
        if tail is None:
            if len(units) == 1:
                return (units[0], 0, None)
            return (units[0], sum(map(self.unit, units[1:-1])), units[-1])
        return (units[0], sum(map(self.unit, units[1:])) + more, tail)

    def compose(self, a: Map, b: Map) -> Map:
        head, count, tail = a
        if tail is None:
            return self._closed(self.units(head + b[0]), b[1], b[2])
        units = self.units(tail + b[0])
        if b[2] is None:
            return (head, count + sum(map(self.unit, units[:-1])), units[-1] if units else b"")
        return (head, count + sum(map(self.unit, units)) + b[1], b[2])

    def joined(self, maps: list[Map]) -> list[Map]:
        """The maps with those inside one run put together with the next that ends it."""
        out, run = [], []
        for head, count, tail in maps:
            run.append(head)
            if tail is not None:
                out.append(self._closed(self.units(b"".join(run)), count, tail))
                run = []
        return out + [self.chunk(b"".join(run))] if run else out

    def prefix_scan(self, maps: list[Map]) -> list[Map]:
        """All prefixes, by doubling the distance over which maps are composed."""
        step = 1
        while step < len(maps):
            maps = maps[:step] + [self.compose(a, b) for a, b in zip(maps, maps[step:], strict=False)]
            step *= 2
        return maps

    def whole(self, m: Map) -> int:
        head, count, tail = m
        return count + sum(map(self.unit, self.units(head))) + sum(map(self.unit, self.units(tail or b"")))


#: (open unit at the start, tokens between, open unit at the end; None: one unit, open at both ends)
Map = tuple[bytes, int, bytes | None]


def counter(path: str) -> Counter:
    """One compiled tokenizer for a worker process, which Spark reuses for many tasks."""
    return common.worker_cache(("counts", path), lambda: Counter(path))


def token_counts(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    last = F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / chunk).cast("int")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"), last.alias("last"))
    one = F.when(F.col("last") == 0, F.col("text")).otherwise(F.substring(F.col("text"), F.col("no") * chunk + 1, F.lit(chunk)))
    chunks = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("no")).select("row", "doc_id", "n_bytes", "last", "no", one.cast("binary").alias("text"))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("no", pa.int32()), ("head", pa.binary()), ("n", pa.int64()), ("tail", pa.binary())])

    def to_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            maps = [(None, c.count(t), None) if last == 0 else c.chunk(t) for t, last in zip(batch.column("text").to_pylist(), batch.column("last").to_pylist(), strict=True)]
            head, n, tail = zip(*maps, strict=True) if maps else ((), (), ())
            yield pa.RecordBatch.from_pydict({x: batch.column(x) for x in ("row", "doc_id", "n_bytes", "no")} | {"head": head, "n": n, "tail": tail}, schema=schema)

    maps = chunks.mapInArrow(to_maps, "row long, doc_id long, n_bytes long, no int, head binary, n long, tail binary")
    by_row = maps.groupBy("row", "doc_id", "n_bytes").agg(F.array_sort(F.collect_list(F.struct("no", "head", "n", "tail"))).alias("maps"))
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            totals = []
            for found in batch.column("maps").to_pylist():
                if found[0]["head"] is None:
                    totals.append(found[0]["n"])
                else:
                    totals.append(c.whole(c.prefix_scan(c.joined([(x["head"], x["n"], x["tail"]) for x in found]))[-1]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_tokens": totals}, schema=out)

    return by_row.mapInArrow(join, "doc_id long, n_bytes long, n_tokens long")
