"""Exact token ids with the ``tokenizers`` library, which sees each new word once.

The vocabulary's pre-tokenizer drops white space and never joins across it, so
the ids of a text are those of its words between ASCII white space, in turn.
A worker keeps the ids of the words it has met; only new ones go to the library.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from larkspur.llm import common


REMEMBERED = 800_000
#: ASCII punctuation but the apostrophe, which starts contractions.
PUNCTUATION = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
PIECES = re.compile(r"[^\W\d_]+|[!-&(-/:-@\[-`{-~]+")
#: The common shape of a word: letters of Latin-1, then perhaps such punctuation.
SHAPE = re.compile(r"([a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Numbering(dict):
    """Numbers words in order of first use and lists the new ones."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


def _grown(x: np.ndarray, size: int) -> np.ndarray:
    return x if size <= len(x) else np.concatenate([x, np.zeros(max(size, 2 * len(x)) - len(x), x.dtype)])


class WordEncoder:
    """Ids of whole texts as uint32 arrays; about ``limit`` words are remembered."""

    JOINED = 128
    SPECIAL = b"<|"

    def __init__(self, path: str, limit: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        vocab = self.tokenizer.get_vocab()
        model = json.loads(self.tokenizer.to_str())["model"]
        suffix = model.get("end_of_word_suffix")
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends_word[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.numbers = _Numbering()
        self.pieces: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.piece_starts, self.piece_counts = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.starts, self.counts = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.known = self.used = 0

    def _plain(self, word: str) -> bool:
        """One run of letters that stays one run when normalised."""
        return word.isalpha() and max(word) < "ɐ" and "İ" not in word

    def _cut(self, word: str) -> list[str]:
        """A word as pieces that the pre-tokenizer separates in any case: runs of plain
        letters and of ASCII punctuation without apostrophes; else the word as it is."""
        if self._plain(word) or "<|" in word:
            return [word]
        parts = PIECES.findall(word)
        if len(parts) > 1 and sum(map(len, parts)) == len(word) and all(p[0] in PUNCTUATION or self._plain(p) for p in parts):
            return parts
        return [word]

    def _cut_all(self, words: list[str]) -> tuple[list[str], list[int]]:
        """The pieces of all words in turn, and how many each has."""
        pieces: list[str] = []
        sizes: list[int] = []
        shape = SHAPE.fullmatch
        for w in words:
            if m := shape(w):
                core, tail = m.groups()
                pieces.append(core)
                if tail:
                    pieces.append(tail)
                    sizes.append(2)
                else:
                    sizes.append(1)
            else:
                parts = self._cut(w)
                pieces += parts
                sizes.append(len(parts))
        return pieces, sizes

    def _learn_pieces(self, new: list[str]) -> None:
        """Ask the library for pieces: plain ones many at a time, as each ends with its
        only end-of-word id, the others one by one."""
        plain = [i for i, w in enumerate(new) if self._plain(w)]
        groups = [plain[i : i + self.JOINED] for i in range(0, len(plain), self.JOINED)]
        taken: set[int] = set()
        parts: list[np.ndarray] = []
        order: list[int] = []
        sizes: list[np.ndarray] = []
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join([new[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):
                parts.append(ids)
                sizes.append(np.diff(ends, prepend=0))
                order += group
                taken.update(group)
        rest = [i for i in range(len(new)) if i not in taken]
        for i, found in zip(rest, self.tokenizer.encode_batch_fast([new[i] for i in rest], add_special_tokens=False), strict=True):
            parts.append(np.array(found.ids, np.uint32))
            sizes.append(np.array([len(found.ids)]))
            order.append(i)
        flat, counts = np.concatenate(parts), np.concatenate(sizes)
        before = len(self.pieces)
        self.pieces.update(zip(new, range(before, before + len(new)), strict=True))
        m = len(self.pieces)
        self.piece_starts, self.piece_counts, self.ids = _grown(self.piece_starts, m), _grown(self.piece_counts, m), _grown(self.ids, self.used + len(flat))
        at = before + np.array(order)
        self.piece_counts[at] = counts
        self.piece_starts[at] = self.used + np.cumsum(counts) - counts
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def learn(self) -> None:
        """Take up the new words.  A word of one piece shares the piece's ids; one of
        several pieces gets a run of its own."""
        pieces, counted = self._cut_all(b"\n".join(self.numbers.new).decode().split("\n"))
        self.numbers.new.clear()
        known = self.pieces
        if new := list(dict.fromkeys([p for p in pieces if p not in known])):
            self._learn_pieces(new)
        sizes = np.array(counted, np.int64)
        no = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        first = np.cumsum(sizes) - sizes
        counts = np.add.reduceat(self.piece_counts[no], first)
        m = self.known + len(sizes)
        self.starts, self.counts = _grown(self.starts, m), _grown(self.counts, m)
        self.counts[self.known : m] = counts
        starts = self.piece_starts[no[first]]
        many = np.repeat(sizes > 1, sizes)
        part_counts = self.piece_counts[no[many]]
        total = int(part_counts.sum())
        self.ids = _grown(self.ids, self.used + total)
        ends = np.cumsum(part_counts)
        self.ids[self.used : self.used + total] = self.ids[np.repeat(self.piece_starts[no[many]] - (ends - part_counts), part_counts) + np.arange(total)]
        own = np.cumsum(counts[sizes > 1])
        starts[sizes > 1] = self.used + own - counts[sizes > 1]
        self.starts[self.known : m] = starts
        self.used += total
        self.known = m

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn, and how many belong to each text."""
        if self.known > self.limit:
            self.forget()
        lower = [t if self.SPECIAL in t else t.lower() for t in texts]  # ASCII letters; the normaliser does the same
        split = pc.ascii_split_whitespace(pa.array(lower, pa.large_string()))
        words = split.flatten().dictionary_encode()  # Arrow hashes every word, the numbering sees each once a batch
        distinct = np.fromiter(map(self.numbers.__getitem__, words.dictionary.cast(pa.large_binary()).to_pylist()), np.int64, len(words.dictionary))
        no = distinct[words.indices.to_numpy()]
        if self.numbers.new:
            self.learn()
        counts = self.counts[no]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.starts[no] - (ends - counts), counts) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy()]
        return ids, np.diff(bounds)


def word_encoder(path: str, limit: int) -> WordEncoder:
    """One encoder for a worker process, which Spark reuses for many tasks."""
    return common.worker_cache(("words", path, limit), lambda: WordEncoder(path, limit))


def encode_with_end(path: str, texts: list[bytes], end_id: int, remembered: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``encode``, with ``end_id`` after each text."""
    ids, counts = word_encoder(path, remembered).encode(texts)
    out = np.full(len(ids) + len(texts), end_id, np.uint32)
    mask = np.ones(len(out), bool)
    mask[np.cumsum(counts) + np.arange(len(texts))] = False
    out[mask] = ids
    return out, counts + 1


def packed(ids: np.ndarray) -> bytes:
    """Ids as compressed little-endian integers of 2 bytes, or 4 where needed."""
    import zstandard

    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    return (b"4" if wide else b"2") + zstandard.compress(ids.astype("<u4" if wide else "<u2"), 1)


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(data[1:]), f"<u{data[:1].decode()}").astype(np.uint32)


def id_table(docs, path: str, end_id: int, remembered: int = REMEMBERED):
    """(doc_id, n_tokens, ids) of every text, in the shared folder; ids are ``packed``.
    A worker remembers ``remembered`` words, some 300 bytes each."""



    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def columns(batch):
        ids, counts = encode_with_end(path, batch.column("text").to_pylist(), end_id, remembered)
        ends = np.cumsum(counts)
        return {"doc_id": batch.column("doc_id"), "n_tokens": counts, "ids": [packed(ids[e - n : e]) for e, n in zip(ends, counts, strict=True)]}

    encoded = common.keyed_texts(docs).mapInArrow(common.map_columns(columns, schema, limit=1 << (23 if remembered >= REMEMBERED else 21)), "doc_id long, n_tokens long, ids binary")
    return common.written(encoded, "ids", "none")
