"""Toxicity by weak supervision.

Many voters vote toxic, clean or nothing: fixed lexicons, lexicons mined from the
labelled sample, counts of what these hold, and surface patterns.  A mined lexicon gathers words and stems that
stand in the same texts, so that what goes together is one voter.  A generative model,
which never sees the given labels, estimates by expectation-maximisation how each
voter votes given the hidden class and how far voters err together; correlated voters
share their weight.  It starts from the vote of the voters.  A linear classifier on the
voters and the mined features is trained on the model's posterior and scores every text.

Rules: a null text counts as empty, and the bias alone scores it; label rows with a null
in ``doc_id`` or ``toxic`` are ignored, of repeated ones the greatest holds; with
no usable label the fixed lexicons alone decide.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common
from larkspur.llm.covering import shingle_hashes
from larkspur.llm.decontaminate import words_of as ascii_words

#: The most labelled rows that are used for fitting; they are the first by a hash of the id.
MAX_LABELLED = 16_000
FEATURES = 4_096
#: A mined feature stands in so many of the rows at least, has so large a log-likelihood
#: ratio, and to count as a voter's such a share of toxic rows.
LEAST_DOCS, LEAST_PART = 4, 1 / 1000
LEAST_RATIO, LEAST_SHARE = 15.0, 0.75
REMEMBERED = 300_000
STEMS = (4, 5, 6)
#: How many lexicons the mined features form, and what share of a feature's texts a lexicon's
#: first feature must stand in to take it up.
LEXICONS, TOGETHER = 12, 0.5
#: Finding so many of the features that speak for toxic is a voter of its own.
SEVERAL = (2, 4)

#: Fixed word lists, each one voter.
INSULTS_EN = "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb imbecile retard bastard bitch whore slut asshole fuck shit filth vermin".split()
INSULTS_OTHER = "dummkopf arschloch schwein scheisse idiot trottel connard salope merde imbécile crétin abruti idiota estúpido estúpida imbécil puta mierda cabrón".split()


def words_of(text: bytes) -> set[bytes]:
    return set(ascii_words(text.decode().lower().encode()))


def features_of(word: bytes) -> list[bytes]:
    """A word and its stems, by which one looks it up."""
    return [word, *(b"^" + word[:n] for n in STEMS if len(word) > n)]


def patterns(text: bytes, words: set[bytes]) -> list[int]:
    """Votes of the surface patterns."""
    n = max(1, len(text))
    upper = sum(text.count(bytes([c])) for c in b"EAITONSR")
    lower = sum(text.count(bytes([c])) for c in b"eaitonsr")
    return [int(upper > 2 * lower and n > 20), int(text.count(b"!") * 25 > n), int(bool(words & {b"you", b"your", b"du", b"tu", b"vous", b"usted"}) and text.count(b"!") > 0)]


PATTERNS = 3


@dataclass
class Model:
    vocabulary: dict[bytes, int]  # mined features
    weights: np.ndarray  # of the features, then of the voters
    bias: float
    lexicon: np.ndarray  # of each mined feature: its lexicon, -1 if it does not speak for toxic

    def __post_init__(self):
        self.memory: dict[bytes, tuple[int, ...]] = {}
        self.fixed = [frozenset(w.encode() for w in x) for x in (INSULTS_EN, INSULTS_OTHER)]

    @property
    def voters(self) -> int:
        return len(self.fixed) + PATTERNS + LEXICONS + len(SEVERAL) + 1

    def found(self, words: set[bytes]) -> set[int]:
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        out: set[int] = set()
        get, vocabulary = self.memory.get, self.vocabulary
        for w in words:
            hit = get(w)
            if hit is None:
                hit = self.memory[w] = tuple(vocabulary[f] for f in features_of(w) if f in vocabulary)
            if hit:
                out.update(hit)
        return out

    def plain_votes(self, text: bytes, words: set[bytes]) -> list[int]:
        """Those of the fixed lexicons and the surface patterns."""
        return [*(int(bool(words & x)) for x in self.fixed), *patterns(text, words)]

    def votes(self, plain: list[int], found: Iterable[int]) -> list[int]:
        """All votes (1: toxic, -1: clean, 0: none) from the plain ones and the features found."""
        mined, hits = [0] * LEXICONS, 0
        for i in found:
            if self.lexicon[i] >= 0:
                mined[self.lexicon[i]] = 1
                hits += 1
        return [*plain, *mined, *(int(hits >= n) for n in SEVERAL), 0 if hits or any(plain) else -1]


def train_split(doc_id: Column) -> Column:
    """True for rows from whose labels one may learn."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic, weight) of at most ``most`` labelled rows of the training part; rows
    that share their least hash of five words are likely copies and weigh one together,
    lest their words seem typical."""
    usable = labels.where("doc_id is not null and toxic is not null").where(train_split(F.col("doc_id")))
    chosen = usable.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = common.keyed_texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic")
    schema = pa.schema([("least", pa.int64()), ("text", pa.binary()), ("toxic", pa.int32())])

    def least_shingle(batch: pa.RecordBatch) -> dict[str, object]:
        common.drop_worker_cache()
        least = [shingle_hashes(t, 5).min(initial=(1 << 64) - 1) for t in batch.column("text").to_pylist()]
        return {"least": np.array(least, np.uint64).view(np.int64)} | {c: batch.column(c) for c in ("text", "toxic")}

    marked = common.written(rows.mapInArrow(common.map_columns(least_shingle, schema), "least long, text binary, toxic int"), "labelled")
    sizes = marked.groupBy("least").agg((F.lit(1.0) / F.count("*")).alias("weight"))
    return marked.join(F.broadcast(sizes), "least").select("text", "toxic", "weight")


def mine(sample: DataFrame, features: int = FEATURES) -> tuple[dict[bytes, int], np.ndarray]:
    """The features most associated with the label by likelihood ratio, and whether
    each speaks for toxic."""
    schema = pa.schema([("feature", pa.binary()), ("n", pa.float64()), ("toxic", pa.float64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.drop_worker_cache()
        every: dict[bytes, float] = defaultdict(float)
        toxic: dict[bytes, float] = defaultdict(float)
        for batch in batches:
            for text, y, weight in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "weight")), strict=True):
                for f in {f for w in words_of(text) for f in features_of(w)}:
                    every[f] += weight
                    if y > 0:
                        toxic[f] += weight
        keys = list(every)
        for i in range(0, len(keys), 20_000):
            part = keys[i : i + 20_000]
            yield pa.RecordBatch.from_pydict({"feature": part, "n": [every[k] for k in part], "toxic": [toxic.get(k, 0.0) for k in part]}, schema=schema)

    total = sample.agg(F.sum("weight").alias("n"), F.sum(F.when(F.col("toxic") > 0, F.col("weight")).otherwise(0.0)).alias("t")).first()
    n, t = float(total.n or 0), float(total.t or 0)
    if not 0 < t < n:
        return {}, np.zeros(0, bool)
    counted = sample.mapInArrow(count, "feature binary, n double, toxic double").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where(F.col("n") > max(LEAST_DOCS, n * LEAST_PART) - 1e-6)

    def part(observed: Column, expected: Column) -> Column:
        return F.when(observed > 1e-6, observed * F.log(observed / expected)).otherwise(0.0)

    share = t / n
    a, b = F.col("toxic"), F.greatest(F.col("n") - F.col("toxic"), F.lit(0.0))
    c, d = F.greatest(F.lit(t) - a, F.lit(0.0)), F.greatest(F.lit(n - t) - b, F.lit(0.0))
    rest = F.greatest(F.lit(n) - F.col("n"), F.lit(1e-9))
    score = F.round(part(a, F.col("n") * share) + part(b, F.col("n") * (1 - share)) + part(c, rest * share) + part(d, rest * (1 - share)), 6)
    rows = counted.select("feature", score.alias("score"), (a > F.col("n") * max(LEAST_SHARE, share)).alias("strong")).where(F.col("score") >= LEAST_RATIO).orderBy(F.desc("score"), "feature").limit(features).collect()
    return {bytes(r.feature): i for i, r in enumerate(rows)}, np.array([r.strong for r in rows], bool)


def lexicons(found: list[list[int]], strong: np.ndarray) -> np.ndarray:
    """The lexicon of every strong feature (-1: not strong), from the features that each
    row of the sample holds.  Features come in order of their score; one joins the first
    lexicon whose own first feature stands in ``TOGETHER`` of its rows, else founds one; when
    all are founded, it joins the one it shares most rows with."""
    rows_of: dict[int, set[int]] = {int(i): set() for i in np.flatnonzero(strong)}
    for r, hits in enumerate(found):
        for i in hits:
            if i in rows_of:
                rows_of[i].add(r)
    out = np.full(len(strong), -1, np.int64)
    heads: list[set[int]] = []
    for i in sorted(rows_of):
        shared = [len(rows_of[i] & h) for h in heads]
        best = int(np.argmax(shared)) if shared else 0
        if len(heads) < LEXICONS and (not shared or shared[best] < TOGETHER * len(rows_of[i])):
            best = len(heads)
            heads.append(rows_of[i])
        out[i] = best
    return out


def label_model(votes: np.ndarray, rows: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Posterior of the hidden class from votes (rows x voters, -1, 0, 1) of rows that weigh
    ``rows``: each voter's vote probabilities given the class, and a weight 1 / (1 + its
    summed positive correlation with the other voters' errors given the class).  It starts
    from the sum of the votes."""
    p = np.where(votes.sum(1) > 0, 0.9, 0.1)
    kinds = [(votes == k).astype(float) for k in (-1, 0, 1)]
    weight = np.ones(votes.shape[1])
    for _ in range(rounds):
        toxic, clean = p * rows, (1 - p) * rows
        mass = np.array([clean.sum(), toxic.sum()]) + 1e-9
        given = [np.stack([(clean @ k + 0.1) / (mass[0] + 0.3), (toxic @ k + 0.1) / (mass[1] + 0.3)]) for k in kinds]
        ratio = sum(k * np.log(g[1] / g[0]) for k, g in zip(kinds, given, strict=True))
        # What is left of each vote when the class is known, and how it goes together.
        expected = np.outer(p, given[2][1] - given[0][1]) + np.outer(1 - p, given[2][0] - given[0][0])
        left = (votes - expected) * np.sqrt(rows)[:, None]
        size = np.sqrt((left**2).mean(0)) + 1e-9
        together = np.clip((left.T @ left) / len(left) / np.outer(size, size), 0, 1)
        np.fill_diagonal(together, 0)
        weight = 1 / (1 + together.sum(1))
        p = 1 / (1 + np.exp(-np.clip(ratio @ weight + np.log(mass[1] / mass[0]), -30, 30)))
    return p


def linear(rows: list[np.ndarray], target: np.ndarray, weights: np.ndarray, size: int, rounds: int = 300, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of features of weighted rows by Nesterov's gradient steps."""
    weights = weights / weights.mean()
    sizes = np.array([len(r) for r in rows])
    index, row = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(len(rows)), sizes)
    w = prev = np.zeros(size + 1)
    rate = 4.0 / (1 + np.mean(sizes))
    for k in range(rounds):
        at = w + k / (k + 3) * (w - prev)
        z = np.bincount(row, at[index], len(rows)) + at[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weights
        gradient = np.append(np.bincount(index, error[row], size), error.sum()) / len(rows)
        gradient[:-1] += ridge * at[:-1]
        prev, w = w, at - rate * gradient
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, features: int = FEATURES) -> Model:
    """What reaches the driver is ``features`` rows, and per labelled row, of which there
    are ``most`` at most, its votes and feature numbers."""
    sample = labelled(docs, labels, most)
    vocabulary, strong = mine(sample, features)
    model = Model(vocabulary, np.zeros(0), 0.0, np.full(len(vocabulary), -1, np.int64))
    if not vocabulary:
        weights = np.zeros(model.voters)
        weights[:2], weights[-1] = 6.0, -1.0
        return Model({}, weights, -2.0, model.lexicon)
    schema = pa.schema([("weight", pa.float64()), ("found", pa.list_(pa.int64())), ("plain", pa.list_(pa.int64()))])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.drop_worker_cache()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            words = [words_of(t) for t in texts]
            plain = [model.plain_votes(t, w) for t, w in zip(texts, words, strict=True)]
            yield pa.RecordBatch.from_pydict({"weight": batch.column("weight"), "found": [sorted(model.found(w)) for w in words], "plain": plain}, schema=schema)

    rows = sample.mapInArrow(look, "weight double, found array<long>, plain array<long>").collect()
    model.lexicon = lexicons([r.found for r in rows], strong)
    votes = np.array([model.votes(r.plain, r.found) for r in rows], np.int64)
    weight = np.array([r.weight for r in rows])
    posterior = label_model(votes, weight)
    size = len(vocabulary)
    sets = [np.array([*r.found, *(size + np.flatnonzero(v))], np.int64) for r, v in zip(rows, votes, strict=True)]
    weights, bias = linear(sets, posterior, weight, size + model.voters)
    return Model(vocabulary, weights, bias, model.lexicon)


def scores(docs: DataFrame, labels: DataFrame, keep: list[str] = (), most: int = MAX_LABELLED, features: int = FEATURES) -> DataFrame:
    """(doc_id, score, the columns named in ``keep`` as ``_<name>``) for every row."""
    model = fit(docs, labels, most, features)
    rows = common.texts_kept(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.drop_worker_cache()
        size = len(model.vocabulary)
        for batch in common.small_batches(batches, "text", 1 << 21):
            found = []
            for text in common.texts_of(batch):
                words = words_of(text)
                hits = model.found(words)
                votes = model.votes(model.plain_votes(text, words), hits)
                z = model.bias + sum(model.weights[i] for i in hits) + sum(model.weights[size + j] for j, v in enumerate(votes) if v)
                found.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            made = pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(found, pa.float64())})
            yield common.kept_columns(made, batch, keep)

    return rows.mapInArrow(run, "doc_id long, score double" + common.kept_ddl(rows, keep))
