"""Personal data: exact base patterns, and spans added by a trained character tagger.

The tagger (``tagger``) is trained on generated, labelled windows: the four kinds in
their base form and in forms the patterns miss (bracketed or bare "at" and "dot", phone
numbers without a plus sign, spaced addresses, dotted cards), among words and among
numbers that are none of these.  ``python -m larkspur.llm.pii`` trains it and writes
the weights beside this module.  A text is read in overlapping windows around every
character group that an added span must hold; scores of overlapping windows are
averaged with weights that fall towards the window's edge, and one Viterbi pass
decodes the whole region.  Of a region of over ``MOST`` characters, stretches of so many
are decoded with a margin, and a span belongs to the stretch in which it starts.  An
added span must pass its kind's check (digits, parts, Luhn) and must not touch a base span.

Rules: null text counts as empty; positions are code points, end exclusive; rows are
judged each, so null or repeated ``doc_id`` values need no care.
"""

from __future__ import annotations

import os
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common, tagger

#: The base patterns; quantifiers are possessive where giving back cannot help.
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What every added span holds: a digit, an at sign, a spelled "at" in brackets or before a
#: word with a dot, a spelled "dot".
TRIGGER = re.compile(r"[0-9@]+|[\[({<]\s?at\s?[\])}>]|\bat\s(?=\s?[\w-]+\s?\.\s?\w)|\bdot\b", re.IGNORECASE)

WINDOW, STEP, AROUND = 96, 48, 40
#: Of a word that the edge of a region cuts, so many more characters are read; so long may a
#: stretch of a region be, and so many characters are decoded together.
WORD, MOST, MARGIN, TOGETHER = 64, 1 << 15, 192, 1 << 15
WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "tagger_weights.npz")
EXAMPLES, SEED = 2400, 11


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _byte(part: str) -> bool:
    return len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), leftmost and non-overlapping within a kind, by start and kind."""
    out = []
    if "@" in text:
        end = 0
        at = text.find("@")
        while at >= 0:
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            m = AT_DOMAIN.match(text, at) if start < at else None
            if m:
                end = m.end()
                out.append((start, end, "email"))
            at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(map(_byte, m.group().split("."))):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], tagger.KINDS.index(s[2]), s[1]))


# Generated training windows -------------------------------------------------


def _word(r: random.Random) -> str:
    w = "".join(r.choice("etaoinshrdluéäçñcmfgbpvwy") for _ in range(r.randint(1, 9)))
    return r.choice([w, w, w, w.capitalize(), w.upper(), w + r.choice(",.!?;:%&$#*")])


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _card(r: random.Random) -> str:
    body = r.choice("3456") + _digits(r, r.choice([13, 14, 14, 14]))
    return next(body + c for c in "0123456789" if luhn(body + c))


def _name(r: random.Random) -> str:
    return "".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randint(2, 9)))


def _entity(r: random.Random) -> tuple[str, str]:
    kind = r.choice(tagger.KINDS)
    if kind == "email":
        local = _name(r) + r.choice(["", f".{_name(r)}", f".{_digits(r, 2)}", f"_{_name(r)}"])
        host = [r.choice(["mail", "post", "web"]) + r.choice(["", _digits(r, 1)]), "example", r.choice(["com", "org", "net", "de"])][r.randint(0, 1) :]
        at, dot = r.choice([("@", "."), ("@", "."), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " dot "), ("[at]", "[dot]"), (" at ", " dot "), (" at ", "."), (" AT ", " DOT "), (" (At) ", " Dot ")])
        return local + at + dot.join(host), kind
    if kind == "ip":
        parts = [str(r.randint(0, 255)) for _ in range(4)]
        return r.choice([".", ".", "[.]", " . "]).join(parts), kind
    if kind == "card":
        c = _card(r)
        four = [c[i : i + 4] for i in range(0, len(c), 4)]
        return r.choice([c, c, " ".join(four), "-".join(four), ".".join(four), "  ".join(four)]), kind
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return r.choice([f"+1 ({a}) {b}-{c}", f"+49 {a} {b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{_digits(r, 2)} {a} {b} {c}", f"{a}.{b}.{c}"]), "phone"


def _noise(r: random.Random) -> str:
    n = r.randint(1, 9)
    hexed = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 32, 40])))
    return r.choice([_digits(r, n), f'token = "{hexed}"', hexed, f"{_digits(r, 2)}.{_digits(r, 2)}", f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"v{_digits(r, 1)}.{_digits(r, 1)}.{_digits(r, 2)}", f"{_digits(r, 1)},{_digits(r, 3)},{_digits(r, 3)}", f"${_digits(r, 3)}.{_digits(r, 2)}", f"[{_digits(r, 2)}]", _digits(r, r.randint(17, 24)), f"{_digits(r, 2)}:{_digits(r, 2)}:{_digits(r, 2)}", f"@{_name(r)}", "at", "dot", f"({_name(r)})", f"section {_digits(r, 1)}.{_digits(r, 1)}.{_digits(r, 1)}", f"isbn {_digits(r, 13)}"])


def example(r: random.Random) -> tuple[str, np.ndarray]:
    """A window of text with its tags."""
    text, marks = "", []
    while len(text) < WINDOW + 30:
        x = r.random()
        if x < 0.22:
            value, kind = _entity(r)
            marks.append((len(text), len(text) + len(value), tagger.KINDS.index(kind)))
            text += value
        else:
            text += _noise(r) if x < 0.36 else _word(r)
        text += r.choice([" ", " ", " ", "\n", ", "])
    first = r.randint(0, 30)
    tags = np.zeros(len(text), np.int64)
    for a, b, k in marks:
        tags[a:b] = 2 + 2 * k
        if a >= first:
            tags[a] = 1 + 2 * k
        elif first < b:
            tags[first] = 1 + 2 * k
    return text[first : first + WINDOW], tags[first : first + WINDOW]


def train(seed: int = SEED, examples: int = EXAMPLES) -> dict[str, np.ndarray]:
    r = random.Random(seed)
    texts, tags = zip(*(example(r) for _ in range(examples)), strict=True)
    return tagger.train(np.stack([tagger.symbols(t) for t in texts]), np.stack(tags), seed)


@lru_cache(maxsize=1)
def trained() -> dict[str, np.ndarray]:
    """The weights that ``train`` gave; the driver reads them and ships them to the tasks."""
    with np.load(WEIGHTS) as stored:
        return {k: stored[k] for k in stored.files}


# Reading --------------------------------------------------------------------


def regions(text: str) -> list[tuple[int, int]]:
    """Merged stretches of text around every trigger, to the ends of words."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        if out and m.end() <= out[-1][1] - AROUND:
            continue
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        least, most = max(0, a - WORD), min(len(text), b + WORD)
        while a > least and not text[a - 1].isspace():
            a -= 1
        while b < most and not text[b].isspace():
            b += 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def stretches(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(from, to, first, last): what to decode, and where the spans that count start."""
    for a, b in regions(text):
        for x in range(a, b, MOST):
            y = min(x + MOST, b)
            yield max(a, x - MARGIN) if x > a else a, min(b, y + MARGIN), x, y


def _plausible(kind: str, value: str) -> bool:
    digits = re.sub("[^0-9]", "", value)
    if kind == "email":
        return re.fullmatch(r"[\w.%+-]+\s?(?:@|[\[({<]\s?at\s?[\])}>]|\sat\s)\s?[\w-]+(?:\s?(?:\.|[\[({<]?\s?\bdot\b\s?[\])}>]?)\s?[\w-]+)+", value, re.IGNORECASE) is not None
    if kind == "ip":
        parts = re.split(r"\s?\[?\.\]?\s?", value)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and _byte(p) for p in parts)
    if kind == "card":
        return re.fullmatch("[0-9 .-]+", value) is not None and 14 <= len(digits) <= 19 and luhn(digits)
    return re.fullmatch(r"[0-9 ().+-]+", value) is not None and 10 <= len(digits) <= 15 and re.search(r"[0-9][ ().-]+[0-9]", value) is not None and re.fullmatch(r"[0-9]+(?:\.[0-9]+)?", value) is None and re.search(r"[0-9]{9}", value) is None


def _tagged(pieces: list[str], model: dict[str, np.ndarray]) -> list[list[tuple[int, int, str]]]:
    """The tagger's spans of some pieces of text."""
    codes = [tagger.symbols(t) for t in pieces]
    windows = [(k, o) for k, c in enumerate(codes) for o in range(0, max(1, len(c) - WINDOW + STEP), STEP)]
    scores = [np.zeros((len(c), tagger.TAGS)) for c in codes]
    weights = [np.zeros((len(c), 1)) for c in codes]
    hat = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(float)[:, None]
    for i in range(0, len(windows), 512):
        part = windows[i : i + 512]
        ids = np.full((len(part), WINDOW), tagger.PAD)
        for row, (k, o) in zip(ids, part, strict=True):
            c = codes[k][o : o + WINDOW]
            row[: len(c)] = c
        for e, (k, o) in zip(tagger.emissions(model, ids), part, strict=True):
            n = min(WINDOW, len(codes[k]) - o)
            scores[k][o : o + n] += e[:n] * hat[:n]
            weights[k][o : o + n] += hat[:n]
    return [tagger.spans(tagger.viterbi(s / w, model["trans"])) for s, w in zip(scores, weights, strict=True)]


def added_spans(texts: list[str], model: dict[str, np.ndarray], base: list[list[tuple[int, int, str]]]) -> list[list[tuple[int, int, str]]]:
    """Spans that the tagger adds to the base spans of each text."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    held: list[tuple[int, int, int, int, int]] = []

    def decode() -> None:
        for (i, a, _, first, last), found in zip(held, _tagged([texts[i][a:b] for i, a, b, _, _ in held], model), strict=True):
            for x, y, kind in found:
                if not first <= a + x < last:
                    continue
                value = texts[i][a + x : a + y]
                start = a + x + len(value) - len(value.lstrip())
                value = value.strip().rstrip(".,;:!?")
                end = start + len(value)
                if _plausible(kind, value) and not any(start < e and s < end for s, e, _ in base[i]):
                    # Not a part of a longer number or word.
                    before, after = texts[i][start - 1 : start] if start else "", texts[i][end : end + 1]
                    if not (before.isalnum() or before in ("+", "@")) and not after.isalnum():
                        out[i].append((start, end, kind))
        held.clear()

    size = 0
    for i, text in enumerate(texts):
        for piece in stretches(text):
            held.append((i, *piece))
            size += piece[1] - piece[0]
            if size > TOGETHER:
                decode()
                size = 0
    decode()
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], tagger.KINDS.index(s[2]), s[1]))


def find(texts: list[str], model: dict[str, np.ndarray]) -> tuple[list, list]:
    """Base spans, and all spans, of each text."""
    base = [base_spans(t) for t in texts]
    more = added_spans(texts, model, base)
    return base, [_ordered(b + a) for b, a in zip(base, more, strict=True)]


def _found(docs: DataFrame, keep: list[str], mask: bool) -> DataFrame:
    """(doc_id, base, spans: arrays of start, end, kind; the columns named in ``keep`` as
    ``_<name>``); with ``mask`` the text is kept with its spans masked."""
    model = trained()
    rows = common.texts_kept(docs, keep)
    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("kind", pa.string())]))
    kind = "array<struct<a: long, b: long, kind: string>>"
    schema, out = ([("doc_id", pa.int64())], "doc_id long") if mask else ([("doc_id", pa.int64()), ("base", span), ("spans", span)], f"doc_id long, base {kind}, spans {kind}")
    schema = pa.schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.drop_worker_cache()
        for batch in common.small_batches(batches, "text", 1 << 21):
            texts = [t.decode() for t in common.texts_of(batch)]
            base, spans = find(texts, model)
            made, text = {"doc_id": batch.column("doc_id")}, None
            if mask:
                new = pa.array([masked(t, s) if s else t for t, s in zip(texts, spans, strict=True)], pa.string())
                text = pc.if_else(batch.column("text").is_valid(), new, pa.scalar(None, pa.string()))
            else:
                as_rows = lambda x: [[{"a": a, "b": b, "kind": k} for a, b, k in s] for s in x]
                made |= {"base": as_rows(base), "spans": as_rows(spans)}
            yield common.kept_columns(pa.RecordBatch.from_pydict(made, schema=schema), batch, keep, text)

    return rows.mapInArrow(run, out + common.kept_ddl(rows, keep))


def spans_of(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(doc_id, base, spans: arrays of start, end, kind; the columns named in ``keep`` as ``_<name>``)."""
    return _found(docs, list(keep), False)


def masked_texts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(doc_id, the columns named in ``keep`` as ``_<name>``), every span of the text
    replaced by its kind; null texts stay null."""
    return _found(docs, list(keep), True)


def digests(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans of each row, and all its spans."""

    def text(name: str):
        return F.array_join(F.transform(name, lambda x: F.concat_ws(":", x["kind"], x["a"], x["b"])), ",")

    counts = [F.expr(f"size(filter(base, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in tagger.KINDS]
    return spans_of(docs).select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans as one."""
    out, at = [], 0
    for a, b, kind in spans:
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"<{kind.upper()}>" if a >= at else ""]
        at = b
    return "".join([*out, text[at:]])


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **train())
