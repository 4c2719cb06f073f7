"""Rolling hashes, and the division of texts into stretches of windows with one least hash."""

from __future__ import annotations

import numpy as np

MOST_WINDOWS = 4096  # of a stretch; longer ones are cut
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, (2, 256), dtype=np.uint64)[0]
_FACTOR = 0x9E3779B97F4A7C15


def rolled(power: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit sum of the ``size`` values from every place (``size`` any positive number)."""
    n = len(power) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    done, out = 0, None
    factor, width = _FACTOR, 1
    rest = size
    while rest:
        if rest & 1:
            out = power[:n].copy() if out is None else out * np.uint64(factor) + power[done : done + n]
            done += width
        rest >>= 1
        if rest:
            power = power[: len(power) - width] * np.uint64(factor) + power[width:]
            factor, width = factor * factor % (1 << 64), width * 2
    return out


def mixed(out: np.ndarray) -> np.ndarray:
    """The sums with their bits spread, in place."""
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def window_minima(x: np.ndarray, size: int) -> np.ndarray:
    """Least of every ``size`` neighbours, by doubling."""
    width = 1
    while width * 2 <= size:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (size - width)], x[size - width :]) if width < size else x


def stretches_of(data: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, length: int, gram: int, repeats: bool = True) -> dict[str, np.ndarray]:
    """All stretches of some texts, which are ``sizes`` members of ``data`` each (bytes or hashes of words);
    ``hashes`` of ``gram`` members from every place: text number, start, windows, anchor, content and, if
    asked for, repeats."""
    from xxhash import xxh3_64_intdigest

    ends = np.cumsum(sizes)
    empty = np.empty(0, np.int64)
    if len(data) < length:
        return {"text": empty, "start": empty, "windows": empty, "anchor": empty, "content": empty, "repeats": empty.astype(bool)}
    joined, each = memoryview(data).cast("B"), data.itemsize
    least = window_minima(hashes, length - gram + 1)
    of_text = np.repeat(np.arange(len(sizes)), sizes)
    valid = np.arange(len(least)) + length <= ends[of_text[: len(least)]]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (of_text[1 : len(least)] != of_text[: len(least) - 1]) | ~valid[:-1]
    begin = np.flatnonzero(new & valid)
    stop = np.append(begin[1:], len(least))
    # A stretch ends where windows stop being valid.
    run_end = ends[of_text[begin]] - length + 1
    stop = np.minimum(stop, run_end)
    count = stop - begin
    pieces = -(-count // MOST_WINDOWS)
    if pieces.max(initial=1) > 1:
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(begin, pieces) + step * MOST_WINDOWS
        stop = np.minimum(np.repeat(stop, pieces), begin + MOST_WINDOWS)
        count = stop - begin
    anchor = least[begin]
    content = np.fromiter((xxh3_64_intdigest(joined[a * each : (b + length - 1) * each]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)), np.uint64, len(begin))
    text = of_text[begin]
    out = {"text": text, "start": begin - (ends - sizes)[text], "windows": count, "anchor": anchor.view(np.int64), "content": content.view(np.int64)}
    if not repeats:
        return out
    # Does the least hash stand twice in the members of the stretch?
    ids = np.flatnonzero(np.isin(hashes, anchor[count >= 1])) if len(begin) else empty
    first = np.searchsorted(ids, begin)
    last = np.searchsorted(ids, stop + length - gram)
    twice = np.zeros(len(begin), bool)
    for i in np.flatnonzero(last - first > 1):
        twice[i] = (hashes[ids[first[i] : last[i]]] == anchor[i]).sum() > 1
    return out | {"repeats": twice}


def runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Merged spans of windows that start at ``starts`` (ascending)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist(), strict=True))
