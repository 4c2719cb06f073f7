"""A character-level bidirectional LSTM with CRF transitions, trained in numpy.

Tags are, for each kind of personal data, B (first character) and I (a further
one), and O elsewhere.  Training maximises the conditional likelihood of tag
sequences by Adam; decoding is Viterbi.
"""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)
PAD, OTHER = 0, 127
SYMBOLS = 130
EMBED, HIDDEN = 12, 20


def symbols(text: str) -> np.ndarray:
    """Character classes: ASCII as it is, accented and other letters, everything else."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    out = np.where(codes < 127, codes, np.where(codes < 0x250, 128, OTHER))
    return np.where(out == 0, OTHER, out).astype(np.int64)


def allowed() -> np.ndarray:
    """Fixed part of the transitions: I only follows B or I of its kind."""
    bad = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        bad[:, inside] = -1e4
        bad[[1 + 2 * k, inside], inside] = 0
    return bad


BLOCKED = allowed()
START = np.array([0.0 if t == 0 or t % 2 else -1e4 for t in range(TAGS)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def init(seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    p = {"embed": r.normal(0, 0.3, (SYMBOLS, EMBED)), "out": r.normal(0, 0.2, (2 * HIDDEN, TAGS)), "bias": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS))}
    for d in "fb":
        p["w" + d] = r.normal(0, 1 / np.sqrt(EMBED + HIDDEN), (EMBED + HIDDEN, 4 * HIDDEN))
        p["c" + d] = np.zeros(4 * HIDDEN)
        p["c" + d][HIDDEN : 2 * HIDDEN] = 1.0
    return {k: v.astype(np.float32) for k, v in p.items()}


def _lstm(p: dict, d: str, x: np.ndarray, keep: bool = True) -> tuple[np.ndarray, list]:
    """x: (time, batch, embed) in the direction's own order."""
    steps, batch, _ = x.shape
    w, b = p["w" + d], p["c" + d]
    given = x @ w[:EMBED] + b
    h = c = np.zeros((batch, HIDDEN), np.float32)
    out, tape = np.empty((steps, batch, HIDDEN), np.float32), []
    for t in range(steps):
        z = given[t] + h @ w[EMBED:]
        s = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        if keep:
            tape.append((h, before, i, f, o, g, tc))
        h = o * tc
        out[t] = h
    return out, tape


def _lstm_back(p: dict, d: str, x: np.ndarray, tape: list, dout: np.ndarray, grads: dict) -> np.ndarray:
    steps, batch, _ = x.shape
    w = p["w" + d]
    dz_all = np.empty((steps, batch, 4 * HIDDEN), np.float32)
    dh = dc = np.zeros((batch, HIDDEN), np.float32)
    dw_h = np.zeros_like(w[EMBED:])
    for t in range(steps - 1, -1, -1):
        h, before, i, f, o, g, tc = tape[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc**2)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], 1)
        dz_all[t] = dz
        dw_h += h.T @ dz
        dh, dc = dz @ w[EMBED:].T, dc * f
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    grads["w" + d] = np.concatenate([x.reshape(-1, EMBED).T @ flat, dw_h])
    grads["c" + d] = flat.sum(0)
    return dz_all @ w[:EMBED].T


def emissions(p: dict, ids: np.ndarray) -> np.ndarray:
    """(batch, time, tags) scores of symbol windows (batch, time)."""
    x = p["embed"][ids.T]
    f, _ = _lstm(p, "f", x, False)
    b, _ = _lstm(p, "b", x[::-1], False)
    return (np.concatenate([f, b[::-1]], 2) @ p["out"] + p["bias"]).transpose(1, 0, 2)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def _loss(p: dict, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
    """Mean negative log-likelihood of the tags under the CRF, and its gradients."""
    batch, steps = ids.shape
    x = p["embed"][ids.T]
    f, tape_f = _lstm(p, "f", x)
    b, tape_b = _lstm(p, "b", x[::-1])
    both = np.concatenate([f, b[::-1]], 2)
    e = (both @ p["out"] + p["bias"]).astype(np.float64)
    trans = p["trans"].astype(np.float64) + BLOCKED
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0] + START
    for t in range(1, steps):
        alpha[t] = _lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _lse(alpha[-1], 1)
    node = np.exp(alpha + beta - z[None, :, None])
    gold = np.zeros_like(e)
    np.put_along_axis(gold, tags.T[:, :, None], 1.0, 2)
    pair = np.zeros((TAGS, TAGS))
    for t in range(1, steps):
        pair += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
    count = np.zeros((TAGS, TAGS))
    np.add.at(count, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
    score = (gold * e).sum() + (count * trans).sum()
    de = ((node - gold) / batch).astype(np.float32)
    grads = {"trans": ((pair - count) / batch).astype(np.float32), "out": both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS), "bias": de.sum((0, 1))}
    dboth = de @ p["out"].T
    dx = _lstm_back(p, "f", x, tape_f, dboth[:, :, :HIDDEN], grads)
    dx = dx + _lstm_back(p, "b", x[::-1], tape_b, dboth[::-1, :, HIDDEN:], grads)[::-1]
    grads["embed"] = np.zeros_like(p["embed"])
    np.add.at(grads["embed"], ids.T, dx)
    return float((z.sum() - score) / batch), grads


def train(ids: np.ndarray, tags: np.ndarray, seed: int = 1, rounds: int = 9, batch: int = 64, rate: float = 0.015) -> dict[str, np.ndarray]:
    p = init(seed)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    r, step = np.random.default_rng(seed), 0
    total = rounds * -(-len(ids) // batch)
    for _ in range(rounds):
        order = r.permutation(len(ids))
        for i in range(0, len(ids), batch):
            _, grads = _loss(p, ids[order[i : i + batch]], tags[order[i : i + batch]])
            step += 1
            now = rate * (1 - 0.9 * step / total)
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g**2
                p[k] = p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return p


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags of one sequence of scores (time, tags)."""
    full = trans + BLOCKED
    best = e[0] + START
    back = np.empty(e.shape, np.int64)
    for t in range(1, len(e)):
        both = best[:, None] + full
        back[t] = both.argmax(0)
        best = both[back[t], np.arange(TAGS)] + e[t]
    out = np.empty(len(e), np.int64)
    out[-1] = best.argmax()
    for t in range(len(e) - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def spans(tags: np.ndarray) -> list[tuple[int, int, str]]:
    out, start, kind = [], None, 0
    for i, t in enumerate([*tags.tolist(), 0]):
        if start is not None and not (t and t % 2 == 0 and (t - 2) // 2 == kind):
            out.append((start, i, KINDS[kind]))
            start = None
        if t % 2:
            start, kind = i, (t - 1) // 2
    return out
