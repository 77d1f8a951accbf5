"""A bidirectional gated recurrent network with attention pooling, in numpy.

Steps are words.  A word enters as the sum of the vectors of its character n-grams
(over the root of their number) and, where it is in the vocabulary, a vector of its
own.  Both directions run at once, as two sheets of one batch.  Attention weighs the
states of a window's words; the weighted state gives the logit.  An empty window has
the logit of a zero state.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Slots of n-gram vectors, their width, the width of word vectors, states of a direction, and width of the attention.
SLOTS, CHARS, WORDS, STATES, ATTENTION = 1 << 15, 12, 8, 8, 8


class Lexicon(NamedTuple):
    """Distinct words: the slots of their n-grams in one list, where each word's begin, and vocabulary numbers (0: none)."""

    grams: np.ndarray
    first: np.ndarray  # one more entry at the end
    known: np.ndarray

    def take(self, which: np.ndarray) -> Lexicon:
        size = np.diff(self.first)[which]
        first = np.append(0, np.cumsum(size))
        at = np.arange(first[-1]) - np.repeat(first[:-1] - self.first[which], size)
        return Lexicon(self.grams[at], first, self.known[which])


def start(vocabulary: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Weights before training."""
    d, h = CHARS + WORDS, STATES
    normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
    zeros = lambda *shape: np.zeros(shape, np.float32)
    return {
        "chars": 0.1 * rng.standard_normal((SLOTS, CHARS)).astype(np.float32),
        "words": zeros(vocabulary + 1, WORDS),
        "enter": normal(2, d, 3 * h),
        "enter_bias": zeros(2, 3 * h),
        "turn": normal(2, h, 3 * h),
        "turn_bias": zeros(2, h),
        "look": normal(2 * h, ATTENTION),
        "look_bias": zeros(ATTENTION),
        "weigh": normal(ATTENTION, 1),
        "out": normal(2 * h, 1),
        "out_bias": zeros(1),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def word_inputs(p: dict[str, np.ndarray], words: Lexicon, keep: np.ndarray | float = 1.0) -> np.ndarray:
    """A row for each distinct word; keep scales (or drops) the words' own vectors."""
    out = np.zeros((len(words.known), CHARS + WORDS), p["chars"].dtype)
    size = np.diff(words.first)
    if len(words.grams):
        full = size > 0
        out[full, :CHARS] = np.add.reduceat(p["chars"][words.grams], words.first[:-1][full], axis=0)
        out[:, :CHARS] /= np.sqrt(np.maximum(size, 1))[:, None].astype(out.dtype)
    out[:, CHARS:] = p["words"][words.known] * keep
    return out


def gates(p: dict[str, np.ndarray], inputs: np.ndarray) -> np.ndarray:
    """What each distinct word adds to the gates of both directions: (2, words, 3 * STATES)."""
    return np.matmul(inputs, p["enter"]) + p["enter_bias"][:, None]


def all_gates(p: dict[str, np.ndarray], words: Lexicon, keep: float = 1.0, abreast: int = 1 << 15) -> np.ndarray:
    """The gates of any number of words, some at a time."""
    parts = [gates(p, word_inputs(p, words.take(np.arange(lo, min(lo + abreast, len(words.known)))), keep)) for lo in range(0, len(words.known), abreast)]
    return np.concatenate(parts, axis=1) if parts else np.zeros((2, 0, 3 * STATES), np.float32)


def run(p: dict[str, np.ndarray], entering: np.ndarray, index: np.ndarray, present: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Logits of windows; index and present are (steps, windows), index of the words of `entering`.

    With a list as keep, what the backward run needs is appended to it.
    """
    steps, windows = index.shape
    h, kind = STATES, entering.dtype
    states = np.zeros((steps, 2, windows, h), kind)
    now = np.zeros((2, windows, h), kind)
    into = np.empty((2, windows, 3 * h), kind)
    saved, full = [], present.all(axis=1)
    for s in range(steps):
        t = (s, steps - 1 - s)
        for k in range(2):
            np.take(entering[k], index[t[k]], axis=0, out=into[k], mode="clip")
        turned = np.matmul(now, p["turn"])
        rz = into[:, :, : 2 * h] + turned[:, :, : 2 * h]
        rz *= 0.5
        np.tanh(rz, out=rz)
        rz += 1
        rz *= 0.5
        r, z = rz[:, :, :h], rz[:, :, h:]
        inner = turned[:, :, 2 * h :] + p["turn_bias"][:, None]
        n = np.tanh(into[:, :, 2 * h :] + r * inner)
        after = n + z * (now - n)
        there = np.True_
        if not (full[t[0]] and full[t[1]]):
            there = np.stack([present[t[0]], present[t[1]]])[:, :, None]
            after = np.where(there, after, now)
        if keep is not None:
            saved.append((now, r, z, n, inner, there))
        now = after
        states[t[0], 0], states[t[1], 1] = now[0], now[1]
    both = np.concatenate([states[:, 0], states[:, 1]], axis=2)
    seen = np.tanh(both @ p["look"] + p["look_bias"])
    weight = (seen @ p["weigh"])[:, :, 0]
    weight = np.where(present, weight, -np.inf)
    top = weight.max(axis=0, initial=-1e30)
    weight = np.exp(weight - top)
    total = weight.sum(axis=0)
    weight /= np.where(total > 0, total, 1)
    pooled = np.einsum("tb,tbh->bh", weight, both)
    if keep is not None:
        keep += [saved, both, seen, weight, pooled]
    return (pooled @ p["out"])[:, 0] + p["out_bias"][0]


def gradients(p: dict[str, np.ndarray], words: Lexicon, index: np.ndarray, present: np.ndarray, label: np.ndarray, keep: np.ndarray | float = 1.0) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Mean log loss of windows, its gradients, and the windows' logits.

    Gradients of n-gram and word vectors are (rows, values) of those that occur.
    """
    inputs = word_inputs(p, words, keep)
    entering = gates(p, inputs)
    held: list = []
    logit = run(p, entering, index, present, held)
    saved, both, seen, weight, pooled = held
    steps, windows = index.shape
    h = STATES
    loss = float(np.mean(np.logaddexp(0, np.where(label > 0, -logit, logit))))
    d_logit = ((_sigmoid(logit) - label) / windows).astype(inputs.dtype)
    g: dict = {k: np.zeros_like(p[k]) for k in ("turn", "turn_bias")}
    g["out"] = pooled.T @ d_logit[:, None]
    g["out_bias"] = d_logit.sum(keepdims=True)
    d_pooled = d_logit[:, None] * p["out"][:, 0]
    d_both = weight[:, :, None] * d_pooled
    d_weight = np.einsum("tbh,bh->tb", both, d_pooled)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["weigh"] = np.einsum("tba,tb->a", seen, d_score)[:, None]
    d_seen = d_score[:, :, None] * p["weigh"][:, 0] * (1 - seen * seen)
    g["look"] = np.einsum("tbh,tba->ha", both, d_seen)
    g["look_bias"] = d_seen.sum(axis=(0, 1))
    d_both += d_seen @ p["look"].T
    d_entering = np.zeros_like(entering)
    rows, parts = [[], []], [[], []]
    d_now = np.zeros((2, windows, h), inputs.dtype)
    for s in reversed(range(steps)):
        t = (s, steps - 1 - s)
        before, r, z, n, inner, there = saved[s]
        d_after = d_now + np.stack([d_both[t[0], :, :h], d_both[t[1], :, h:]])
        d_in = np.where(there, d_after, 0)
        d_n = d_in * (1 - z) * (1 - n * n)
        d_z = d_in * (before - n) * z * (1 - z)
        d_r = d_n * inner * r * (1 - r)
        d_inner = d_n * r
        d_turned = np.concatenate([d_r, d_z, d_inner], axis=2)
        g["turn"] += np.matmul(before.transpose(0, 2, 1), d_turned)
        g["turn_bias"] += d_inner.sum(axis=1)
        d_now = np.where(there, d_in * z, d_after) + np.matmul(d_turned, p["turn"].transpose(0, 2, 1))
        into = np.concatenate([d_r, d_z, d_n], axis=2)
        for k in range(2):
            rows[k].append(index[t[k]])
            parts[k].append(into[k])
    for k in range(2):
        at, sums = _summed(np.concatenate(rows[k]), np.concatenate(parts[k]))
        d_entering[k, at] = sums
    g["enter"] = np.matmul(inputs.T, d_entering)
    g["enter_bias"] = d_entering.sum(axis=1)
    d_inputs = d_entering[0] @ p["enter"][0].T + d_entering[1] @ p["enter"][1].T
    known = np.flatnonzero(words.known)
    g["words"] = _summed(words.known[known], (d_inputs[:, CHARS:] * keep)[known])
    size = np.diff(words.first)
    spread = d_inputs[:, :CHARS] / np.sqrt(np.maximum(size, 1))[:, None].astype(inputs.dtype)
    g["chars"] = _summed(words.grams, np.repeat(spread, size, axis=0))
    return loss, g, logit


def _summed(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that occur, and the sums of their rows."""
    order = np.argsort(at, kind="stable")
    ordered = at[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(at) else np.zeros(0, np.int64)
    return ordered[first], np.add.reduceat(values[order], first, axis=0) if len(at) else values[:0]


class Adam:
    """Adam; n-gram and word vectors move, and decay, when they occur."""

    def __init__(self, p: dict[str, np.ndarray], rate: float = 0.01, decay: float = 0.01):
        self.p, self.rate, self.decay, self.steps = p, rate, decay, 0
        self.mean, self.square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def step(self, g: dict) -> None:
        self.steps += 1
        values = [x[1] if isinstance(x, tuple) else x for x in g.values()]
        clip = min(1.0, 5.0 / max(float(np.sqrt(sum(float(np.vdot(x, x)) for x in values))), 1e-12))
        rate = self.rate * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for k, x in g.items():
            rows, x = x if isinstance(x, tuple) else (slice(None), x)
            m, v = self.mean[k][rows], self.square[k][rows]
            m += 0.1 * (clip * x - m)
            v += 0.001 * (clip * clip * x * x - v)
            self.mean[k][rows], self.square[k][rows] = m, v
            self.p[k][rows] -= (rate * m / (np.sqrt(v) + 1e-8)).astype(self.p[k].dtype)
            if k in ("chars", "words"):
                self.p[k][rows] *= 1 - self.rate * self.decay
