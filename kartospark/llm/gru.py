"""A gated recurrent language model in numpy with a class-factored output.

The vocabulary is cut into classes; a token's probability is that of its class times
that of the word within the class, so no step normalises over the whole vocabulary.
The last ``n_open`` classes are open: the model predicts the class alone.

All weights are views of one flat vector, so that an update is a handful of array
passes. Only what depends on the step before runs step by step; the rest of a window
(inputs, outputs, gradients of weights) is computed for all its steps at once.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np

#: Units of the hidden state.
HIDDEN = 16
#: Steps of one window of truncated backpropagation; the state is carried into the next.
WINDOW = 16
#: Most streams that a trainer runs side by side; fewer where its texts would make less than ``LEAST_WINDOWS`` windows.
STREAMS = 512
LEAST_WINDOWS = 64
#: A training text is dealt to the streams in stretches of at most so many tokens, each from the zero state.
STRETCH = 1024
RATE = 0.02
CLIP = 1.0

Params = dict[str, np.ndarray]


class Shape(NamedTuple):
    """``starts[c] : starts[c + 1]`` are the words of closed class c; open classes follow the closed ones."""

    starts: np.ndarray
    n_open: int

    @property
    def n_closed(self) -> int:
        return len(self.starts) - 1

    @property
    def n_words(self) -> int:
        return int(self.starts[-1])

    @property
    def start_token(self) -> int:
        """Input of a text's first step; inputs below are words, then open classes."""
        return self.n_words + self.n_open


def initial(shape: Shape, class_mass: np.ndarray, word_mass: np.ndarray, seed: int = 7) -> Params:
    """Random recurrent weights under output biases that already give unigram probabilities."""
    rng = np.random.default_rng(seed)
    n_in, n_class = shape.start_token + 1, shape.n_closed + shape.n_open

    def small(*size: int) -> np.ndarray:
        return rng.normal(0, 0.3 / np.sqrt(HIDDEN), size).astype(np.float32)

    return {
        "E": small(n_in, 3 * HIDDEN),
        "U": small(HIDDEN, 3 * HIDDEN),
        "Wc": np.zeros((HIDDEN, n_class), dtype=np.float32),
        "bc": np.log(class_mass / class_mass.sum()).astype(np.float32),
        "Ww": np.zeros((HIDDEN, shape.n_words), dtype=np.float32),
        "bw": np.log(word_mass).astype(np.float32),
    }


def pack(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unpack(flat: np.ndarray, like: Params) -> Params:
    """Weights as views of ``flat``."""
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


class Steps:
    """A window's forward pass: gates and states of all its tokens, step after step."""

    def __init__(self, p: Params, shape: Shape, xs: list[np.ndarray], h: np.ndarray):
        self.x = np.concatenate(xs)
        self.cuts = np.cumsum([0, *map(len, xs)]).tolist()
        n = len(self.x)
        self.keep = (self.x != shape.start_token).astype(np.float32)[:, None]
        self.before, self.out, self.n, self.hun = (np.empty((n, HIDDEN), dtype=np.float32) for _ in range(4))
        self.gates = np.empty((n, 2 * HIDDEN), dtype=np.float32)
        # Halved here once, as each step would (exact, a power of two).
        g, u = p["E"][self.x], p["U"].copy()
        g[:, : 2 * HIDDEN] *= 0.5
        u[:, : 2 * HIDDEN] *= 0.5
        for a, b in zip(self.cuts, self.cuts[1:], strict=False):
            hp = np.multiply(h[: b - a], self.keep[a:b], out=self.before[a:b])
            hu = hp @ u
            gates = np.add(g[a:b, : 2 * HIDDEN], hu[:, : 2 * HIDDEN], out=self.gates[a:b])
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            self.hun[a:b] = hu[:, 2 * HIDDEN :]
            n_ = np.multiply(gates[:, HIDDEN:], self.hun[a:b], out=self.n[a:b])
            n_ += g[a:b, 2 * HIDDEN :]
            np.tanh(n_, out=n_)
            h = np.subtract(hp, n_, out=self.out[a:b])
            h *= gates[:, :HIDDEN]
            h += n_
        self.state = h.copy()

    def grads(self, p: Params, d_out: np.ndarray, grads: Params) -> None:
        """Adds gradients of the recurrent weights, given those of the loss by each token's state (which is overwritten)."""
        z, r = self.gates[:, :HIDDEN], self.gates[:, HIDDEN:]
        by_n = (1 - z) * (1 - self.n * self.n)
        by_hu = np.empty((len(self.x), 3, HIDDEN), dtype=np.float32)
        by_hu[:, 0] = (self.before - self.n) * z * (1 - z)
        by_hu[:, 1] = by_n * self.hun * r * (1 - r)
        by_hu[:, 2] = by_n * r
        d_hu = np.empty((len(self.x), 3 * HIDDEN), dtype=np.float32)
        u_t, later = np.ascontiguousarray(p["U"].T), None
        for a, b in zip(self.cuts[-2::-1], self.cuts[:0:-1], strict=True):
            dh = d_out[a:b]
            if later is not None:
                dh[: len(later)] += later
            np.multiply(dh[:, None, :], by_hu[a:b], out=d_hu[a:b].reshape(-1, 3, HIDDEN))
            later = d_hu[a:b] @ u_t
            later += dh * z[a:b]
            later *= self.keep[a:b]
        grads["U"] += self.before.T @ d_hu
        d_hu[:, 2 * HIDDEN :] = d_out * by_n
        order = np.argsort(self.x, kind="stable")
        x = self.x[order]
        first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        grads["E"][x[first]] += np.add.reduceat(d_hu[order], first, axis=0)


def _exp(x: np.ndarray) -> np.ndarray:
    """Exponentials of columns less their greatest value, in place; returns the sums."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    return x.sum(axis=0)


def _by_class(shape: Shape, cls: np.ndarray):
    """Stretches of sorted ``cls`` of one closed class of more than one word, with the class's words."""
    cuts = np.searchsorted(cls, np.arange(shape.n_closed + 1)).tolist()
    for c in range(shape.n_closed):
        a, b = int(shape.starts[c]), int(shape.starts[c + 1])
        if cuts[c + 1] > cuts[c] and b - a > 1:
            yield slice(cuts[c], cuts[c + 1]), a, b


def log_prob(p: Params, shape: Shape, h: np.ndarray, cls: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Natural log probability of each target given the state before it; open classes count by class alone."""
    order = np.argsort(cls.astype(np.int16), kind="stable")
    h, cls, word, at = np.ascontiguousarray(h[order].T), cls[order], word[order], np.arange(len(cls))
    x = p["Wc"].T @ h
    x += p["bc"][:, None]
    share = x[cls, at]
    share -= x.max(axis=0)
    share -= np.log(_exp(x))
    for part, a, b in _by_class(shape, cls):
        x = p["Ww"][:, a:b].T @ h[:, part]
        x += p["bw"][a:b, None]
        mine = x[word[part] - a, at[: x.shape[1]]]
        mine -= x.max(axis=0)
        mine -= np.log(_exp(x))
        share[part] += mine
    out = np.empty(len(cls))
    out[order] = share
    return out


def streams(lengths: np.ndarray, n: int) -> list[list[int]]:
    """Deal texts to ``n`` streams of about equal length, longest texts first; fuller streams come first."""
    n = max(1, min(n, len(lengths)))
    load, dealt = np.zeros(n, dtype=np.int64), [[] for _ in range(n)]
    heap = [(0, i) for i in range(n)]
    for t in np.argsort(-lengths, kind="stable").tolist():
        at, i = heapq.heappop(heap)
        dealt[i].append(t)
        load[i] = at + lengths[t]
        heapq.heappush(heap, (int(load[i]), i))
    return [dealt[i] for i in np.argsort(-load, kind="stable")]


class Feed:
    """Texts' inputs and targets laid out in streams; a text's first input is the start token, which resets the state."""

    def __init__(self, shape: Shape, inputs: np.ndarray, starts: np.ndarray, counts: np.ndarray, n: int):
        """Text i has the target rows ``starts[i] : starts[i] + counts[i]`` of ``inputs`` (input ids of the targets)."""
        dealt = streams(counts, n)
        self.row = [np.concatenate([np.arange(starts[t], starts[t] + counts[t]) for t in s]) if s else np.empty(0, dtype=np.int64) for s in dealt]
        self.length = np.array([len(r) for r in self.row])
        before = np.empty(len(inputs), dtype=np.int64)
        before[1:] = inputs[:-1]
        before[starts[counts > 0]] = shape.start_token
        self.before = before
        self.base = np.cumsum(self.length) - self.length
        self.flat = np.concatenate(self.row) if self.row else np.empty(0, dtype=np.int64)

    def windows(self, size: int, rows: int = 0):
        """Rows of ``size`` steps of the streams still running, or as many as make ``rows``, step by step; short streams drop out between steps."""
        falling, t0 = -self.length, 0
        while running := int(np.searchsorted(falling, -t0, side="left")):
            t1 = t0 + max(size, rows // running)
            ks = np.searchsorted(falling, -np.arange(t0, t1), side="left").tolist()
            yield [self.flat[self.base[:k] + t] for t, k in enumerate(ks, t0) if k]
            t0 = t1


def total_log_prob(p: Params, shape: Shape, inputs: np.ndarray, cls: np.ndarray, word: np.ndarray, starts: np.ndarray, counts: np.ndarray, n_streams: int = 256, window: int = 64) -> np.ndarray:
    """Natural log probability of every target row; the state runs through each whole text."""
    feed = Feed(shape, inputs, starts, counts, n_streams)
    out = np.zeros(len(inputs))
    h = np.zeros((len(feed.length), HIDDEN), dtype=np.float32)
    for rows in feed.windows(window, n_streams * window):
        steps = Steps(p, shape, [feed.before[s] for s in rows], h)
        h, rows = steps.state, np.concatenate(rows)
        out[rows] = log_prob(p, shape, steps.out, cls[rows], word[rows])
    return out


def _output_grads(p: Params, shape: Shape, h: np.ndarray, cls: np.ndarray, word: np.ndarray, grads: Params) -> np.ndarray:
    """Adds gradients of the mean negative log probability; returns that of the states."""
    m = np.float32(1 / len(cls))
    order = np.argsort(cls.astype(np.int16), kind="stable")
    h, cls, word, at = np.ascontiguousarray(h[order].T), cls[order], word[order], np.arange(len(cls))

    def errors(w: np.ndarray, bias: np.ndarray, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        d = w.T @ h
        d += bias[:, None]
        d *= m / _exp(d)
        d[target, at[: len(target)]] -= m
        return d

    d = errors(p["Wc"], p["bc"], h, cls)
    grads["Wc"] += h @ d.T
    grads["bc"] += d.sum(axis=1)
    dh = p["Wc"] @ d
    for part, a, b in _by_class(shape, cls):
        d = errors(p["Ww"][:, a:b], p["bw"][a:b], h[:, part], word[part] - a)
        grads["Ww"][:, a:b] += h[:, part] @ d.T
        grads["bw"][a:b] += d.sum(axis=1)
        dh[:, part] += p["Ww"][:, a:b] @ d
    out = np.empty((len(cls), HIDDEN), dtype=np.float32)
    out[order] = dh.T
    return out


def window_grads(p: Params, shape: Shape, xs: list[np.ndarray], cls: np.ndarray, word: np.ndarray, h: np.ndarray, grads: Params) -> np.ndarray:
    """Adds gradients of one window's mean loss to ``grads``, backpropagated to its first step; returns the state after it."""
    steps = Steps(p, shape, xs, h)
    steps.grads(p, _output_grads(p, shape, steps.out, cls, word, grads), grads)
    return steps.state


class Trainer:
    """Adam over windows of texts, from ``weights``; moments last from one call to the next."""

    def __init__(self, weights: np.ndarray, like: Params, shape: Shape):
        self.flat, self.shape = weights.astype(np.float32), shape
        self.p = unpack(self.flat, like)
        self.grad, self.first, self.second = (np.zeros_like(self.flat) for _ in range(3))
        self.grads, self.n = unpack(self.grad, like), 0

    def fit(self, inputs: np.ndarray, cls: np.ndarray, word: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        """One pass of truncated backpropagation over the texts."""
        pieces = -(-counts // STRETCH)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, counts = np.repeat(starts, pieces) + nth * STRETCH, np.minimum(np.repeat(counts, pieces) - nth * STRETCH, STRETCH)
        n = int(np.clip(counts.sum() // (WINDOW * LEAST_WINDOWS), 8, STREAMS))
        feed = Feed(self.shape, inputs, starts, counts, n)
        h = np.zeros((len(feed.length), HIDDEN), dtype=np.float32)
        for steps in feed.windows(WINDOW):
            rows = np.concatenate(steps)
            self.grad.fill(0)
            h = window_grads(self.p, self.shape, [feed.before[s] for s in steps], cls[rows], word[rows], h, self.grads)
            self.n += 1
            norm = float(np.sqrt(self.grad @ self.grad))
            self.grad *= np.float32(min(1.0, CLIP / max(norm, 1e-12)) * min(1.0, len(rows) / (len(feed.length) * WINDOW)) ** 0.5)
            self.first += np.float32(0.1) * (self.grad - self.first)
            self.second += np.float32(0.01) * (self.grad * self.grad - self.second)
            step = np.sqrt(self.second)
            step *= np.float32((1 - 0.99**self.n) ** -0.5)
            step += np.float32(1e-6)
            np.divide(self.first, step, out=step)
            step *= np.float32(RATE / (1 - 0.9**self.n))
            self.flat -= step
