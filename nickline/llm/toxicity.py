"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's inputs are learned: embeddings of the word and of its beginning, and what a layer of filters over its characters, five in a row, finds
most of.  The network reads windows of words in both directions, pools its states by attention and scores each of the overlapping windows; the
highest window, calibrated, is the text's score.  A labelled text doesn't say which of its windows is toxic: training begins with those whose
words are most told apart by the labels (counts out of fold, used for nothing else) and goes on with those that the network scores highest.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, per_text, released, small_batches, table

WINDOW, STEP = 24, 12
HIDDEN, ATTENTION = 8, 8
#: Numbers of a word's embedding, filters over its characters, characters that a filter reads.
EMBEDDED, FILTERS, REACH = 8, 24, 5
INPUTS = 2 * EMBEDDED + FILTERS
#: Bytes of a word's beginning, which has an embedding, too.
BEGINNING = 5
#: Rows of the table of embeddings; words and beginnings in fewer than COMMON training rows have none, and a word is known by its characters.
BUCKETS, COMMON = 1 << 16, 3
#: Share of the words whose embedding is left out in a training step.
DROPPED = 0.5
#: Passes over the chosen windows in each of the four turns.
EPOCHS = 5
#: What weights lose in a step, for Adam.
DECAY = 1e-4
FOLDS = 4
#: Bounds of the training sample: labelled rows of each class, and the characters of one; longer texts aren't trained on.
TRAIN_ROWS, TRAIN_CHARS = 1500, 20_000
SEED = 5

#: Bytes of text that are scored together.
SLAB = 1 << 19

_LETTER = np.array([97 <= c <= 122 or c >= 128 for c in range(256)])
_rng = np.random.default_rng(77)
_BYTE = _rng.integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x5851F42D4C957F2D)


def lowered(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of lower-case text, runs of a-z and bytes of other alphabets.

    start: where each begins; key: its 64-bit hash; kind: which of the different words it is; of these, in order of their hashes,
    keys has the hash, data the bytes, each word between zeros, and first where each begins.
    """

    def __init__(self, data: bytes):
        raw = np.frombuffer(b" " + data + b" ", np.uint8)
        letter = _LETTER[raw]
        self.start = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
        size = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1 - self.start
        if not len(size):
            self.keys, self.kind, self.data, self.first = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64)
            return
        with np.errstate(over="ignore"):
            at = np.flatnonzero(letter)
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            place = np.arange(len(at)) - np.repeat(first, size)
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(size.max()), _BASE)]))
            key = _mixed(np.add.reduceat(_BYTE[raw[at]] * power[place], first) + size.astype(np.uint64))
        self.keys, one, self.kind = np.unique(key, return_index=True, return_inverse=True)
        begin, size = self.start[one], size[one]
        pad = REACH // 2
        ends = np.cumsum(size + 2 * pad)
        self.first = ends - size - pad
        self.data = np.zeros(int(ends[-1]), np.uint8)
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        self.data[np.repeat(self.first, size) + within] = raw[np.repeat(begin, size) + within]

    @classmethod
    def of(cls, data: list[bytes]) -> tuple[Words, np.ndarray]:
        """The words of all of the texts, and where each text's begin (and the last one's end); worked on SLAB bytes at a time.  start isn't kept."""
        parts, counts, i = [], [], 0
        while i < len(data):
            n, j = 0, i
            while j < len(data) and (j == i or n + len(data[j]) <= SLAB):
                n, j = n + len(data[j]) + 1, j + 1
            one = cls(b" ".join(data[i:j]))
            edge = np.searchsorted(one.start, np.concatenate([[0], np.cumsum([len(x) + 1 for x in data[i:j]])]) + 1)
            counts.append(np.diff(edge))
            parts.append(one)
            i = j
        out = cls(b"")
        edges = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64) if parts else np.zeros(1, np.int64)
        parts = [p for p in parts if len(p)]
        if parts:
            out.keys, one, kind = np.unique(np.concatenate([p.keys for p in parts]), return_index=True, return_inverse=True)
            at = np.cumsum([0, *(len(p.keys) for p in parts)])
            out.kind = np.concatenate([kind[a + p.kind] for a, p in zip(at, parts)]).astype(np.int32)
            shift = np.cumsum([0, *(len(p.data) for p in parts)])
            out.first, out.data = np.concatenate([p.first + s for p, s in zip(parts, shift)]), np.concatenate([p.data for p in parts])
            out.data, out.first = part(out, one, np.concatenate([p.sizes() for p in parts]))
        return out, edges

    def __len__(self):
        return len(self.kind)

    def sizes(self) -> np.ndarray:
        """Bytes of each different word."""
        return np.append(self.first[1:] - 2 * (REACH // 2), len(self.data) - REACH // 2) - self.first

    def buckets(self) -> np.ndarray:
        """The rows of each different word and of its beginning in the table of embeddings."""
        size, begin = self.sizes(), np.zeros(len(self.keys), np.uint64)
        for k in range(BEGINNING):
            here = self.data[np.minimum(self.first + k, len(self.data) - 1)] if len(size) else np.zeros(0, np.uint8)
            begin = begin * np.uint64(256) + np.where(k < size, here, 0).astype(np.uint64)
        with np.errstate(over="ignore"):
            return (np.stack([self.keys, _mixed(begin * _BASE + np.uint64(1))], 1) >> np.uint64(48)).astype(np.int64)


def filtered(filters: np.ndarray, data: np.ndarray, first: np.ndarray, keep: bool = False):
    """The most that each filter finds in each word, and with keep where.  filters: REACH tables of numbers for each byte."""
    pad = REACH // 2
    letters = np.flatnonzero(data)
    begin = np.searchsorted(letters, first)
    found = np.zeros((len(letters), filters.shape[2]), filters.dtype)
    for k in range(REACH):
        found += filters[k][data[letters + (k - pad)]]
    most = np.maximum.reduceat(found, begin, axis=0) if len(first) else np.zeros((0, filters.shape[2]), filters.dtype)
    if not keep:
        return most
    word = np.repeat(np.arange(len(first)), np.diff(np.append(begin, len(letters))))
    row, which = np.nonzero(found == most[word])
    _, one = np.unique(word[row] * filters.shape[2] + which, return_index=True)  # the first place of each word and filter
    return most, letters[row[one]].reshape(len(first), -1)


def windows(n: int) -> np.ndarray:
    """Starts of the overlapping windows of a text of n words; the last one ends with it."""
    if n <= WINDOW:
        return np.zeros(min(n, 1), np.int64)
    starts = np.arange(0, n - WINDOW + 1, STEP)
    return starts if starts[-1] == n - WINDOW else np.append(starts, n - WINDOW)


def cut(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, mask) of a text's words, each a number; a short text is padded behind."""
    if len(kind) < WINDOW:
        mask = np.zeros((1, WINDOW), np.float32)
        mask[0, : len(kind)] = 1
        return np.concatenate([kind, np.zeros(WINDOW - len(kind), kind.dtype)])[None], mask
    at = windows(len(kind))[:, None] + np.arange(WINDOW)
    return kind[at], np.ones(at.shape, np.float32)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Two gated recurrent layers, one from each end, attention over their states, and a logit; below them the words' inputs.

    E: embeddings; T: filters over characters; Wf, Uf, cf and Wb, Ub, cb: the layers; A, v: attention; w, b: the logit.
    """

    def __init__(self, seed: int = SEED, weights: dict | None = None):
        rng = np.random.default_rng(seed)
        if weights is None:
            weights = {"E": np.zeros((BUCKETS, EMBEDDED)), "T": rng.normal(0, 0.3, (REACH, 256, FILTERS))}
            for d in "fb":
                weights |= {f"W{d}": rng.normal(0, 0.3, (INPUTS, 3 * HIDDEN)), f"U{d}": rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)), f"c{d}": np.zeros(3 * HIDDEN)}
            weights |= {"A": rng.normal(0, 0.4, (2 * HIDDEN, ATTENTION)), "v": rng.normal(0, 0.4, ATTENTION), "w": rng.normal(0, 0.4, 2 * HIDDEN), "b": np.zeros(1)}
        self.p = {k: x.astype(np.float32) for k, x in weights.items()}

    def inputs(self, rows: np.ndarray, data: np.ndarray, first: np.ndarray, keep: bool = False):
        """INPUTS numbers of each of the words: its embeddings (none where rows is negative) and what the filters find most of."""
        found = filtered(self.p["T"], data, first, keep)
        most, where = found if keep else (found, None)
        x = np.concatenate([np.where(rows[:, :, None] >= 0, self.p["E"][rows], 0).reshape(len(rows), -1), np.tanh(most)], 1)
        return (x, where) if keep else x

    def given(self, x) -> dict[str, np.ndarray]:
        """What words with inputs x give to either layer."""
        return {d: x @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"}

    def _layer(self, given, at, mask, d: str, keep: bool):
        """States of windows `at` of words that give `given`."""
        U, x = self.p[f"U{d}"], given
        n, steps = at.shape
        h, out, kept = np.zeros((n, HIDDEN), x.dtype), np.empty((n, steps, HIDDEN), x.dtype), [None] * steps
        whole = bool(mask.all())
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a, g = given[at[:, t]], h @ U
            zr = sigmoid(a[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            m = np.tanh(a[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            new = m + z * (h - m)
            if not whole:
                new = h + mask[:, t, None] * (new - h)
            if keep:
                kept[t] = (h, z, r, m, g[:, 2 * HIDDEN :])
            out[:, t] = h = new
        return out, kept

    def forward(self, x, at, mask, keep: bool = False, given: dict | None = None):
        """The logits of windows `at` (rows of x, the words' inputs)."""
        given = self.given(x) if given is None else given
        f, kf = self._layer(given["f"], at, mask, "f", keep)
        b, kb = self._layer(given["b"], at, mask, "b", keep)
        states = np.concatenate([f, b], 2)
        u = np.tanh(states @ self.p["A"])
        s = u @ self.p["v"] + (mask - 1) * 1e4
        e = np.exp(s - s.max(1, keepdims=True))
        alpha = e / e.sum(1, keepdims=True)
        pooled = (alpha[:, None] @ states)[:, 0]
        logit = pooled @ self.p["w"] + self.p["b"][0]
        return (logit, (kf, kb, states, u, alpha, pooled)) if keep else logit

    def _back(self, x, at, mask, d: str, kept, dout, grads):
        """Adds a layer's gradients; returns that of x."""
        W, U = self.p[f"W{d}"], self.p[f"U{d}"]
        n, steps = at.shape
        dU, dh = np.zeros_like(U), np.zeros((n, HIDDEN), x.dtype)
        da = np.empty((n, steps, 3 * HIDDEN), x.dtype)
        for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
            h, z, r, m, gn = kept[t]
            dnew = dh + dout[:, t]
            on = mask[:, t, None]
            dh = dnew * (1 - on)
            dnew = dnew * on
            dm, dz = dnew * (1 - z), dnew * (h - m)
            dh += dnew * z
            dn = dm * (1 - m * m)
            da[:, t] = np.concatenate([dz * z * (1 - z), dn * gn * r * (1 - r), dn], 1)
            dg = np.concatenate([da[:, t, : 2 * HIDDEN], dn * r], 1)
            dU += h.T @ dg
            dh += dg @ U.T
        dgiven = np.zeros((len(x), 3 * HIDDEN), x.dtype)
        order = np.argsort(at, axis=None, kind="stable")
        word = at.ravel()[order]
        begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        dgiven[word[begin]] = np.add.reduceat(da.reshape(-1, 3 * HIDDEN)[order], begin, axis=0)
        grads |= {f"W{d}": x.T @ dgiven, f"U{d}": dU, f"c{d}": dgiven.sum(0)}
        return dgiven @ W.T

    def gradients(self, rows, data, first, at, mask, y) -> tuple[float, dict]:
        """The loss over windows `at` of words (rows of the embeddings, bytes) with labels y, and its gradients."""
        x, where = self.inputs(rows, data, first, True)
        logit, (kf, kb, states, u, alpha, pooled) = self.forward(x, at, mask, True)
        p = sigmoid(logit)
        loss = float(-np.mean(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)))
        dl = ((p - y) / len(y)).astype(x.dtype)
        grads = {"w": pooled.T @ dl, "b": np.array([dl.sum()], x.dtype)}
        dpooled = dl[:, None] * self.p["w"]
        dalpha = (states @ dpooled[:, :, None])[:, :, 0]
        dstates = alpha[:, :, None] * dpooled[:, None]
        ds = alpha * (dalpha - (alpha * dalpha).sum(1, keepdims=True))
        grads["v"] = np.einsum("nt,ntk->k", ds, u)
        du = ds[:, :, None] * self.p["v"] * (1 - u * u)
        grads["A"] = np.einsum("nth,ntk->hk", states, du)
        dstates += du @ self.p["A"].T
        dx = self._back(x, at, mask, "f", kf, dstates[:, :, :HIDDEN], grads) + self._back(x, at, mask, "b", kb, dstates[:, :, HIDDEN:], grads)
        grads["E"] = np.zeros_like(self.p["E"])
        np.add.at(grads["E"], rows[rows >= 0], dx[:, : 2 * EMBEDDED].reshape(len(x), 2, EMBEDDED)[rows >= 0])
        dmost = dx[:, 2 * EMBEDDED :] * (1 - x[:, 2 * EMBEDDED :] ** 2)
        grads["T"] = np.zeros_like(self.p["T"])
        which = np.arange(FILTERS)
        for k in range(REACH):
            cell = data[where + (k - REACH // 2)].astype(np.int64) * FILTERS + which
            grads["T"][k] = np.bincount(cell.ravel(), dmost.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        return loss, grads

    def fit(self, said: Words, rows, at, mask, y, epochs: int, rate: float = 0.01, batch: int = 256, seed: int = SEED) -> None:
        """Adam over shuffled batches of windows `at` of said's different words; in each, some words go without their embedding."""
        rng, first, second, n = np.random.default_rng(seed), {}, {}, 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                some = order[i : i + batch]
                words, inner = np.unique(at[some], return_inverse=True)
                own = np.where(rng.random((len(words), 2)) < DROPPED, -1, rows[words])
                _, grads = self.gradients(own, *part(said, words), inner.reshape(len(some), -1), mask[some], y[some])
                n += 1
                for k, g in grads.items():
                    g = (g + DECAY * self.p[k]).astype(np.float32)
                    first[k] = 0.9 * first.get(k, 0) + 0.1 * g
                    second[k] = 0.999 * second.get(k, 0) + 0.001 * g * g
                    self.p[k] -= (rate * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)


def part(said: Words, words: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(data, first) of some of the different words."""
    pad = REACH // 2
    size = (said.sizes() if sizes is None else sizes)[words] + 2 * pad
    stop = np.cumsum(size)
    within = np.arange(int(size.sum())) - np.repeat(stop - size, size)
    return said.data[np.repeat(said.first[words] - pad, size) + within], stop - size + pad


def calibrated(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the highest windows' logits, by Newton steps."""
    scale = max(1e-6, float(np.abs(logit).max()))
    x = np.stack([logit / scale, np.ones_like(logit)], 1).astype(np.float64)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ b)
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (p - y)) + 1e-2 * b)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0] / scale), float(b[1])


def log_odds(one: np.ndarray, none: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Of each word, from the numbers of toxic and other rows that have it; small where few have it."""
    odds = np.log((one + 0.5) / (n1 + 1)) - np.log((none + 0.5) / (n0 + 1))
    seen = one + none
    return odds * seen / (seen + 3)


def _told_apart(own: np.ndarray, kind: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How much each word (of row `own`, of a kind) is told apart by the labels of the rows of other folds."""
    fold = np.arange(len(y)) // 2 % FOLDS
    kinds = int(kind.max()) + 1
    pair = np.unique(own * kinds + kind)
    row, which = pair // kinds, pair % kinds
    counts = np.zeros((FOLDS, 2, kinds))
    np.add.at(counts, (fold[row], y[row].astype(int), which), 1)
    rows = np.array([[((fold == f) & (y == k)).sum() for k in (0, 1)] for f in range(FOLDS)])
    c, n = counts.sum(0) - counts, rows.sum(0) - rows
    odds = np.stack([log_odds(c[f, 1], c[f, 0], n[f, 1], n[f, 0]) for f in range(FOLDS)])
    return odds[fold[own], kind]


def train(texts: list[str], y: list[int], weights: tuple[float, float] = (1.0, 1.0)) -> dict:
    """The model: the network's weights, which rows of the embeddings are known, and the calibration.

    weights: how many labelled rows a sampled row of class 0 or 1 stands for.  Without rows of both classes, or without any word, the model is a
    constant, the share of toxic rows (0 without rows).
    """
    y = np.array(y, np.float32)
    said, edge = Words.of([lowered(t) for t in texts])
    if not 0 < y.sum() < len(y) or not len(said):
        return {"constant": float(y.mean()) if len(y) else 0.0}
    own_row = np.repeat(np.arange(len(y)), np.diff(edge))
    kinds = len(said.keys)
    buckets = said.buckets()
    begin = np.unique(buckets[:, 1], return_inverse=True)[1]
    known = np.zeros(BUCKETS, bool)
    for which, of in ((np.arange(kinds), buckets[:, 0]), (begin, buckets[:, 1])):
        n = np.bincount(np.unique(own_row * kinds + which[said.kind]) % kinds, minlength=kinds)
        known[of[n[which] >= COMMON]] = True
    rows = np.where(known[buckets], buckets, -1)
    told = np.maximum(_told_apart(own_row, said.kind, y), _told_apart(own_row, begin[said.kind], y))

    spans = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
    score = np.concatenate([np.partition(np.where(m > 0, c, -9), -2, axis=1)[:, -2:].sum(1) for c, m in (cut(told[a:b]) for a, b in spans)])
    del told, own_row
    cuts = [cut(said.kind[a:b]) for a, b in spans]
    own = np.repeat(np.arange(len(cuts)), [len(m) for _, m in cuts])
    start = np.searchsorted(own, np.arange(len(cuts)))
    size = np.bincount(own, minlength=len(cuts))
    every, masks = np.concatenate([c for c, _ in cuts]), np.concatenate([m for _, m in cuts])
    del cuts
    released()
    has = np.diff(edge) > 0
    net, rng = Network(), np.random.default_rng(SEED)
    for turn in range(4):
        best = np.lexsort((-score, own))
        chosen = [best[start]]
        chosen.append(best[start[size > 1] + 1][y[size > 1] == 0])
        chosen.append((start + rng.integers(0, size))[y == 0])
        at = np.concatenate(chosen)
        at = at[has[own[at]]]
        net.fit(said, rows, every[at], masks[at], y[own[at]], EPOCHS, rate=0.01 if turn < 3 else 0.003, seed=turn)
        x = np.concatenate([net.inputs(rows[some], *part(said, some)) for some in np.split(np.arange(kinds), range(10_000, kinds, 10_000))])
        given = net.given(x)
        score = np.concatenate([net.forward(x, every[i : i + 4096], masks[i : i + 4096], given=given) for i in range(0, len(every), 4096)])
    high = np.maximum.reduceat(score, start)
    slope, offset = calibrated(high[has], y[has], np.where(y[has] == 1, weights[1], weights[0]))
    return {"weights": net.p, "known": known, "slope": slope, "offset": offset}


class Scorer:
    """A trained model in a Python worker."""

    def __init__(self, model: dict):
        self.model = model
        if "weights" in model:
            self.net = Network(weights=model["weights"])

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Scores of texts; 0 for a text without words."""
        out, slab, held = np.zeros(len(texts)), [], 0
        for i, text in enumerate(texts):
            slab.append((i, lowered(text)))
            held += len(slab[-1][1]) + 1
            if held >= SLAB:
                self._slab(slab, out)
                slab, held = [], 0
        if slab:
            self._slab(slab, out)
        return out

    def _slab(self, slab, out) -> None:
        said = Words(b" ".join(t for _, t in slab))
        ends = np.cumsum([len(t) + 1 for _, t in slab])
        edge = np.searchsorted(said.start, np.concatenate([[0], ends]) + 1)
        full = np.flatnonzero(np.diff(edge))
        rows = np.array([i for i, _ in slab])[full]
        if "constant" in self.model:
            out[rows] = self.model["constant"]
            return
        if not len(full):
            return
        buckets = said.buckets()
        x = self.net.inputs(np.where(self.model["known"][buckets], buckets, -1), said.data, said.first)
        given = self.net.given(x)
        parts, masks, owner, held = [], [], [], 0
        for k, row in zip(full.tolist(), rows.tolist()):
            c, m = cut(said.kind[edge[k] : edge[k + 1]])
            parts.append(c)
            masks.append(m)
            owner.append((row, len(m)))
            held += len(m)
            if held >= 4096:
                self._score(x, given, parts, masks, owner, out)
                parts, masks, owner, held = [], [], [], 0
        if owner:
            self._score(x, given, parts, masks, owner, out)

    def _score(self, x, given, cuts, masks, owner, out) -> None:
        at, m = np.concatenate(cuts), np.concatenate(masks)
        whole = m.all(1)
        logit = np.empty(len(at))
        for one in (whole, ~whole):
            some = np.flatnonzero(one)
            for i in range(0, len(some), 2048):
                logit[some[i : i + 2048]] = self.net.forward(x, at[some[i : i + 2048]], m[some[i : i + 2048]], given=given)
        first = np.concatenate([[0], np.cumsum([n for _, n in owner])[:-1]])
        out[[i for i, _ in owner]] = sigmoid(self.model["slope"] * np.maximum.reduceat(logit, first) + self.model["offset"])


_scorers: dict[str, Scorer] = {}


def _scorer(key: str, model: dict) -> Scorer:
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> dict:
    """Trains on at most `rows` labelled rows of each class, the first by a hash of the id; never on held-out ids.

    Ids may have any type that has equality and an order.  Labels of null ids or of null are left out; an id's largest label counts.  Of several texts
    of one id, all within `chars`, that of the smallest hash is taken, so the driver gets two times `rows` texts at most, and reruns the same ones.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(f"`{doc_id}`").isNotNull() & F.col(f"`{toxic}`").isin(0, 1) & ~held_out(F.col(f"`{doc_id}`")))
    known = known.groupBy(F.col(f"`{doc_id}`").alias("id")).agg(F.max(F.col(f"`{toxic}`")).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    picked = [(r["id"], r["y"]) for y in (0, 1) for r in known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows).collect()]
    chosen = spark.createDataFrame(picked, known.schema)
    found = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).filter(F.length("text") <= chars).join(F.broadcast(chosen), "id")
    one = found.groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).collect()
    one = sorted((r["id"], r["y"], r["text"]) for r in one)
    sampled = [sum(y == k for _, y, _ in one) for k in (0, 1)]
    texts, y = [t for _, _, t in one], [y for _, y, _ in one]
    del one
    model = train(texts, y, tuple(counts.get(k, 0) / max(1, sampled[k]) for k in (0, 1)))
    del texts
    released()
    return model


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Each row of docs as the struct `row`, with score.

    Null, empty and wordless texts score 0.  Equal texts have equal scores; a text of any length is scored whole.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    handle, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = _scorer(key, handle.value)
        for column in batches:
            yield pa.array(run([t or "" for t in column.to_pylist()]), pa.float64())

    return packed(docs).withColumn("score", per_text(scored, "double")(F.col(f"row.`{text}`")))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(held_out(F.col("row.doc_id")), F.lit(False))
    return out.select("row.doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that aren't predicted toxic, with their own columns.

    Null and wordless texts score 0 and stay; repeated rows stay or go together; without labels of both classes the score is the share of toxic labels.
    """
    return score(docs, learn(docs, labels, text=text), text).filter("score < 0.5").select("row.*")
