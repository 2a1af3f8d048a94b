"""Substring dedup by collinear chaining.

Equal texts are one class and its text is looked at once.  Winnowed k-mers of words are the seeds; each occurrence is joined with the
occurrences in the texts that hold the seed first and last (by a hash of the text), so n holders make fewer than 2 n pairs, not n
squared.  Where no passage covers an occurrence then, finer keys take the seed's place, joined the same way: pairs of neighbouring seeds, and
all runs of 50 words around a long seed, whose holders all share a passage.  What is open still is joined with holders of pairs of seeds
with other words between that agree as far as the open word: first with a few, then, where it is open yet, with all.  The seeds that two texts share become runs on a diagonal; a Fenwick tree chains runs in order with gap costs; chains are
aligned word by word, out to where the words differ, and those long and alike enough are passages.  Stretches that repeat a few words
over and over have no order to chain by: they are passages of each other if they repeat the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, saved, small_batches, table, texts
from .jaccard import mixed, word_hashes

#: Least words of a passage, on both sides, and the least share of its words that agree.
LEAST, ALIKE = 50, 0.8
#: (words of a seed, window): of so many seeds in a row the smallest hash is kept, so that any k + w - 1 shared words share a seed.
#: Five words find fuzzy passages; 25 are rarely shared by chance, and any 50 words in a row hold one.
SEEDS = ((5, 20), (25, 26))
#: What a word of a gap on either side costs a chain, and the longest gap within a passage: such a gap costs less than the shortest seed's words.
GAP, LONGEST_GAP = 0.04, LEAST
#: A stretch that repeats at most so many words is compared by those words alone.
PERIOD = 20
#: Keys with more than this share of all rows are hot: there can be at most 1 / HOT of them.
HOT = 0.001
#: Tasks that a hot text's chains are dealt out to.
SALTS = 64
#: Ids of texts that may be broadcast, eight bytes each; more meet the texts in a shuffle.
BROADCAST_IDS = 500_000
#: A key's places are dealt out in parts of about so many where all are joined.
DEALT = 1000
#: Before all meet, a place meets about so many of its key's holders, in each of TURNS turns.
FEW, TURNS = 4, 1
#: Where a seed's first and last holders gave no passage, it makes a key with each of so many next seeds.
NEXT = 2

_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)


_made: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n + 1 powers, kept for the next call."""
    if base not in _made or len(_made[base]) <= n:
        with np.errstate(over="ignore"):
            _made[base] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 16), base, np.uint64)]))
    return _made[base]


def hashes(word: np.ndarray, k: int) -> np.ndarray:
    """The hashes of all runs of k words, each from two sums of the words times powers, shifted to the run's start."""
    n = len(word)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(word * _powers(_ODD, n)[:n])])
        return mixed((sums[k:] - sums[:-k]) * _powers(_BACK, n)[: n - k + 1] + np.uint64(k))


#: Shared words between which every chain has a seed at each end, less the seeds' reach: a shorter chain can't grow to LEAST.
_SPAN = LEAST - 2 * (SEEDS[0][1] - 1)


def _slid(x: np.ndarray, w: int, of) -> np.ndarray:
    """The least (or most) of each w values in a row, by doubling."""
    n = 1
    while n < w:
        step = min(n, w - n)
        x = of(x[:-step], x[step:])
        n += step
    return x


def winnowed(word: np.ndarray, k: int, w: int, text: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the kept seeds: those that are the smallest of a window they lie in, ties included.

    text: the number of the text that each word is of, where words of several texts follow each other; windows lie within a text.
    """
    if len(word) < k + w - 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = np.maximum(hashes(word, k), np.uint64(1))
    least = _slid(g, w, np.minimum)
    if text is not None:
        least[text[: len(least)] != text[k + w - 2 :]] = 0  # less than any hash: no seed is the smallest there
    edge = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_slid(np.concatenate([edge, least, edge]), w, np.maximum) == g)
    return g[at], at


def stretches(word: np.ndarray, periods) -> list[tuple[int, int, int]]:
    """(hash of the repeated words, start, end) of the stretches of LEAST words or more that repeat the same few words.

    The hash is the smallest of the words' rotations, so it is the same wherever a stretch begins.
    """
    out: list[tuple[int, int, int]] = []
    for p in sorted(periods):
        same = np.concatenate([[False], word[p:] == word[:-p], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            b += p
            if b - a >= LEAST and not any(u <= a and b <= v for _, u, v in out):
                out.append((int(hashes(word[a : a + 2 * p - 1], p).min().view(np.int64)), a, b))
    return out


_SEED = pa.schema([("h", pa.int64()), ("t", pa.int64()), ("pos", pa.int32()), ("k", pa.int32()), ("again", pa.bool_()), ("before", pa.int64()), ("size", pa.int32())])


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, t, pos, k, again, before, size): hash, text, place, words, whether the text has others with this hash or seeds beside it were left out (a chain of
    it may be a passage however short it is), the sum of the text's words before it (see within), the text's words.

    A seed that the text has PERIOD words before or fewer is left out.  Of stretches k is the negative length.  A batch's texts are worked on together.
    """
    for batch in batches:
        data = list(texts(batch.column("text")))
        word, first = word_hashes(b" ".join(data), True)
        text = np.searchsorted(np.cumsum([len(x) + 1 for x in data]), first, "right")
        enough = (np.bincount(text, minlength=len(data)) >= LEAST)[text]
        word, text = word[enough], text[enough]
        if not len(word):
            continue
        size = np.bincount(text, minlength=len(data))
        name, begin = batch.column("t").to_numpy(), np.cumsum(size) - size
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(word * _powers(_ODD, len(word))[: len(word)])])
        periods: dict[int, set[int]] = {}
        for k, w in SEEDS:
            h, at = winnowed(word, k, w, text)
            own = text[at]
            order = np.lexsort((at, h, own))
            same = (h[order][1:] == h[order][:-1]) & (own[order][1:] == own[order][:-1])
            gap = np.where(same, np.diff(at[order]), PERIOD + 1)
            near = np.flatnonzero(gap <= PERIOD)
            for o, p in np.unique(np.stack([own[order[near]], gap[near]], 1), axis=0).tolist():
                periods.setdefault(o, set()).add(p)
            far = np.ones(len(h), bool)
            far[order[near + 1]] = False
            gone = np.concatenate([[-LEAST - k], at[~far], [len(word) + LEAST + k]])
            gone_of = np.concatenate([[-1], own[~far], [-1]])
            h, at, own = h[far], at[far], own[far]
            i = np.searchsorted(gone, at)
            reach = SEEDS[0][1] + SEEDS[0][0]
            beside = (at - gone[i - 1] < reach) & (gone_of[i - 1] == own) | (gone[i] - at < reach) & (gone_of[i] == own)
            order = np.lexsort((h, own))
            same = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (own[order][1:] == own[order][:-1]), [False]])
            again = beside
            again[order] |= same[1:] | same[:-1]
            with np.errstate(over="ignore"):
                before = (sums[at] - sums[begin[own]]) * _powers(_BACK, len(word))[begin[own]]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(name[own]), pa.array((at - begin[own]).astype(np.int32)), pa.array(np.full(len(h), k, np.int32)), pa.array(again), pa.array(before.view(np.int64)), pa.array(size[own].astype(np.int32))], schema=_SEED)
        for o, lengths in periods.items():
            if found := stretches(word[begin[o] : begin[o] + size[o]], lengths):
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array(np.full(n, name[o])), pa.array([f[1] for f in found], pa.int32()), pa.array([f[1] - f[2] for f in found], pa.int32()), pa.array(np.zeros(n, bool)), pa.array(np.zeros(n, np.int64)), pa.array(np.full(n, size[o], np.int32))], schema=_SEED)


def runs(x: np.ndarray, y: np.ndarray, k: np.ndarray, again: np.ndarray) -> list[tuple[int, int, int, bool]]:
    """Seeds that meet on a diagonal as (x, y, length, again), by x then y."""
    order = np.lexsort((x, x - y))
    x, y, k, again = x[order], y[order], k[order], again[order]
    out, reach = [], SEEDS[0][1]
    for a, b, n, g in zip(x.tolist(), y.tolist(), k.tolist(), again.tolist()):
        if out and a - b == out[-1][0] - out[-1][1] and a <= out[-1][0] + max(out[-1][2], reach):
            p = out[-1]
            out[-1] = (p[0], p[1], max(p[2], a + n - p[0]), p[3] or g)
        else:
            out.append((a, b, n, g))
    return sorted(out)


def chains(anchors: list[tuple[int, int, int, bool]]) -> list[list[int]]:
    """The chains of anchors (x, y, length, ..), best first, each anchor in one of them.

    A chain's score is its anchors' words less GAP for each word between them on either side.  Anchors follow each other if the next
    begins, on both sides, where the last has ended or later.  A Fenwick tree over y holds the best score, gaps taken out, of the
    chains that have ended, so each anchor finds its best predecessor in log n.
    """
    n = len(anchors)
    ys = sorted({a[1] + a[2] for a in anchors})
    best, who = [float("-inf")] * (len(ys) + 1), [-1] * (len(ys) + 1)
    score, back = [0.0] * n, [-1] * n
    starts = sorted(range(n), key=lambda i: (anchors[i][0], anchors[i][1]))
    ends = sorted(range(n), key=lambda i: anchors[i][0] + anchors[i][2])
    rank = {y: r + 1 for r, y in enumerate(ys)}
    done = 0
    for i in starts:
        x, y, length = anchors[i][:3]
        while done < n and anchors[ends[done]][0] + anchors[ends[done]][2] <= x:
            j = ends[done]
            value, r = score[j] + GAP * (anchors[j][0] + anchors[j][1] + 2 * anchors[j][2]), rank[anchors[j][1] + anchors[j][2]]
            while r < len(best):
                if value > best[r]:
                    best[r], who[r] = value, j
                r += r & -r
            done += 1
        top, j, r = float("-inf"), -1, _below(ys, y)
        while r:
            if best[r] > top:
                top, j = best[r], who[r]
            r -= r & -r
        gain = top - GAP * (x + y)
        score[i], back[i] = (length + gain, j) if gain > 0 else (float(length), -1)
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def _below(ys: list[int], y: int) -> int:
    """How many of the sorted ys are at most y."""
    lo, hi = 0, len(ys)
    while lo < hi:
        mid = (lo + hi) // 2
        if ys[mid] <= y:
            lo = mid + 1
        else:
            hi = mid
    return lo


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches as one table for each key; a group is a text and what belongs to it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


_CHAIN = pa.schema([("s", pa.int64()), ("t", pa.int64()), ("id", pa.int64()), ("at", pa.int32()), ("words", pa.list_(pa.int32())), ("anchors", pa.list_(pa.int32()))])


def _short(word: np.ndarray) -> np.ndarray:
    """32 bits of each word's hash: words in place are compared by these."""
    return (word & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a text (its own first, then its links by s) to chains that could grow to a passage, with the words about them."""
    for group in _grouped(batches, ["t"]):
        text = next(texts(group.column("text").slice(0, 1)))
        if group.num_rows < 2:
            continue
        t, own = group.column("t")[0].as_py(), group.column("id")[0].as_py()
        s, x, y, k, again = (group.column(c).slice(1).to_numpy() for c in ("s", "pos", "spos", "k", "again"))
        word, rows = None, []
        cuts = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1])
        again = np.asarray(again, bool)
        # texts whose seeds lie too close together for any chain of them
        wide = np.maximum.reduceat(x + k, cuts) - np.minimum.reduceat(x, cuts) >= _SPAN
        wide |= np.logical_or.reduceat(again, cuts)
        stops = np.append(cuts[1:], len(s))
        for a, b in zip(cuts[wide].tolist(), stops[wide].tolist()):
            found = runs(x[a:b].astype(np.int64), y[a:b].astype(np.int64), k[a:b].astype(np.int64), again[a:b])
            for chain in chains(found) if len(found) > 1 else [[0]]:
                part = [found[i] for i in chain]
                lo, hi = part[0][0], part[-1][0] + part[-1][2]
                if hi - lo < _SPAN and not any(p[3] for p in part):
                    continue
                if word is None:
                    word = _short(word_hashes(text))
                at = max(0, lo - LEAST)
                rows.append((int(s[a]), t, own, at, word[at : hi + LEAST], [v for p in part for v in p[:3]]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_CHAIN)], schema=_CHAIN)


def aligned(a: np.ndarray, at: int, b: np.ndarray, anchors: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """The passages (start and end in one text, start and end in the other, words that agree) of a chain.

    a holds the words of one text from its word `at`, b all those of the other.  Gaps within LONGEST_GAP are aligned by longest
    common subsequence; a longer one ends a passage.  Ends grow as long as words agree, up to LEAST words, for a passage that a seed
    within touches.  A passage whose words don't agree enough gives way to its best stretch between two anchors that does.
    """
    parts: list[list[tuple]] = [[]]  # (x, y, words, where the gap before begins)
    for x, y, n in anchors:
        if parts[-1]:
            p = parts[-1][-1]
            u, v = p[0] + p[2], p[1] + p[2]
            if max(x - u, y - v) > LONGEST_GAP:
                parts.append([])
        if not parts[-1]:
            parts[-1].append((x, y, n, (x, y)))
        else:
            parts[-1].append((x, y, n, (u, v)))
    out = []
    for part in parts:
        x0, y0 = part[0][:2]
        x1, y1 = part[-1][0] + part[-1][2], part[-1][1] + part[-1][2]
        grown = _same(a[: x0 - at][::-1], b[max(0, y0 - LEAST) : y0][::-1])
        after = _same(a[x1 - at :], b[y1 : y1 + LEAST])
        if min(x1 - x0, y1 - y0) + grown + after < LEAST:
            continue
        agree = [int((a[x - at : x - at + n] == b[y : y + n]).sum()) for x, y, n, _ in part]
        agree[0] += grown
        agree[-1] += after
        begin = [(x, y) for x, y, _, _ in part]
        begin[0] = (x0 - grown, y0 - grown)
        stop = [(x + n, y + n) for x, y, n, _ in part]
        stop[-1] = (x1 + after, y1 + after)
        gaps = [_common(a[u - at : x - at].tolist(), b[v:y].tolist()) for x, y, _, (u, v) in part]
        total = [0]
        for g, c in zip(agree, gaps):
            total.append(total[-1] + g + c)
        i = 0
        while i < len(part):  # the longest good stretch from the first anchor that begins one, then on from its end
            for j in range(len(part) - 1, i - 1, -1):
                m = total[j + 1] - total[i] - gaps[i]
                span = (stop[j][0] - begin[i][0], stop[j][1] - begin[i][1])
                if min(span) < LEAST:
                    break
                if m >= ALIKE * max(span):
                    out.append((begin[i][0], stop[j][0], begin[i][1], stop[j][1], m))
                    i = j
                    break
            i += 1
    return out


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading words agree."""
    n = min(len(a), len(b), LEAST)
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def _common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence."""
    if not a or not b:
        return 0
    if a == b:
        return len(a)
    row = [0] * (len(b) + 1)
    for u in a:
        held = 0
        for j, v in enumerate(b, 1):
            was = row[j]
            row[j] = held + 1 if u == v else max(row[j], row[j - 1])
            held = was
    return row[-1]


_FOUND = pa.schema([("s", pa.int64()), ("s_id", pa.int64()), ("s_from", pa.int32()), ("s_to", pa.int32()), ("t", pa.int64()), ("t_id", pa.int64()), ("t_from", pa.int32()), ("t_to", pa.int32()), ("agree", pa.int32())])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a text (its own first, then chains with it) to passages, streamed: only the text is held."""
    s = own = b = None
    for batch in batches:
        col = {n: batch.column(n).to_pylist() for n in ("kind", "s", "id", "t", "at")}
        (words, w_at), (anchors, a_at) = _flat(batch.column("words")), _flat(batch.column("anchors"))
        rows = []
        for i, kind in enumerate(col["kind"]):
            if kind == 0:
                s, own, b = col["s"][i], col["id"][i], next(texts(batch.column("text").slice(i, 1)))
                continue
            if isinstance(b, bytes):  # only texts that have chains are taken apart
                b = _short(word_hashes(b))
            flat = anchors[a_at[i] : a_at[i + 1]].tolist()
            for x0, x1, y0, y1, m in aligned(words[w_at[i] : w_at[i + 1]], col["at"][i], b, list(zip(flat[::3], flat[1::3], flat[2::3]))):
                rows.append((s, own, y0, y1, col["t"][i], col["id"][i], x0, x1, m))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_FOUND)], schema=_FOUND)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of lists, and where each row's begin."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "bigint", pa.int32(): "int", pa.bool_(): "boolean", pa.list_(pa.int32()): "array<int>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _cover(first: np.ndarray, end: np.ndarray, words: int) -> np.ndarray:
    """How many of the words before each, up to `words`, no passage covers."""
    edge = np.zeros(words + 2, np.int64)
    np.add.at(edge, np.minimum(first, words), 1)
    np.add.at(edge, np.minimum(end, words), -1)
    return np.concatenate([[0], np.cumsum(np.cumsum(edge)[:words] <= 0)])


_FINE = pa.schema([("key", pa.int64()), ("t", pa.int64()), ("pos", pa.int32()), ("mate", pa.int32()), ("k", pa.int32()), ("open", pa.bool_())])


def _fine(key, t, pos, mate, k: int, open_) -> pa.RecordBatch:
    n = len(pos)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.broadcast_to(np.asarray(t, np.int64), n)), pa.array(pos.astype(np.int32)), pa.array(mate.astype(np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(open_)], schema=_FINE)


def _whole(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000) -> Iterator[pa.Table]:
    """Sorted batches as tables of about so many rows; rows of one key stay together."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.column(key).to_numpy(zero_copy_only=False)
        if n >= rows and (cuts := np.flatnonzero(np.concatenate([[at[0] != held[-1].column(key)[-1].as_py()], at[1:] != at[:-1]]))).size:
            yield pa.Table.from_batches([*held, batch.slice(0, int(cuts[-1]))])
            batch = batch.slice(int(cuts[-1]))
            held, n = [], 0
        held.append(batch)
        n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts (a text's passages, kind 0, from pos to pos + k, and its shared seeds, kind 1) to their finer keys.

    A short seed makes a key with each of the next NEXT ones; it is open if no passage covers all of the two.  A long seed
    keeps its own key, to be taken apart by _windows; it is open if words within LEAST of it aren't covered.
    """
    for group in _whole(batches, "t"):
        t, h, pos, k, kind = (group.column(c).to_numpy() for c in ("t", "h", "pos", "k", "kind"))
        pos, k, seed = pos.astype(np.int64), k.astype(np.int64), kind == 1
        # all texts on one line, further apart than any pair or window reaches
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        size = np.maximum.reduceat(pos + k, first) + 2 * LEAST
        base = np.repeat(np.cumsum(size) - size + LEAST, np.diff(np.append(first, len(t))))
        place = pos + base
        bare = _cover(place[~seed], (place + k)[~seed], int(size.sum()) + LEAST)
        for length, _ in SEEDS:
            mine = np.flatnonzero(seed & (k == length))
            mine = mine[np.argsort(place[mine], kind="stable")]
            at, key = place[mine], h[mine].view(np.uint64)
            if length == SEEDS[-1][0]:
                if len(at):
                    yield _fine(key, t[mine], pos[mine], np.full(len(at), -1), length, bare[at + LEAST] > bare[np.maximum(at + length - LEAST, base[mine])])
                continue
            for step in range(1, NEXT + 1):
                one = np.flatnonzero(at[step:] - at[:-step] <= LEAST - length)
                two = one + step
                if len(one):
                    with np.errstate(over="ignore"):
                        both = mixed(key[one] * np.uint64(_ODD) + mixed(key[two]))
                    yield _fine(both, t[mine][one], pos[mine][one], pos[mine][two], length, bare[at[two] + length] > bare[at[one]])


_APART = pa.schema([("key", pa.int64()), ("words", pa.int64()), ("t", pa.int64()), ("pos", pa.int32()), ("mate", pa.int32()), ("size", pa.int32())])


def within(before: np.ndarray, one: np.ndarray, two: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The hash of the words from one seed's place to another's, from the sums of the words before them."""
    with np.errstate(over="ignore"):
        return mixed((before[two] - before[one]) * _powers(_BACK, int(pos.max(initial=0)))[pos[one]])


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts' short shared seeds to keys of every two that a chain may join, with the hash of the words from one to the other."""
    reach = LONGEST_GAP + SEEDS[0][0]
    for group in _whole(batches, "t"):
        t, h, pos, before, size = (group.column(c).to_numpy() for c in ("t", "h", "pos", "before", "size"))
        key, sums = h.view(np.uint64), before.view(np.uint64)
        for step in range(1, len(t)):
            one = np.flatnonzero((pos[step:] - pos[:-step] <= reach) & (t[step:] == t[:-step]))
            if not len(one):
                break
            two = one + step
            with np.errstate(over="ignore"):
                both = mixed(key[one] * np.uint64(_ODD) + mixed(key[two]))
            yield pa.RecordBatch.from_arrays([pa.array(both.view(np.int64)), pa.array(within(sums, one, two, pos).view(np.int64)), *(pa.array(x[one]) for x in (t, pos)), pa.array(pos[two]), pa.array(size[one])], schema=_APART)


_ASKED = pa.schema([*list(_APART)[:5], ("open", pa.bool_()), ("left", pa.int32()), ("right", pa.int32())])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts (passages, kind 0, from pos to mate, places of keys, kind 1, and the texts that ask, kind 2, or every) to the places: open where the
    words from one seed to the other aren't all covered, else left and right are the words from the nearest that isn't to them (0: none).  With the
    seed these are fewer than LEAST, as runs of LEAST equal words are covered."""
    for group in _whole(batches, "t"):
        key, words, t, pos, mate, size, kind, every = (group.column(c).to_numpy(zero_copy_only=False) for c in ("key", "words", "t", "pos", "mate", "size", "kind", "every"))
        place, asks = kind == 1, every.astype(bool) | np.isin(t, t[kind == 2])
        if not place.any():
            continue
        # all texts on one line, further apart than a place reaches
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        room = np.maximum.reduceat(np.maximum(mate, size).astype(np.int64), first) + 3 * LEAST
        base = np.repeat(np.cumsum(room) - room + LEAST, np.diff(np.append(first, len(t))))
        bare = _cover((pos + base)[kind == 0], (mate + base)[kind == 0], int(room.sum()) + 2 * LEAST)
        there, line = bare[1:] > bare[:-1], np.arange(len(bare) - 1)
        last, following = np.maximum.accumulate(np.where(there, line, -1)), np.minimum.accumulate(np.where(there, line, len(line))[::-1])[::-1]
        edge = base[place]
        lo, hi, end = pos[place] + edge, mate[place] + SEEDS[0][0] + edge, size[place] + edge
        last, following, own = last[lo - 1], following[hi], bare[hi] > bare[lo]
        beside, most = ~own & asks[place], LEAST - SEEDS[0][0]
        left = np.where(beside & (lo - last < most) & (last >= edge), lo - last, 0)
        right = np.where(beside & (following - hi + 1 < most) & (following < end), following - hi + 1, 0)
        yield pa.RecordBatch.from_arrays([*(pa.array(x[place]) for x in (key, words, t, pos, mate)), pa.array(own & asks[place]), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32))], schema=_ASKED)


_BESIDE = pa.schema(list(_ASKED)[:6])


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a text (itself, kind 0, its places of keys, kind 1) to keys that hold the words beside the place too, for each distance that lefts and
    rights (a bit each) name; open where the text's own nearest uncovered word is at that distance."""
    for group in _grouped(batches, ["t"]):
        if group.num_rows < 2:
            continue
        word = word_hashes(next(texts(group.column("text").slice(0, 1))))
        key, words, t, pos, mate, left, right, lefts, rights = (group.column(c).slice(1).to_numpy() for c in ("key", "words", "t", "pos", "mate", "left", "right", "lefts", "rights"))
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(word * _powers(_ODD, len(word))[: len(word)])])
            found = []
            for side, (own, asked) in enumerate(((left, lefts), (right, rights))):
                i, n = np.nonzero(asked[:, None] >> np.arange(LEAST) & 1)
                lo = mate[i].astype(np.int64) + SEEDS[0][0] if side else pos[i] - n
                there = (lo >= 0) & (lo + n <= len(word))
                i, n, lo = i[there], n[there], lo[there]
                run = mixed((sums[lo + n] - sums[lo]) * _powers(_BACK, len(word))[lo] + (2 * n + side).astype(np.uint64))
                found.append((i, mixed(key[i].view(np.uint64) * np.uint64(_ODD) + run), own[i] == n))
        i, new, mine = (np.concatenate(x) for x in zip(*found))
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), *(pa.array(x[i]) for x in (words, t, pos, mate)), pa.array(mine)], schema=_BESIDE)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a text (itself, kind 0, its passages, kind 1, and its long seeds, kind 2) to the runs of LEAST words around the seeds, open where not covered."""
    for group in _grouped(batches, ["t"]):
        t = group.column("t")[0].as_py()
        pos, k, kind = (group.column(c).to_numpy(zero_copy_only=False) for c in ("pos", "k", "kind"))
        seeds = np.asarray(pos[kind == 2], np.int64)
        if not len(seeds):
            continue
        word = word_hashes(next(texts(group.column("text").slice(0, 1))))
        n = len(word) - LEAST + 1
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, np.clip(seeds + SEEDS[-1][0] - LEAST, 0, n), 1)
        np.add.at(edge, np.minimum(seeds + 1, n), -1)
        at = np.flatnonzero(np.cumsum(edge)[:n] > 0)
        first, length = np.asarray(pos[kind == 1], np.int64), np.asarray(k[kind == 1], np.int64)
        bare = _cover(first, first + length, len(word))
        if len(at):
            yield _fine(hashes(word, LEAST)[at], t, at, np.full(len(at), -1), LEAST, bare[at + LEAST] > bare[at])


def _ids(whole: DataFrame, name: str) -> DataFrame:
    return whole.select(F.col("t").alias(f"{name}_t"), F.col("id").alias(f"{name}_id"))


def _joined(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """left, of so many rows, with right's only row of its key; right.n is at most the number of left's rows of the key.

    Keys of more than HOT of the rows, so fewer than 1 / HOT of them, are named in a filter and their rows of right broadcast.
    """
    is_hot = F.col("n") > HOT * rows
    named = [r[0] for r in right.filter(is_hot).select(key).collect()]
    if not named:
        return left.join(right.hint("merge"), key)
    hot, cold = left.filter(F.col(key).isin(named)), left.filter(~F.col(key).isin(named))
    return hot.join(F.broadcast(right.filter(is_hot)), key).unionByName(cold.join(right.filter(~is_hot).hint("merge"), key))


def _only(whole: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of whole whose first column is among ids (one column, distinct, written)."""
    key, n = whole.columns[0], ids.count()
    ids = ids.toDF(key)
    return whole.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids.hint("merge"), key, "left_semi")


def _cyclic(seeds: DataFrame, whole: DataFrame) -> DataFrame:
    """Stretches against the first, or for that one the last, stretch of another text that repeats the same words."""
    cyclic = seeds.select("h", "t", F.col("pos").alias("t_from"), (F.col("pos") - F.col("k")).alias("t_to"))
    span = F.struct("t", "t_from", "t_to")
    unit = cyclic.groupBy("h").agg(F.min(span).alias("a"), F.max(span).alias("b"), F.count("*").alias("n")).filter("a.t != b.t")
    unit = unit.join(_ids(whole, "a"), F.col("a.t") == F.col("a_t")).join(_ids(whole, "b"), F.col("b.t") == F.col("b_t"))
    unit = saved(unit.select("h", "n", "a", "a_id", "b", "b_id"), "chain-units")
    at_first = F.col("t") == F.col("a.t")
    o, o_id = F.when(at_first, F.col("b")).otherwise(F.col("a")), F.when(at_first, F.col("b_id")).otherwise(F.col("a_id"))
    cyclic = _joined(cyclic, unit, "h", cyclic.count()).withColumns({"o": o, "s_id": o_id}).join(_ids(whole, "t"), F.col("t") == F.col("t_t"))
    shorter = F.least(F.col("o.t_to") - F.col("o.t_from"), F.col("t_to") - F.col("t_from")).alias("agree")
    return cyclic.select(F.col("o.t").alias("s"), "s_id", F.col("o.t_from").alias("s_from"), F.col("o.t_to").alias("s_to"), "t", "t_id", "t_from", "t_to", shorter)


def _found(links: DataFrame, whole: DataFrame, few: bool = False) -> DataFrame:
    """The passages of the texts that links (t, s, pos, spos, k, again) bring together; the links are dropped.

    With few, only texts that have links are read; then those that chains lie in.
    """
    spark = whole.sparkSession

    def none(kind: str):
        return F.lit(None).cast(kind)

    if few:
        linked = saved(links.select("t").distinct(), "chain-linked")
    some = _only(whole, linked) if few else whole
    texts_in = some.select("t", "id", "text", none("bigint").alias("s"), none("int").alias("pos"), none("int").alias("spos"), none("int").alias("k"), none("boolean").alias("again"), F.lit(0).alias("kind"))
    links_in = links.select("t", none("bigint").alias("id"), none("string").alias("text"), "s", "pos", "spos", "k", "again", F.lit(1).alias("kind"))
    both = texts_in.unionByName(links_in).repartition("t").sortWithinPartitions("t", "kind", "s", "pos", "spos")
    chained = saved(both.mapInArrow(_chained, _ddl(_CHAIN)), "chain-chains")
    drop(links)

    counts = saved(chained.groupBy("s").count(), "chain-counts")
    big = F.broadcast(counts.filter(F.col("count") > HOT * chained.count()).select("s"))
    salt = F.pmod(F.xxhash64("t", "at"), F.lit(SALTS)).cast("int")
    base = _only(whole.select(F.col("t").alias("s"), "id", "text"), counts.select("s"))
    first = base.withColumn("salt", F.lit(0)).unionByName(base.join(big, "s").withColumn("salt", F.explode(F.sequence(F.lit(1), F.lit(SALTS - 1)))))
    first = first.select("s", "salt", F.lit(0).alias("kind"), "id", "text", none("bigint").alias("t"), none("int").alias("at"), none("array<int>").alias("words"), none("array<int>").alias("anchors"))
    then = chained.join(big.withColumn("big", F.lit(True)), "s", "left").withColumn("salt", F.when(F.col("big"), salt).otherwise(0))
    then = then.select("s", "salt", F.lit(1).alias("kind"), "id", none("string").alias("text"), "t", "at", "words", "anchors")
    found = saved(first.unionByName(then).repartition("s", "salt").sortWithinPartitions("s", "salt", "kind").mapInArrow(_aligned, _ddl(_FOUND)), "chain-found")
    drop(chained, counts, *([linked] if few else []))
    return found


def _met(fine: DataFrame) -> DataFrame:
    """Links of the open rows with the first and the last holder of their key."""
    place = F.struct("t", "pos", "mate")
    both = fine.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("z"), F.max("open").alias("any"), F.count("*").alias("n")).filter("a.t != z.t AND any")
    both = saved(both.select("key", "a", "z", "n"), "chain-keys")
    met = _joined(fine.filter("open"), both, "key", fine.count())
    met = met.select("t", "pos", "mate", "k", F.explode(F.filter(F.array("a", "z"), lambda o: o.t != F.col("t"))).alias("o"))
    one = F.struct(F.col("pos").alias("pos"), F.col("o.pos").alias("spos"))
    two = F.struct(F.col("mate").alias("pos"), F.col("o.mate").alias("spos"))
    met = met.select("t", F.col("o.t").alias("s"), "k", F.explode(F.when(F.col("mate") < 0, F.array(one)).otherwise(F.array(one, two))).alias("p"))
    return met.select("t", "s", "p.pos", "p.spos", "k", F.lit(True).alias("again")).distinct()


def _finer(whole: DataFrame, seeds: DataFrame, found: DataFrame, cyclic: DataFrame) -> DataFrame:
    """Links, by finer keys, of what no passage covers among the shared seeds (h, t, pos, k); found and cyclic have the passages.

    A key has one row for each place, and a row two links, so the work on a seed that n texts hold grows with n.
    """
    ends = [(x, F.col(f"{x}_from").alias("pos"), (F.col(f"{x}_to") - F.col(f"{x}_from")).alias("k")) for x in ("s", "t")]
    covered = [f.select(F.col(x).alias("t"), pos, k) for f in (found, cyclic) for x, pos, k in ends]
    covered = saved(covered[0].unionByName(covered[1]).unionByName(covered[2]).unionByName(covered[3]).distinct(), "chain-covered")
    both = covered.select(F.lit(0).cast("bigint").alias("h"), "t", "pos", "k", F.lit(0).alias("kind")).unionByName(seeds.select("h", "t", "pos", "k", F.lit(1).alias("kind")))
    ddl = "key bigint, t bigint, pos int, mate int, k int, open boolean"
    fine = saved(both.repartition("t").sortWithinPartitions("t", "kind").mapInArrow(_pairs, ddl), "chain-fine")

    long = fine.filter(F.col("k") == SEEDS[-1][0])
    held = saved(long.join(long.filter("open").select("key").distinct().hint("merge"), "key", "left_semi").select("t", "pos", "k"), "chain-held")
    read = saved(held.select("t").distinct(), "chain-read")
    none = F.lit(None).cast("string").alias("text")
    rows = _only(whole, read).select("t", "text", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("k"), F.lit(0).alias("kind"))
    rows = rows.unionByName(_only(covered, read).select("t", none, "pos", "k", F.lit(1).alias("kind"))).unionByName(held.select("t", none, "pos", "k", F.lit(2).alias("kind")))
    around = saved(rows.repartition("t").sortWithinPartitions("t", "kind").mapInArrow(_windows, ddl), "chain-windows")
    links = saved(_met(fine.filter(F.col("k") < SEEDS[-1][0])).unionByName(_met(around)), "chain-links")
    drop(covered, fine, held, read, around)
    return links


def _placed(seeds: DataFrame) -> DataFrame:
    """Places of keys of two seeds that texts hold with other words between.

    Where all words between a chain's seeds agree, it lies in a run of equal words; those of LEAST are found by their own hashes.  So a passage
    with an edit has two seeds in a row, at most LONGEST_GAP apart, with other words between, and texts that agree there needn't meet: a
    line that n texts share makes no pairs.
    """
    short = seeds.filter(F.col("k") == SEEDS[0][0]).select("h", "t", "pos", "before", "size")
    pairs = saved(short.repartition("t").sortWithinPartitions("t", "pos").mapInArrow(_apart, _ddl(_APART)), "chain-apart")
    keys = pairs.groupBy("key").agg(F.min("words").alias("a"), F.max("words").alias("z"), F.min("t").alias("s"), F.max("t").alias("e"))
    keys = saved(keys.filter("a != z AND s != e").select("key"), "chain-keys")
    placed = saved(pairs.join(keys.hint("merge"), "key"), "chain-placed")
    drop(pairs, keys)
    return placed


def _others(whole: DataFrame, placed: DataFrame, passed: list[DataFrame], turn: int | None, ask: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Links of what no passage covers still with all holders of its keys, or in a turn with about FEW of them; and the texts (t) that ask in the next.

    A word that isn't covered lies between a chain's two seeds with other words between, or in a run of equal words with one of them; there only
    holders that agree from the seed to that word can cover it, so the words' hash is of the key, and n copies of a text don't meet for an edit that
    is one's own.  A text without such a holder asks no more, unless its passages change.  The texts that ask, all without ask, are dropped.
    """
    zero, none = F.lit(0).cast("bigint"), F.lit(0)
    both = placed.withColumns({"kind": F.lit(1), "every": F.lit(ask is None)})
    spans = [(f, F.col(x), F.col(f"{x}_from"), F.col(f"{x}_to"), 0) for f in passed for x in ("s", "t")]
    for f, t, pos, mate, kind in [*spans, *([(ask, F.col("t"), none, none, 2)] if ask is not None else [])]:
        both = both.unionByName(f.select(zero.alias("key"), zero.alias("words"), t.alias("t"), pos.alias("pos"), mate.alias("mate"), none.alias("size"), F.lit(kind).alias("kind"), F.lit(ask is None).alias("every")))
    asked = saved(both.repartition("t").sortWithinPartitions("t", "kind").mapInArrow(_asked, _ddl(_ASKED)), "chain-asked")
    bits = [F.bit_or(F.when(F.col(x) > 0, F.expr(f"shiftleft(1L, {x})")).otherwise(zero)).alias(f"{x}s") for x in ("left", "right")]
    keys = saved(asked.groupBy("key").agg(F.max("open").alias("any"), *bits).filter("any OR lefts != 0 OR rights != 0"), "chain-keys")
    near = saved(asked.join(keys.hint("merge"), "key"), "chain-near")
    drop(asked, keys, *([ask] if ask is not None else []))

    beside = near.filter("lefts != 0 OR rights != 0").select("t", "key", "words", "pos", "mate", "left", "right", "lefts", "rights", F.lit(1).alias("kind"))
    read = saved(beside.select("t").distinct(), "chain-read")
    texts_in = _only(whole, read).select("t", "text", none.alias("kind"))
    both = texts_in.unionByName(beside, allowMissingColumns=True).repartition("t").sortWithinPartitions("t", "kind")
    beside = saved(both.mapInArrow(_beside, _ddl(_BESIDE)), "chain-beside")

    pairs = near.filter("any").select(*_BESIDE.names).unionByName(beside)
    keys = pairs.groupBy("key").agg(F.min("words").alias("a"), F.max("words").alias("z"), F.min("t").alias("s"), F.max("t").alias("e"), F.max("open").alias("any"), F.count("*").alias("n"))
    keys = saved(keys.filter("a != z AND s != e AND any").select("key", F.ceil(F.col("n") / (DEALT if turn is None else FEW)).cast("int").alias("parts")), "chain-keys")
    both = saved(pairs.join(keys.hint("merge"), "key"), "chain-both")
    drop(near, read, beside, keys)
    part = F.pmod(F.xxhash64("t", F.lit(turn or 0)), F.col("parts")).cast("int")
    # a key's open places are dealt out; its holders stand in each part, in a turn in theirs
    asking = both.filter("open").select("key", "words", "t", "pos", "mate", part.alias("part"))
    stands = F.explode(F.sequence(none, F.col("parts") - 1)) if turn is None else part
    held = both.select("key", F.col("words").alias("w"), F.col("t").alias("s"), F.col("pos").alias("spos"), F.col("mate").alias("smate"), stands.alias("part"))
    met = asking.join(held.hint("merge"), ["key", "part"]).filter("words != w AND t != s")
    met = met.select("t", "s", F.explode(F.array(F.struct("pos", "spos"), F.struct(F.col("mate").alias("pos"), F.col("smate").alias("spos")))).alias("p"))
    links = saved(met.select("t", "s", "p.pos", "p.spos", F.lit(SEEDS[0][0]).alias("k"), F.lit(True).alias("again")).distinct(), "chain-others")
    ask = saved(both.filter("open").select("t").unionByName(links.select(F.col("s").alias("t"))).distinct(), "chain-asking")
    drop(both)
    return links, ask


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Passages of LEAST words or more that stand in another text too, edits of up to a fifth of the words allowed.

    A stretch that repeats the same at most PERIOD words is a passage, of any length from LEAST, where another text has one of the same words.
    Returns doc_id, first_word, end_word, other_id, other_first, other_end (long; words `[^\\x20\\x09-\\x0D]+` from 0, ends
    exclusive) and agreeing words: one row for each passage of a text and a text that holds its seeds first or last, or any that does where these gave none, and one the other way
    round for each stretch of the holder (with the smallest other id).  Ids are those of classes of equal texts: the smallest.  Every document
    of a class of LEAST words or more has a row for its whole text, against the class's smallest id (that one against the largest).
    Where these gave none, runs of LEAST equal words are found by their own hashes, so every run of LEAST words that two texts share lies in
    passages; edited ones that still aren't covered are found by any two seeds at most LONGEST_GAP apart, among all their holders.  A passage ends at the first differing word beyond its
    outermost seeds, so an edit near its end shortens it.  Documents without a passage have no row.  Null and empty texts have none; rows of one id and text are one document; a null id is an
    id of its own; further columns are not read, whatever their names.  Seeds' holders are chosen by a hash of the text, so results
    don't depend on how rows are dealt.
    """
    spark = docs.sparkSession
    small_batches(spark, 200)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumns({"t": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})
    rows = rows.filter(F.length("text") >= 2 * LEAST - 1)
    # a hot text's copies meet in each map task before they are shuffled
    one = [F.min("id").alias("lo"), F.max("id").alias("hi"), F.max(F.col("id").isNull()).alias("none"), F.count("*").alias("n"), F.max("text").alias("text"), (F.min("t2") != F.max("t2")).alias("mixed")]
    classes = saved(rows.groupBy("t").agg(*one), "chain-texts")
    if twins := [r.t for r in classes.filter("mixed").select("t").collect()]:  # different texts of one hash: about one in 2^64 pairs
        rows = rows.withColumn("t", F.when(F.col("t").isin(twins), F.col("t2")).otherwise(F.col("t")))
        classes = saved(rows.groupBy("t").agg(*one), "chain-texts")
    whole = classes.select("t", F.col("lo").alias("id"), "text")

    seeds = saved(whole.mapInArrow(_seeds, _ddl(_SEED)), "chain-seeds")
    shared = seeds.filter("k > 0").groupBy("h").agg(F.min("t").alias("s"), F.max("t").alias("e"), F.count("*").alias("n")).filter("s != e")
    shared = saved(shared, "chain-shared")
    met = saved(_joined(seeds.filter("k > 0"), shared, "h", seeds.count()), "chain-met")
    # every text searches all places of the seed in its first and last holders, these in each other
    places = met.filter("t = s OR t = e").groupBy("h").agg(F.max("n").alias("n"), F.collect_list(F.struct(F.col("t").alias("s"), F.col("pos").alias("spos"))).alias("ends"))
    places = saved(places, "chain-places")
    links = _joined(met.select("h", "t", "pos", "k", "again"), places, "h", met.count())
    links = links.select("t", "pos", "k", "again", F.explode(F.filter("ends", lambda o: o.s != F.col("t"))).alias("o"))
    links = saved(links.select("t", "o.s", "pos", "o.spos", "k", "again"), "chain-links")
    drop(places)
    cyclic = saved(_cyclic(seeds.filter("k < 0"), whole), "chain-cyclic")
    drop(seeds, shared)
    found = _found(links, whole)

    rest = _finer(whole, met, found, cyclic)
    found = found.unionByName(_found(rest, whole, few=True))
    placed = _placed(met)
    drop(met)
    ask = None
    for turn in (*range(TURNS), None):
        rest, ask = _others(whole, placed, [found, cyclic], turn, ask)
        found = found.unionByName(_found(rest, whole, few=True))
    drop(placed, ask)

    def named(*cols):
        return [F.col(c).cast("long").alias(n) for c, n in zip(cols, ("doc_id", "first_word", "end_word", "other_id", "other_first", "other_end", "agreeing"))]

    there = found.unionByName(cyclic).select(*named("t_id", "t_from", "t_to", "s_id", "s_from", "s_to", "agree"))
    least = F.min(F.struct("t_id", "t_from", "t_to", "agree")).alias("o")
    back = found.groupBy("s", "s_id", "s_from", "s_to").agg(least).select(*named("s_id", "s_from", "s_to", "o.t_id", "o.t_from", "o.t_to", "o.agree"))

    length = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    copied = classes.filter("lo < hi OR (none AND lo IS NOT NULL)").select("t", "n", "lo", "hi", length.alias("words")).filter(F.col("words") >= LEAST)
    copied = saved(copied, "chain-copied")
    zero = F.lit(0).cast("long")
    other = F.when(F.col("id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    copies = _joined(rows.select("id", "t"), copied, "t", docs.count()).distinct()
    copies = copies.select(F.col("id").alias("doc_id"), zero.alias("first_word"), F.col("words").alias("end_word"), other.alias("other_id"), zero.alias("other_first"), F.col("words").alias("other_end"), F.col("words").alias("agreeing"))
    return there.unionByName(back).distinct().unionByName(copies)


def op4_chaining(spark, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
