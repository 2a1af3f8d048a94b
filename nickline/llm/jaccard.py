"""Exact n-gram Jaccard join with signature trees.

Texts become sets of hashed word shingles; equal sets are one class.  Classes that can link are brought together first: two
sets of similarity t differ in so few shingles that, of a few more parts into which shingles fall by hash, one must hold the
same shingles in both, so classes that agree on a part are one group.  In each group a signature tree (nodes of OR-combined token
bitmaps and size ranges) is traversed against itself: node pairs whose greatest possible overlap is too small are pruned, pairs of
leaves are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, packed, per_text, saved, small_batches, table, texts

#: A-Z in lower case; white space is a space; all else stays.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c in (9, 10, 11, 12, 13) else c for c in range(256))
BITS = 4096
LEAF = 16
#: Shingles of the classes that one task compares at most, about; a larger group is dealt out in blocks, and pairs of blocks are tasks where blocks stay apart.
BLOCK = 100_000
#: Sizes of the differences that parts are made for: the next is larger by so much.
LEVEL = 1.3
#: Shingles that this many texts of a sample of at most so many have are frequent, the commonest first.  Any such list gives the same result;
#: a better one brings fewer unlike texts together.
FREQUENT, SAMPLE, MOST_FREQUENT = 5, 20_000, 500_000

_M = np.uint64(0xFF51AFD7ED558CCD)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M
    x = (x ^ (x >> np.uint64(29))) * _GOLD
    return x ^ (x >> np.uint64(32))


_rng = np.random.default_rng(2024)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x5851F42D4C957F2D)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 1 << 16), _BASE))])
    return _powers


def word_hashes(text: bytes, places: bool = False):
    """The 64-bit hashes of the text's words `[^\\x20\\x09-\\x0D]+`, in order, and with places where each begins."""
    data = np.frombuffer(text.translate(FOLD), np.uint8)
    gap = np.concatenate([[True], data == 32, [True]])
    first, end = np.flatnonzero(~gap[1:] & gap[:-1]), np.flatnonzero(gap[1:] & ~gap[:-1])
    if not len(first):
        return (np.zeros(0, np.uint64), first) if places else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        # a word's hash: its bytes times powers that start anew with each word
        place = np.arange(len(data)) - np.repeat(np.concatenate([first, [0]]), np.diff(np.concatenate([[0], first[1:], [len(data), len(data)]])))
        value = _BYTE[data] * powers(len(data) + 1)[np.maximum(place, 0)]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(value)])
        out = mixed(sums[end] - sums[first] + (end - first).astype(np.uint64))
    return (out, first) if places else out


def rolling(word: np.ndarray, k: int) -> np.ndarray:
    """The hashes of all runs of k words, of which there must be as many."""
    out = np.zeros(len(word) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mixed(out * _BASE + word[i : len(word) - k + 1 + i])
    return out


def shingles(text: bytes, k: int) -> np.ndarray:
    """The sorted 64-bit hashes of the text's distinct shingles of k words; of fewer words, the whole is one."""
    word = word_hashes(text)
    if not len(word):
        return word
    out = rolling(word, min(k, len(word)))
    if len(word) < k:
        with np.errstate(over="ignore"):
            out = mixed(out + np.uint64(len(word)))
    return np.unique(out)


def class_key(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that name the set."""
    with np.errstate(over="ignore"):
        a, b = mixed(hashes + _GOLD).sum(dtype=np.uint64), mixed(hashes ^ _M).sum(dtype=np.uint64)
        return int(mixed(a + np.uint64(len(hashes))).view(np.int64)), int(mixed(b).view(np.int64))


def levels(limit: int = 1 << 40) -> list[int]:
    out, x = list(range(8)), 8
    while x < limit:
        out.append(x)
        x = int(x * LEVEL) + 1
    return out


_LEVELS = np.array(levels())


def differences(n, t: Fraction):
    """The most shingles in which a set of n and a set of as many or more can differ at similarity t."""
    return (n * (t.denominator - t.numerator)) // t.numerator


def signatures(hashes: np.ndarray, t: Fraction, frequent: np.ndarray | None = None) -> np.ndarray:
    """A signature for each part of the set.  Sets of similarity t or more have one in common.

    At level d the hashes fall into m > d parts by another hash.  Two linked sets differ in at most d shingles, so at least m - d parts
    are equal in both.  A part is weak without a shingle that isn't frequent, and weaker still if empty.  If a set has fewer than m - d weak parts, one of
    the equal parts isn't weak, and both sets sign it; only a set with more also signs its weak parts that aren't empty, and only one with so
    many empty parts signs those.  So of two linked sets both sign an equal part at the first of these steps that holds for either.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64)
    rare = np.ones(n, bool)
    if frequent is not None and len(frequent):
        rare = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] != hashes
    least = -(-n * t.numerator // t.denominator)
    lo, hi = np.searchsorted(_LEVELS, [differences(least, t), differences(n, t)])
    out = []
    with np.errstate(over="ignore"):
        for level in range(int(lo), int(hi) + 1):
            d = int(_LEVELS[level])
            m = 1 if d == 0 else d + 1 + max(3, d // 5)
            seed = np.uint64(level + 1) * _GOLD
            x = mixed(hashes ^ seed)
            part = (x % np.uint64(m)).astype(np.int64)
            low = np.bincount(part, (x & np.uint64(0xFFFFFFFF)).astype(np.float64), m).astype(np.uint64)
            high = np.bincount(part, (x >> np.uint64(32)).astype(np.float64), m).astype(np.uint64)
            sign = mixed(mixed(low + (high << np.uint64(32))) + mixed(np.arange(m, dtype=np.uint64) + seed))
            strong, filled = np.bincount(part[rare], minlength=m) > 0, np.bincount(part, minlength=m) > 0
            if m - strong.sum() < m - d:
                sign = sign[strong]
            elif m - filled.sum() < m - d:
                sign = sign[filled]
            out.append(sign)
    return np.concatenate(out)


def _sketches(k: int):
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            n, a, b = [], [], []
            for text in texts(column):
                h = shingles(text, k)
                n.append(len(h))
                x, y = class_key(h)
                a.append(x)
                b.append(y)
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["n", "a", "b"])

    return sketch


def _signed(k: int, t: Fraction, handle):
    """(sign, v, u) of each text, once for a class in a task as far as it remembers.

    Of the vertices with one signature that a task has at hand only the first is sent by it; the others are sent as edges to the first (u), dealt out by
    themselves, so a signature of very many texts comes but a few times from each task.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = handle.value
        signs, owners, size = [], [], 0
        for key, h in _once(batches, k):
            s = signatures(h, t, frequent)
            signs.append(s)
            owners.append(np.full(len(s), key[0]))
            size += len(s)
            if size > 500_000:
                yield _pairs(signs, owners)
                signs, owners, size = [], [], 0
        if signs:
            yield _pairs(signs, owners)

    return sign


def _once(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """(class, shingles) of the texts, as far as a task remembers each class once."""
    seen: set = set()
    for batch in batches:
        for text in texts(batch.column(0)):
            h = shingles(text, k)
            if len(h) and (key := class_key(h)) not in seen:
                if len(seen) < 1_000_000:
                    seen.add(key)
                yield key, h


def frequent_shingles(rows: DataFrame, k: int, n: int) -> np.ndarray:
    """The sorted hashes of the shingles that several texts of a sample of the n rows (text) have."""
    sampled = rows.filter(F.pmod(F.xxhash64("text"), F.lit(n // SAMPLE + 1)) == 0)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h in _once(batches, k):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    counts = sampled.mapInArrow(each, "h bigint").groupBy("h").count().filter(F.col("count") >= FREQUENT)
    found = counts.orderBy(F.col("count").desc(), "h").limit(MOST_FREQUENT).select("h").toPandas().h.to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


def _pairs(signs, owners) -> pa.RecordBatch:
    sign, v = np.concatenate(signs).view(np.int64), np.concatenate(owners).astype(np.int64)
    order = np.lexsort((v, sign))
    sign, v = sign[order], v[order]
    first = np.flatnonzero(np.concatenate([[True], sign[1:] != sign[:-1]]))
    head = np.repeat(v[first], np.diff(np.append(first, len(sign))))
    edge = v != head
    once = np.ones(len(v), bool)
    once[1:] = (sign[1:] != sign[:-1]) | (v[1:] != v[:-1])
    sign = np.where(edge, v, sign)
    return pa.RecordBatch.from_arrays([pa.array(sign[once]), pa.array(v[once]), pa.array(head[once], mask=~edge[once])], names=["sign", "v", "u"])


def components(edges: DataFrame, name: str) -> DataFrame:
    """v, c: the smallest vertex that each vertex of the edges (u, v) reaches.

    Every vertex takes the smallest label around it, then its label's label, until nothing changes; each round is written to the shared folder.
    The smallest label is pre-aggregated before each shuffle.
    """
    both = edges.filter("u <> v").select("u", "v").unionByName(edges.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = saved(both.distinct(), name)
    step = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")).select(F.col("u").alias("v"), "c"), name)
    while True:
        labels = step.select("v", "c")
        near = both.join(labels, "v").groupBy("u").agg(F.min("c").alias("near"))
        new = labels.join(near.withColumnRenamed("u", "v"), "v").select("v", F.least("c", "near").alias("c"), F.col("c").alias("old"))
        over = new.groupBy("old").agg(F.min("c").alias("hook"))  # what one vertex of a label learns, all learn
        new = new.join(over, "old").select("v", F.least("c", "hook").alias("c"), "old")
        up = new.select(F.col("v").alias("r_v"), F.col("c").alias("up"))
        new = saved(new.join(up, F.col("c") == F.col("r_v"), "left").select("v", F.least("c", F.coalesce("up", "c")).alias("c"), "old"), name)
        drop(step)
        step = new
        if step.filter("c <> old").isEmpty():
            drop(both)
            return step.select("v", "c")


class Tree:
    """A signature tree: leaves of sets in order of size and a minimum hash, upper nodes of two; each has the OR of its bitmaps and its size range."""

    def __init__(self, sets: list[np.ndarray], bits: int = BITS):
        n = len(sets)
        self.sets, self.size = sets, np.array([len(s) for s in sets])
        low = np.array([int(s[0]) if len(s) else 0 for s in sets], np.uint64)
        self.order = np.lexsort((self.size, low))
        maps = np.zeros((n, bits // 64), np.uint64)
        for i, s in enumerate(sets):
            on = np.zeros(bits, bool)
            on[(s % np.uint64(bits)).astype(np.int64)] = True
            maps[i] = np.packbits(on, bitorder="little").view(np.uint64)
        self.maps, self.spare = maps, self.size - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = []
        groups = [self.order[i : i + LEAF] for i in range(0, n, LEAF)]
        rows = [(np.bitwise_or.reduce(maps[g]), self.size[g].min(), self.size[g].max(), self.spare[g].max()) for g in groups]
        self.leaves = groups
        while True:
            self.levels.append(tuple(np.array(x) for x in zip(*rows)))
            if len(rows) == 1:
                break
            rows = [(np.bitwise_or.reduce([r[0] for r in rows[i : i + 2]]), min(r[1] for r in rows[i : i + 2]), max(r[2] for r in rows[i : i + 2]), max(r[3] for r in rows[i : i + 2])) for i in range(0, len(rows), 2)]

    def pairs(self, t: Fraction) -> Iterator[tuple[int, int]]:
        """Pairs of leaves that may hold a link."""
        a = b = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            maps, least, most, spare = self.levels[depth]
            if depth < len(self.levels) - 1:
                a = np.concatenate([2 * a, 2 * a, 2 * a + 1, 2 * a + 1])
                b = np.concatenate([2 * b, 2 * b + 1, 2 * b, 2 * b + 1])
                ok = (a <= b) & (b < len(maps))
                a, b = a[ok], b[ok]
            keep = []
            for i in range(0, len(a), 8192):
                x, y = a[i : i + 8192], b[i : i + 8192]
                both = np.bitwise_count(maps[x] & maps[y]).sum(axis=1).astype(np.int64) + np.minimum(spare[x], spare[y])
                both = np.minimum(both, np.minimum(most[x], most[y]))
                keep.append((t.denominator + t.numerator) * both >= t.numerator * (least[x] + least[y]))
            keep = np.concatenate(keep) if keep else np.zeros(0, bool)
            a, b = a[keep], b[keep]
        return zip(a.tolist(), b.tolist())


def links(sets: list[np.ndarray], t: Fraction, apart: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join all sets which links connect; with apart, only links between sets of different values of it are looked for.

    Pairs that are joined already aren't verified, and leaves that are one component wholly are skipped.
    """
    if len(sets) < 2:
        return []
    tree, out = Tree(sets), []
    joined = np.arange(len(sets))  # the component of each set so far
    up, down = t.numerator, t.denominator
    for x, y in tree.pairs(t):
        left, right = tree.leaves[x], tree.leaves[y]
        if (joined[left] == joined[left[0]]).all() and (joined[right] == joined[left[0]]).all():
            continue
        for i in left.tolist():
            open_ = joined[right] != joined[i]
            if apart is not None:
                open_ &= apart[right] != apart[i]
            others = right[open_]
            if not len(others):
                continue
            both = np.bitwise_count(tree.maps[others] & tree.maps[i]).sum(axis=1).astype(np.int64) + np.minimum(tree.spare[others], tree.spare[i])
            others = others[(down + up) * np.minimum(both, np.minimum(tree.size[others], tree.size[i])) >= up * (tree.size[others] + tree.size[i])]
            for j in others.tolist():
                if joined[i] == joined[j]:
                    continue
                s = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if down * s >= up * (len(sets[i]) + len(sets[j]) - s):
                    joined[joined == joined[j]] = joined[i]
                    out.append((i, j))
    return out


def _linker(k: int, t: Fraction):
    def link(group: pa.Table) -> pa.Table:
        keys, sets, parts = [], [], []
        seen: set = set()
        for text, part in zip(texts(group.column("text")), group.column("part").to_pylist()):
            h = shingles(text, k)
            key = class_key(h)
            if key not in seen:
                seen.add(key)
                keys.append(key)
                sets.append(h)
                parts.append(part)
        two = len(set(parts)) > 1
        found = links(sets, t, np.array(parts) if two else None)
        u, v = [keys[i] for i, _ in found], [keys[j] for _, j in found]
        return pa.table([pa.array(["%016x%016x" % (a & _ALL, b & _ALL) for a, b in x], pa.string()) for x in (u, v)], names=["u", "v"])

    return link


_ALL = 0xFFFF_FFFF_FFFF_FFFF


def _hex(a: str, b: str):
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def classes_of(docs: DataFrame, doc_id: str, text: str, k: int, t: Fraction) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, key of the class) of each row, written; (key, c) of the classes that have links, c naming their component."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    sketch = rows.select("doc_id", per_text(_sketches(k), "struct<n: bigint, a: bigint, b: bigint>")("text").alias("s"))
    sketch = saved(sketch.select("doc_id", "s.n", F.col("s.a").alias("v"), _hex("s.a", "s.b").alias("key")), "sketches")

    some = rows.filter("text is not null").select("text")
    handle = spark.sparkContext.broadcast(frequent_shingles(some, k, sketch.count()))
    signs = some.mapInArrow(_signed(k, t, handle), "sign bigint, v bigint, u bigint")
    before = F.lag("v").over(Window.partitionBy("sign").orderBy("v"))
    near = signs.select(F.coalesce("u", before).alias("u"), "v").filter("u <> v")
    near = saved(near.distinct(), "near")
    coarse = components(near, "coarse")

    # one text of each class, and the group it belongs to
    heads = sketch.join(coarse, "v").groupBy("key").agg(F.min_by(F.struct("doc_id"), F.struct("doc_id")).alias("head"), F.max("n").alias("n"), F.max("c").alias("c"))
    heads = saved(heads.select("key", "head.doc_id", "n", "c"), "heads")
    drop(near, coarse)
    found = _linked(rows.filter("text is not null"), heads, k, t)
    out = components(found, "linked").withColumnRenamed("v", "key")
    drop(heads, found)
    return sketch, out


def _dealt(heads: DataFrame) -> DataFrame:
    """Classes of groups of several with their block among their group's blocks, each of about BLOCK shingles."""
    size = heads.groupBy("c").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("classes")).filter("classes > 1")
    return heads.join(size.hint("merge"), "c").withColumn("block", F.pmod(F.hash("key"), "blocks"))


def _linked(rows: DataFrame, heads: DataFrame, k: int, t: Fraction) -> DataFrame:
    """Links (u, v) that join all classes of heads (key, doc_id, n, c) which links connect.

    First each block of a group is searched for itself.  Of groups of several blocks one class of each component is compared next, which joins most near
    copies; where components still stand apart, pairs of blocks are searched for links between them.  So the work on one giant group of
    near copies grows with its size, and no link that would join components is lost.
    """

    def search(needed: DataFrame, name: str) -> DataFrame:
        """needed: key, doc_id, c, task, part."""
        needed = needed.select(F.col("doc_id").alias("r_id"), "c", "task", "part")
        # texts are shuffled at every size: the needed ids grow with the input, so they aren't broadcast where they happen to be few
        chosen = rows.join(needed.hint("merge"), F.col("doc_id").eqNullSafe(F.col("r_id"))).select("c", "task", "part", "text")
        return saved(chosen.groupBy("c", "task").applyInArrow(_linker(k, t), "u string, v string"), name)

    one = F.lit("").alias("part")
    dealt = saved(_dealt(heads), "dealt")
    links = search(dealt.select("key", "doc_id", "c", F.col("block").cast("string").alias("task"), one), "links")
    large = dealt.filter("blocks > 1")
    if large.isEmpty():
        drop(dealt)
        return links

    def grouped(links: DataFrame) -> DataFrame:
        """The classes of the large groups with their component so far, and whether the group has several."""
        label = components(links, "part").select(F.col("v").alias("key"), F.col("c").alias("part"))
        out = large.join(label, "key", "left").withColumn("part", F.coalesce("part", "key"))
        several = out.groupBy("c").agg((F.min("part") != F.max("part")).alias("apart"))
        return saved(out.join(several.hint("merge"), "c").filter("apart"), "grouped")

    apart = grouped(links)
    if not apart.isEmpty():
        least = F.min_by(F.struct("key", "doc_id", "n"), "key").alias("head")
        heads_of = _dealt(apart.groupBy("c", "part").agg(least).select("head.*", "c"))
        more = search(heads_of.select("key", "doc_id", "c", F.col("block").cast("string").alias("task"), one), "links")
        links = saved(links.unionByName(more), "links")
        drop(apart, more)
        apart = grouped(links)
    if not apart.isEmpty():
        other = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.concat_ws("-", F.least("block", o).cast("string"), F.greatest("block", o).cast("string")))
        pairs = apart.withColumn("task", F.explode(F.array_remove(other, F.concat_ws("-", F.col("block").cast("string"), F.col("block").cast("string")))))
        links = saved(links.unionByName(search(pairs, "links")), "links")
    drop(apart, dealt)
    return links


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, similarity: Fraction = Fraction(9, 10)) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) of each row of docs.

    Words are cut at ASCII white space, A-Z in lower case.  Texts null, empty or without words have no shingles and no links.  Rows
    of equal sets are linked; rows of one id and other texts are linked by their texts only.  Null ids count as none when
    the smallest is sought.  Shingles are compared by 64-bit hashes.  An empty table gives an empty result.
    """
    sketch, linked = classes_of(docs, doc_id, text, k, similarity)
    heads = sketch.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("least")).join(linked, "key", "left").select("key", "least", F.coalesce("c", "key").alias("c"))
    least = heads.groupBy("c").agg(F.min("least").alias("component_id"))
    named = heads.select("key", "c").join(least, "c").select("key", "component_id")
    out = sketch.join(named, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def distinct(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, similarity: Fraction = Fraction(8, 10)) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id; of several rows of this id, that of the smallest text hash.

    Rows without words (null, empty, blank) all stay; of rows equal in all columns one stays.  An empty table gives an empty result; columns keep
    their names and kinds, whatever they are.
    """
    sketch, linked = classes_of(docs, doc_id, text, k, similarity)
    found = sketch.filter("n > 0").join(linked, "key", "left").select("doc_id", "key", F.coalesce("c", "key").alias("c"))
    keep = found.groupBy("c").agg(F.min_by(F.struct("doc_id", "key"), F.struct("doc_id", "key")).alias("one")).select(F.col("one.doc_id").alias("r_id"), F.col("one.key").alias("r_key"))
    small_batches(docs.sparkSession)
    rows = packed(docs).withColumn("s", per_text(_sketches(k), "struct<n: bigint, a: bigint, b: bigint>")(F.col(f"row.`{text}`")))
    rows = rows.select("row", F.col("s.n").alias("n"), _hex("s.a", "s.b").alias("key"), F.col(f"row.`{doc_id}`").alias("id"))
    kept = rows.filter("n > 0").join(keep, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("key") == F.col("r_key")))
    first = F.struct(F.xxhash64(F.col(f"row.`{text}`")), F.xxhash64(*[F.col(f"row.`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]))
    kept = kept.groupBy("id", "key").agg(F.min_by("row", first).alias("row"))
    return kept.select("row.*").unionByName(rows.filter("n = 0").select("row.*"))


def op6_jaccard(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT rid, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
e AS (SELECT a.rid AS u, b.rid AS v, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY 1, 2),
l AS (SELECT u, v FROM e JOIN n x ON x.rid = u JOIN n y ON y.rid = v WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
k AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
c AS (SELECT rid, rid AS at FROM n UNION SELECT c.rid, k.v FROM c JOIN k ON k.u = c.at)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.least, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (rid) LEFT JOIN (SELECT c.rid, min(t.doc_id) AS least FROM c JOIN d t ON t.rid = c.at GROUP BY 1) m USING (rid)
"""
