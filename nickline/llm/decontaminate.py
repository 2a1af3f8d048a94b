"""Benchmark decontamination with one Aho-Corasick automaton (for each block of a benchmark too large for one).

The automaton holds every window of 13 consecutive words of every benchmark item (an item of fewer words is one window).
A text is normalised to its words between single spaces, scanned once, and every occurrence is mapped back to word
numbers and to offsets in the original text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, alnum_words, drop, packed, per_text, saved, small_batches, table, texts

WINDOW = 13
#: Characters of the windows that share one automaton, which has no more nodes; a larger benchmark is scanned in blocks, one after another.
#: 4,200,000 nodes took 168 MB.
BLOCK_NODES = 6_000_000

_built: dict = {}


def automaton(items: list[tuple[str, bytes]], window: int):
    """The automaton over the items' windows: each has the numbers of its items and its length in words."""
    found: dict[str, tuple[int, set[int]]] = {}
    for k, (_, text) in enumerate(items):
        words = alnum_words(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            key = f" {b' '.join(words[i : i + n]).decode('latin-1')} "
            found.setdefault(key, (n, set()))[1].add(k)
    out = ahocorasick.Automaton()
    for key, (n, which) in found.items():
        out.add_word(key, (n, tuple(sorted(which))))
    if found:
        out.make_automaton()
    return out if found else None


def occurrences(text: bytes, search) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Number of words, merged spans of hit words [first, end), items whose windows occur."""
    words = text.translate(ALNUM).split()
    if search is None or not words:
        return len(words), [], set()
    line = f" {b' '.join(words).decode('latin-1')} "
    spans, which, starts = [], set(), None
    for end, (n, items) in search.iter(line):
        if starts is None:
            starts = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        last = int(np.searchsorted(starts, end))  # the space at `end` follows word number last - 1
        spans.append((last - n, last))
        which.update(items)
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], b))
        else:
            merged.append((a, b))
    return len(words), merged, which


def original(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as code point offsets of the original text."""
    if not spans:
        return []
    clean = np.frombuffer(text.translate(ALNUM), np.uint8)
    word = np.concatenate([[False], clean != 32, [False]])
    first, end = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    points = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return [(int(points[first[a]]) - 1, int(points[end[b - 1] - 1])) for a, b in spans]


SCHEMA = "struct<n_words: bigint, spans: array<struct<first: bigint, end: bigint>>, chars: array<struct<first: bigint, end: bigint>>, items: array<string>>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _search(key: str, items: list, window: int):
    """The automaton, built once in a Python worker."""
    if key not in _built:
        if len(_built) > 1:
            _built.clear()
        _built[key] = automaton(items, window)
    return _built[key]


def _scanner(handle, window: int, offsets: bool):
    key = uuid.uuid4().hex

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        search, names = _search(key, handle.value, window), [k for k, _ in handle.value]
        for column in batches:
            n, spans, chars, items = [], [], [], []
            for text in texts(column):
                count, merged, which = occurrences(text, search)
                n.append(count)
                spans.append([{"first": a, "end": b} for a, b in merged])
                chars.append([{"first": a, "end": b} for a, b in original(text, merged)] if offsets else [])
                items.append([names[k] for k in which])
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(spans, _SPANS), pa.array(chars, _SPANS), pa.array(items, pa.list_(pa.string()))],
                names=["n_words", "spans", "chars", "items"],
            )

    return per_text(scan, SCHEMA)


def _blocks(benchmark: DataFrame, item_id: str, text: str, window: int, nodes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks whose windows have about so many characters; an item of more is cut into parts that overlap by a window less a word."""
    block, n = [], 0
    for k, t in benchmark.select(F.col(f"`{item_id}`").cast("string"), F.col(f"`{text}`")).orderBy(F.col(f"`{item_id}`")).toLocalIterator():
        words = alnum_words((t or "").encode())
        size = np.cumsum([0, *(len(w) + 1 for w in words)])
        at = 0
        while at < len(words):
            # windows from word `at` on, as many as the block still takes, one at least
            starts = max(1, len(words) - window + 1)
            cost = np.cumsum(size[np.minimum(np.arange(at, starts) + window, len(words))] - size[at:starts] + 1)
            take = max(1, int(np.searchsorted(cost, nodes - n, "right")))
            block.append((k if k is not None else "", b" ".join(words[at : at + take + window - 1])))
            n += int(cost[min(take, len(cost)) - 1])
            at += take
            if at >= starts:
                at = len(words)
            if n >= nodes or at < len(words):
                yield block
                block, n = [], 0
    if block:
        yield block


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_nodes: int = BLOCK_NODES, offsets: bool = True) -> DataFrame:
    """Each row of docs as the struct `row`, with n_words, spans (of hit words), chars (the same in code points of the
    original) and items (ids as strings).

    The automaton goes to the executors as items, a block at a time.  Blocks are scanned one after another: what a block found is written
    with the rows before the next one is sent, so a worker holds one automaton, whatever the benchmark's size, and no shuffle is needed.
    A null or empty text has no words.  Repeated rows and ids are scored each for itself; repeated items count once for
    each distinct id; items without words and an empty benchmark hit nothing.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out, last = packed(docs), None
    blocks = _blocks(benchmark, item_id, item_text, window, block_nodes)
    block, following = next(blocks, []), next(blocks, None)
    while True:
        found = out.withColumn("new", _scanner(spark.sparkContext.broadcast(block), window, offsets)(F.col(f"row.`{text}`")))
        if last is not None:
            both = [_merged(F.concat(f"found.{c}", f"new.{c}")).alias(c) for c in ("spans", "chars")]
            found = found.select("row", F.struct(F.col("new.n_words").alias("n_words"), *both, F.concat("found.items", "new.items").alias("items")).alias("found"))
        else:
            found = found.withColumnRenamed("new", "found")
        if following is None:
            return found.select("row", "found.n_words", "found.spans", "found.chars", F.array_sort(F.array_distinct("found.items")).alias("items"))
        out = saved(found, "scanned")
        if last is not None:
            drop(last)
        last, block, following = out, following, next(blocks, None)


def _merged(spans):
    """The union of sorted spans."""
    kind = "array<struct<first: bigint, end: bigint>>"

    def step(acc, x):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["first"].alias("first"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (x["first"] <= F.try_element_at(acc, F.lit(-1))["end"]), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), step)


def judged(found: DataFrame) -> DataFrame:
    """scan()'s rows with n_hit, n_items, items_sha256 and contaminated: at least a twentieth of the words are hit.  A text without words isn't."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["first"])
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("bigint"))
        .withColumn("items_sha256", F.sha2(F.concat_ws(",", "items"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = judged(scan(docs, table(spark, sf_dir, "benchmark"), offsets=False))
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that aren't contaminated, with their own columns.  Null and empty texts and all rows against an empty benchmark stay; repeated rows share a fate."""
    return judged(scan(docs, benchmark, text, offsets=False)).filter(~F.col("contaminated")).select("row.*")


_WORDS = "list_filter(string_split_regex(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS.format('text')} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format('text')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {WINDOW - 1}, 1))) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, ns WHERE len(w) >= n)),
m AS (SELECT rid, i, bw.n, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
