"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to).  Each pattern offers its words once for
nothing, again at cost 1, a third time at cost 2 and so on (convex repetition costs); each source takes words up to its quota.  The
cheapest largest flow says how many words each pattern gives.  Which documents give them is settled by a seeded hash.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table

SEED = 7
#: Weights of the sources by code point, repeating.
WEIGHTS = (3, 1, 2)
#: Membership patterns that the driver routes at most; more is an error, not a cut.
MAX_PATTERNS = 100_000


class Flow:
    """Min-cost flow by successive shortest paths with potentials, in whole numbers."""

    def __init__(self):
        self.arcs: dict = defaultdict(list)
        self.to, self.free, self.cost = [], [], []

    def arc(self, a, b, room: int, cost: int = 0) -> int:
        for u, v, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.arcs[u].append(len(self.to))
            self.to.append(v)
            self.free.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, start, end) -> tuple[int, int]:
        """The largest flow and its least cost."""
        high, flow, paid = defaultdict(int), 0, 0
        while True:
            far, by, heap = {start: 0}, {}, [(0, 0, start)]
            n = 0
            while heap:
                d, _, u = heapq.heappop(heap)
                if d > far[u]:
                    continue
                for e in self.arcs[u]:
                    v = self.to[e]
                    if self.free[e] and (x := d + self.cost[e] + high[u] - high[v]) < far.get(v, float("inf")):
                        far[v], by[v] = x, e
                        heapq.heappush(heap, (x, n := n + 1, v))
            if end not in far:
                return flow, paid
            for v in list(self.arcs):
                high[v] += min(far.get(v, far[end]), far[end])
            v, room = end, float("inf")
            while v != start:
                room = min(room, self.free[by[v]])
                v = self.to[by[v] ^ 1]
            v = end
            while v != start:
                self.free[by[v]] -= room
                self.free[by[v] ^ 1] += room
                paid += room * self.cost[by[v]]
                v = self.to[by[v] ^ 1]
            flow += room


def route(patterns: dict[tuple, int], quotas: dict, copies: int = 2) -> dict[tuple[tuple, object], int]:
    """Words each pattern gives each of its sources.  Patterns that share no source are routed apart."""
    group = {s: s for s in quotas}

    def root(s):
        while group[s] != s:
            group[s] = group[group[s]]
            s = group[s]
        return s

    for p in patterns:
        for s in p[1:]:
            group[root(s)] = root(p[0])
    parts = defaultdict(list)
    for p in patterns:
        if p:
            parts[root(p[0])].append(p)
    out = {}
    for members in parts.values():
        net, marks = Flow(), {}
        for p in members:
            for k in range(copies):
                net.arc("start", ("p", p), patterns[p], k)
            for s in p:
                marks[p, s] = net.arc(("p", p), ("s", s), copies * patterns[p])
        for s in {s for p in members for s in p}:
            net.arc(("s", s), "end", quotas[s])
        net.run("start", "end")
        out |= {k: net.free[e ^ 1] for k, e in marks.items()}
    return out


def targets(sizes: dict, weights=WEIGHTS, share: tuple[int, int] = (3, 2), copies: int = 2) -> dict:
    """Each source's target: its part by weight of share (a fraction) of all sizes, at most copies times its own size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    up, down = share
    total, full = sum(sizes.values()), set()
    while True:
        rest = up * total - down * copies * sum(sizes[s] for s in full)  # times `down`
        w = sum(weight[s] for s in order if s not in full)
        above = {s for s in order if s not in full and rest * weight[s] > copies * sizes[s] * down * w}
        if not above:
            return {s: float(copies * sizes[s]) if s in full else rest * weight[s] / (down * w) for s in order}
        full |= above


def words(text):
    """Number of `[^\\x20\\x09-\\x0D]+` in the text; 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("bigint")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sources=None, copies: int = 2, seed: int = SEED, keep: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs; with keep, docs' own columns (but for any of
    those names) come first instead of doc_id.

    sources: an array column of the sources a row belongs to (default: the column `source` alone; null is a source, an empty
    array belongs to none and isn't taken).  source_size and target are sums over a row's sources.
    A row is taken size times a whole number of copies, and by a seeded hash of its id once more; the rows of the one hash value
    at which the quota ends share what is left in proportion, so that a source's taken words miss its target by less than one word for
    each of them.  Null ids hash alike; repeated rows are rows of their own and are treated alike.  Null or empty texts have
    size 0 and are taken 0 times.  An empty table gives an empty result.

    One scan of the texts; sums are taken by pattern and hash prefix, 256 prefixes at each of four levels, so no task
    sees the rows of a whole source.
    """
    spark = docs.sparkSession
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken")]
    sources = F.array(F.col("source")) if sources is None else sources
    name = F.transform(F.sort_array(F.array_distinct(sources)), lambda s: F.coalesce(F.concat(F.lit("s"), s.cast("string")), F.lit("n")))
    cell = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("bigint")
    sized = docs.select(F.struct(*(own if keep else [F.col(f"`{doc_id}`")])).alias("row"), name.alias("pattern"), words(F.col(f"`{text}`")).alias("size"), cell.alias("cell"))
    sized = saved(sized, "sized")

    found = sized.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r["pattern"]): r["size"] for r in found}
    sizes: dict = defaultdict(int)
    for p, n in patterns.items():
        for s in p:
            sizes[None if s == "n" else s[1:]] += n
    goal = targets(dict(sizes), copies=copies) if sizes else {}
    coded = lambda s: "n" if s is None else "s" + s
    given: dict = defaultdict(int)
    for (p, _), n in route(patterns, {coded(s): int(t) for s, t in goal.items()}, copies).items():
        given[p] += n
    plain = lambda s: None if s == "n" else s[1:]
    rows = [(list(p), sum(sizes[plain(s)] for s in p), float(sum(goal[plain(s)] for s in p)), given[p] // n if n else 0, given[p] % n if n else 0) for p, n in patterns.items()]
    plan = spark.createDataFrame(rows, "pattern array<string>, source_size bigint, target double, whole bigint, quota bigint")

    # the hash value at which each pattern's quota ends, one byte at a time
    edge = plan.select("pattern", F.col("quota").alias("left"), F.lit(0).cast("bigint").alias("prefix"))
    here = sized.select("pattern", "size", "cell")
    for level in range(4):
        shift = 24 - 8 * level
        part = here if level == 0 else here.join(F.broadcast(edge.select("pattern", F.col("prefix").alias("at"))), "pattern").filter(F.shiftright("cell", shift + 8) == F.col("at"))
        sums = part.groupBy("pattern", F.shiftright("cell", shift).alias("prefix")).agg(F.sum("size").alias("sum"))
        upto = F.sum("sum").over(Window.partitionBy("pattern").orderBy("prefix"))
        edge = sums.withColumn("upto", upto).join(F.broadcast(edge.select("pattern", "left")), "pattern").filter((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("sum") <= F.col("left")))
        edge = edge.select("pattern", (F.col("left") - F.col("upto") + F.col("sum")).alias("left"), "prefix", F.col("sum").alias("there"))
    plan = plan.join(edge, "pattern", "left")
    partial = F.when(F.col("quota") == 0, 0).when(F.col("cell") < F.col("prefix"), F.col("size")).when(F.col("cell") == F.col("prefix"), F.expr("size * `left` div there")).otherwise(0)
    out = sized.join(F.broadcast(plan), "pattern")
    return out.select("row.*", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.coalesce(partial, F.lit(0))).cast("bigint").alias("taken"))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def mixed_sql(documents: str) -> str:
    """mix()'s rows over a relation with doc_id, text and source, in DuckDB's SQL."""
    return f"""
d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
      CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS cell FROM {documents}),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w,
       CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s0),
s2 AS (SELECT *, CAST(coalesce(sum(source_size) OVER o, 0) AS BIGINT) AS before, CAST(sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest
       FROM s1 WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (3 * total - 4 * before) * w > 4 * source_size * rest AS is_full FROM s2),
s4 AS (SELECT *, (SELECT coalesce(sum(source_size), 0) FROM s3 WHERE is_full) AS f, (SELECT sum(w) FROM s3 WHERE NOT is_full) AS wr FROM s3),
s AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(2 * source_size AS DOUBLE) ELSE CAST((3 * total - 4 * f) * w AS DOUBLE) / CAST(2 * wr AS DOUBLE) END AS target FROM s4),
q AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) // source_size END AS whole, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) % source_size END AS quota FROM s),
c AS (SELECT source, cell, CAST(sum(size) AS BIGINT) AS there FROM d GROUP BY source, cell),
e AS (SELECT source, cell, there, CAST(sum(there) OVER (PARTITION BY source ORDER BY cell) AS BIGINT) - there AS upto FROM c),
mixed AS (SELECT d.doc_id, d.size, q.source_size, q.target,
       CAST(whole * size + CASE WHEN upto + e.there <= quota THEN size WHEN upto < quota THEN size * (quota - upto) // e.there ELSE 0 END AS BIGINT) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.cell = e.cell)"""


ORACLE = f"WITH {mixed_sql('documents')} SELECT * FROM mixed"
