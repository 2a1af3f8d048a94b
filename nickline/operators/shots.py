"""Shots: excursions from the middle of the court, attributed by server and alternation."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import COURT, CourtSpec, RallyRule, ShotRule
from . import geometry, tracks

RALLY = ["match_id", "rally_index"]


#: Seconds of a stretch of time, within which rows look for their rally.
STRETCH = 30.0


def within(rows: DataFrame, rallies: DataFrame) -> DataFrame:
    """rows (match_id, time_s, …) with the rally_index whose [start_s, end_s) holds them; of several the first.

    Time is cut into stretches, and a rally stands in each that it reaches into, so this is no theta join and a row's work doesn't grow with
    its match.  A rally owns its time from where the ones that begin before it have all ended, so no row meets two.
    """
    stretch = lambda c: F.floor(F.col(c) / STRETCH)
    earlier = Window.partitionBy("match_id").orderBy("start_s", "end_s", "rally_index").rowsBetween(Window.unboundedPreceding, -1)
    own = rallies.filter("start_s < end_s").select("match_id", "rally_index", F.greatest("start_s", F.max("end_s").over(earlier)).alias("_lo"), F.col("end_s").alias("_hi")).filter("_lo < _hi")
    reached = own.withColumn("_b", F.explode(F.sequence(stretch("_lo"), stretch("_hi"))))
    met = rows.withColumn("_b", stretch("time_s")).join(reached, ["match_id", "_b"]).filter("time_s >= _lo AND time_s < _hi")
    return met.select(*[F.col(c) for c in rows.columns], "rally_index")


def range_smooth(rows: DataFrame, value: str = "radial", window_s: float = ShotRule.smooth_s) -> DataFrame:
    """rows with smooth, the mean of the values at most half a window away within the rally, on whole milliseconds."""
    half = int(round(window_s * 500))
    near = Window.partitionBy(*RALLY, "slot").orderBy("ms").rangeBetween(-half, half)
    timed = rows.withColumn("ms", F.round(F.col("time_s") * 1000).cast("bigint"))
    return timed.withColumn("smooth", F.when(F.col(value).isNotNull(), F.avg(value).over(near))).drop("ms")


def local_peaks(rows: DataFrame, value: str = "smooth") -> DataFrame:
    """Rows whose value is no smaller than those before and after it, missing ones aside."""
    order = Window.partitionBy(*RALLY, "slot").orderBy("k")
    v = F.col(value)
    return rows.filter(v.isNotNull()).withColumn("before", F.lag(value).over(order)).withColumn("after", F.lead(value).over(order)).filter((v >= F.col("before")) & (v >= F.col("after"))).drop("before", "after")


def prominences(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of interior local maxima, their prominences): a stack of larger values gives the minimum back to the last of them.

    Only the maxima and both ends walk the stack, each with the minimum of the stretch to the next: between two of them a slope's values are no limits.
    """

    def lowest(top: list[float], between: list[float]) -> np.ndarray:
        out, stack = [], []
        for a, low in zip(top, [np.inf, *between]):
            low = min(a, low)
            while stack and stack[-1][0] <= a:
                low = min(low, stack.pop()[1])
            out.append(low)
            stack.append((a, low))
        return np.array(out)

    at = np.flatnonzero((v[1:-1] >= v[:-2]) & (v[1:-1] >= v[2:])) + 1 if len(v) > 2 else np.zeros(0, int)
    if not len(at):
        return at, np.zeros(0)
    nodes = np.concatenate([[0], at, [len(v) - 1]])
    top, between = v[nodes].tolist(), np.minimum.reduceat(v, nodes)[:-1].tolist()
    low = np.maximum(lowest(top, between), lowest(top[::-1], between[::-1])[::-1])
    return at, v[at] - low[1:-1]


def suppressed(times: np.ndarray, strength: np.ndarray, gap: float) -> np.ndarray:
    """Places kept when peaks are taken from the strongest and those too near a kept one are dropped."""
    kept: list[int] = []
    at: list[float] = []  # the kept ones' times, sorted: only the two around a peak can be the nearest
    for i in np.argsort(-strength, kind="stable"):
        n = bisect(at, times[i])
        if all(abs(times[i] - t) >= gap for t in at[max(0, n - 1) : n + 1]):
            kept.append(i)
            at.insert(n, times[i])
    return np.sort(np.array(kept, int))


_PEAKS = pa.schema([("match_id", pa.int32()), ("rally_index", pa.int32()), ("slot", pa.int32()), ("time_s", pa.float64()), ("prominence", pa.float64())])


def _grouped(rows: DataFrame, value: str, fn) -> DataFrame:
    """fn(times, values) gives (times, prominences) for each rally and player, streamed from sorted partitions; one rally's samples are held at a time."""
    keys = [*RALLY, "slot"]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
        held, last = [], None
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            for c in b.columns[:3]:
                for x in (c.fill_null(0).to_numpy(zero_copy_only=False), c.is_null().to_numpy(zero_copy_only=False)):
                    new[1:] |= x[1:] != x[:-1]
            t, v = (b.column(n).to_numpy(zero_copy_only=False) for n in (3, 4))
            cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:]):
                key = tuple(c[i].as_py() for c in b.columns[:3])
                if held and key != last:
                    yield last, *(np.concatenate(x) for x in zip(*held))
                    held = []
                held.append((t[i:j], v[i:j]))
                last = key
        if held:
            yield last, *(np.concatenate(x) for x in zip(*held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for key, t, v in groups(batches):
            there = ~np.isnan(v)
            out.append((key, *fn(t[there], v[there])))
            n += len(out[-1][1])
            if n >= 10_000:
                yield table(out)
                out, n = [], 0
        if n:
            yield table(out)

    def table(found: list) -> pa.RecordBatch:
        names = [pa.array([key[i] for key, t, _ in found for _ in range(len(t))], pa.int32()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*names, *(pa.array(np.concatenate([f[i] for f in found]), pa.float64()) for i in (1, 2))], schema=_PEAKS)

    parts = rows.select(*[F.col(c).cast("int").alias(c) for c in keys], "time_s", F.col(value).cast("double").alias("value"), "k").repartition(*keys).sortWithinPartitions(*keys, "k")
    return parts.mapInArrow(run, "match_id int, rally_index int, slot int, time_s double, prominence double")


def prominent(rows: DataFrame, value: str = "smooth", least: float = ShotRule.prominence) -> DataFrame:
    """match_id, rally_index, slot, time_s, prominence of the peaks that stand out enough."""

    def fn(t, v):
        at, p = prominences(v)
        return t[at][p >= least], p[p >= least]

    return _grouped(rows, value, fn)


def candidates(rows: DataFrame, value: str = "smooth", rule: ShotRule = ShotRule()) -> DataFrame:
    """prominent() after suppression of the weaker of peaks too near each other."""

    def fn(t, v):
        at, p = prominences(v)
        at, p = at[p >= rule.prominence], p[p >= rule.prominence]
        kept = suppressed(t[at], p, rule.gap_s)
        return t[at][kept], p[kept]

    return _grouped(rows, value, fn)


def servers(track: DataFrame, rallies: DataFrame, rule: ShotRule = ShotRule(), court: CourtSpec = COURT, margin: float = RallyRule.box_margin) -> DataFrame:
    """match_id, rally_index, server: who serves in the first sample, of the rally's first seconds, that shows a serve."""
    rows = within(track, rallies)
    begun = rows.groupBy(*RALLY).agg(F.min("time_s").alias("t0"))
    early = rows.join(begun, RALLY).filter(F.col("time_s") <= F.col("t0") + rule.anchor_s)  # few, so only these meet their samples' others
    seen = geometry.serve_ready(tracks.samples(early, RALLY), court, margin)
    return seen.filter("ready").groupBy(*RALLY).agg(F.min_by("server", "k").alias("server"))


def alternated(found: DataFrame, server: DataFrame) -> DataFrame:
    """found with taken: strict alternation from the server, or from the first candidate's player.

    From the first candidate of that player on, alternation takes the first of each run of one player, so it needs no recurrence.
    """
    order = Window.partitionBy(*RALLY).orderBy("time_s", "slot")
    rows = found.join(server, RALLY, "left").withColumn("starts", F.coalesce("server", F.first("slot").over(order)))
    rows = rows.withColumn("begun", F.max(F.when(F.col("slot") == F.col("starts"), 1).otherwise(0)).over(order))
    rows = rows.withColumn("taken", (F.col("begun") == 1) & ~F.coalesce((F.lag("slot").over(order) == F.col("slot")) & (F.lag("begun").over(order) == 1), F.lit(False)))
    return rows.drop("starts", "begun")


def shots(track: DataFrame, rallies: DataFrame, rule: ShotRule = ShotRule(), court: CourtSpec = COURT) -> tuple[DataFrame, DataFrame]:
    """(match_id, rally_index, time_s, player, position_x_m, position_y_m, source) and each rally's diagnostics.

    Alternation goes on where a shot has no position; such a shot isn't a row.
    """
    rows = range_smooth(within(tracks.radial(track, court), rallies), "radial", rule.smooth_s)
    turns = alternated(candidates(rows, "smooth", rule), servers(track, rallies, rule, court))
    spots = track.select("match_id", "slot", "time_s", "x", "y").filter("x is not null")
    taken = turns.filter("taken").join(spots, ["match_id", "slot", "time_s"])  # a candidate's time is a sample's, and the time names its rally
    out = taken.select("match_id", "rally_index", F.bround("time_s", 2).alias("time_s"), F.col("slot").alias("player"), F.col("x").alias("position_x_m"), F.col("y").alias("position_y_m"), F.lit("radial_peak").alias("source"))
    counts = turns.groupBy(*RALLY).agg(F.count("*").alias("candidates"), F.sum(F.when(F.col("taken"), 0).otherwise(1)).cast("bigint").alias("dropped"), F.max(F.col("server").isNotNull()).alias("anchored"))
    stats = rallies.withColumn("duration", F.col("end_s") - F.col("start_s")).join(counts, RALLY, "left")
    return out, stats.select(*RALLY, "duration", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("dropped", F.lit(0)).alias("dropped"), F.coalesce("anchored", F.lit(False)).alias("anchored"))


def shot_summary(found: DataFrame) -> DataFrame:
    """match_id, shots, rallies, median_interval of one match."""
    order = Window.partitionBy(*RALLY).orderBy("time_s")
    gaps = found.withColumn("gap", F.col("time_s") - F.lag("time_s").over(order))
    return gaps.groupBy("match_id").agg(F.count("*").alias("shots"), F.countDistinct("rally_index").alias("rallies"), F.percentile("gap", 0.5).alias("median_interval"))
