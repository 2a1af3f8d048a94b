"""Play, breaks and rallies: runs of samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import COURT, DT, CourtSpec, Play, RallyRule, half_window
from . import geometry, tracks


def _match(keys: tuple = ("match_id",)):
    return Window.partitionBy(*keys).orderBy("k")


def occupancy(track: DataFrame, dt: float = DT, rule: Play = Play()) -> DataFrame:
    """match_id, k, time_s, occupancy: the share of a centred window's samples with two bodies or more."""
    half = half_window(rule.window_s, dt)
    by_sample = track.groupBy("match_id", "k", "time_s").agg(F.min("blobs").alias("blobs"))
    near = _match().rowsBetween(-half, half)
    return by_sample.select("match_id", "k", "time_s", F.avg(F.when(F.col("blobs") >= 2, 1.0).otherwise(0.0)).over(near).alias("occupancy"))


def runs(rows: DataFrame, state: str, keys: tuple = ("match_id",)) -> DataFrame:
    """keys (match_id), run, state, first_k, last_k, start_s, end_s: maximal runs of equal state."""
    turn = rows.withColumn("turn", F.when(F.col(state).eqNullSafe(F.lag(state).over(_match(keys))) & (F.row_number().over(_match(keys)) > 1), 0).otherwise(1))
    return turn.withColumn("run", F.sum("turn").over(_match(keys))).groupBy(*keys, "run").agg(F.first(state).alias(state), F.min("k").alias("first_k"), F.max("k").alias("last_k"), F.min("time_s").alias("start_s"), F.max("time_s").alias("end_s"))


def settled(pieces: list[list], least: float) -> list[list]:
    """Runs [start_s, end_s, state] after short ones take their neighbours' state, again and again.

    Where all runs are short they would change for ever; such runs become one of the state that lasts longer.
    """
    met = set()
    while len(pieces) > 1:
        short = [b - a < least for a, b, _ in pieces]
        if not any(short):
            break
        if all(short) or (key := tuple(map(tuple, pieces))) in met:
            lasted = {s: sum(b - a for a, b, t in pieces if t == s) for s in (True, False)}
            return [[pieces[0][0], pieces[-1][1], lasted[True] >= lasted[False]]]
        met.add(key)
        out: list[list] = []
        for (a, b, state), flip in zip(pieces, short):
            state = state != flip
            if out and out[-1][2] == state:
                out[-1][1] = b
            else:
                out.append([a, b, state])
        pieces = out
    return pieces


def play_segments(track: DataFrame, dt: float = DT, rule: Play = Play()) -> DataFrame:
    """match_id, start_s, end_s, playing.  Only a match's runs, not its samples, meet in one place."""
    found = runs(occupancy(track, dt, rule).withColumn("playing", F.col("occupancy") >= rule.fraction), "playing")
    listed = found.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("start_s", "end_s", "playing"))).alias("runs"))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(m, *x) for m, pieces in zip(b.match_id, b.runs) for x in settled([[p["start_s"], p["end_s"], bool(p["playing"])] for p in pieces], rule.min_segment_s)]
            yield pd.DataFrame(rows, columns=["match_id", "start_s", "end_s", "playing"])

    return listed.mapInPandas(settle, "match_id int, start_s double, end_s double, playing boolean")


def in_play(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """rows with in_play.  A match's segments are few, so they travel as one array by match."""
    listed = segments.filter("playing").groupBy("match_id").agg(F.collect_list(F.struct("start_s", "end_s")).alias("spans"))
    inside = F.exists("spans", lambda s: F.col("time_s").between(s["start_s"], s["end_s"]))
    return rows.join(listed, "match_id", "left").withColumn("in_play", F.coalesce(inside, F.lit(False))).drop("spans")


def suppress_breaks(track: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The track without positions outside play, and match_id, dropped."""
    marked = in_play(track, segments)
    gone = ~F.col("in_play")
    counts = marked.groupBy("match_id").agg(F.sum(F.when(gone & F.col("x").isNotNull(), 1).otherwise(0)).cast("bigint").alias("dropped"))
    return marked.withColumn("x", F.when(~gone, F.col("x"))).withColumn("y", F.when(~gone, F.col("y"))), counts


def resting(track: DataFrame, segments: DataFrame | None = None, dt: float = DT, rule: RallyRule = RallyRule(), court: CourtSpec = COURT) -> DataFrame:
    """match_id, k, time_s, resting: out of play, or of unknown activity, or of less than the quiet speed."""
    act = tracks.activity(track, dt, rule.activity_s)
    act = in_play(act, segments) if segments is not None else act.withColumn("in_play", F.lit(True))
    least = F.lit(rule.quiet_speed)
    if rule.serve_bonus != 1.0:
        ready = geometry.serve_ready(tracks.samples(track), court, rule.box_margin).select("match_id", "k", "ready")
        act = act.join(ready, ["match_id", "k"], "left")
        least = F.when(F.coalesce("ready", F.lit(False)), rule.quiet_speed * rule.serve_bonus).otherwise(rule.quiet_speed)
    return act.select("match_id", "k", "time_s", (~F.col("in_play") | F.col("activity").isNull() | (F.col("activity") < least)).alias("resting"))


_RUNS = pa.schema([("match_id", pa.int32()), ("run", pa.int64()), ("resting", pa.bool_()), ("start_s", pa.float64()), ("end_s", pa.float64())])


class _Rest:
    """A match's runs of rest from its rows in order, a piece at a time: the last steps, samples and run are held, not the match."""

    def __init__(self, match, dt: float, half: int, least: float):
        self.match, self.dt, self.half, self.least = match, dt, half, least
        self.at: dict = {}  # each player's last x, y and whether they are there
        self.rows = None  # those of the last sample, which may go on
        self.sums = [np.zeros(half), np.zeros(half, np.int64), np.zeros(half)]  # of samples' speeds, their number and time, from half a window before those to come
        self.run, self.open = 0, None

    def speeds(self, slot, x, y, there):
        v, ok = np.zeros(len(slot)), np.zeros(len(slot), bool)
        for s in np.unique(slot):
            i = np.flatnonzero(slot == s)
            last = self.at.get(s, (0.0, 0.0, False))
            px, py, was = (np.concatenate([[a], b[i[:-1]]]) for a, b in zip(last, (x, y, there)))
            v[i], ok[i] = np.sqrt((x[i] - px) ** 2 + (y[i] - py) ** 2) / self.dt, there[i] & was
            self.at[s] = x[i[-1]], y[i[-1]], there[i[-1]]
        return np.where(ok, v, 0.0), ok

    def take(self, k, time, slot, x, y, there, end: bool = False) -> list[tuple]:
        """The runs that are over."""
        new = [k, time, slot, x, y, there]
        if self.rows is not None:
            new = [np.concatenate(c) for c in zip(self.rows, new)]
        k, time, slot, x, y, there = new
        first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (time[1:] != time[:-1])])) if len(k) else np.zeros(0, int)
        whole = len(k) if end or not len(k) else first[-1]
        self.rows = [c[whole:] for c in new]
        first = first[first < whole]
        if whole:
            v, ok = self.speeds(slot[:whole], x[:whole], y[:whole], there[:whole])
            self.sums = [np.concatenate(c) for c in zip(self.sums, (np.add.reduceat(v, first), np.add.reduceat(ok.astype(np.int64), first), time[first]))]
        s, n, at = self.sums
        if end:
            s, n = np.concatenate([s, np.zeros(self.half)]), np.concatenate([n, np.zeros(self.half, np.int64)])
        ready = len(s) - 2 * self.half
        if ready <= 0:
            return self.close() if end else []
        total, count = np.zeros(ready), np.zeros(ready, np.int64)
        for i in range(2 * self.half + 1):
            total, count = total + s[i : i + ready], count + n[i : i + ready]
        with np.errstate(invalid="ignore"):
            rest = (count == 0) | (total / np.maximum(count, 1) < self.least)
        out = self.runs(rest, at[self.half : self.half + ready])
        self.sums = [c[ready:] for c in self.sums]
        return out + (self.close() if end else [])

    def runs(self, rest, time) -> list[tuple]:
        cuts = np.concatenate([[0], np.flatnonzero(rest[1:] != rest[:-1]) + 1])
        out = []
        for state, a, b in zip(rest[cuts].tolist(), np.fmin.reduceat(time, cuts).tolist(), np.fmax.reduceat(time, cuts).tolist()):
            if self.open and self.open[0] == state:
                self.open = state, np.fmin(self.open[1], a), np.fmax(self.open[2], b)
            else:
                out += self.close()
                self.open = state, a, b
        return out

    def close(self) -> list[tuple]:
        if not self.open:
            return []
        self.run += 1
        (state, a, b), self.open = self.open, None
        return [(self.match, self.run, state, a, b)]


def rest_runs(track: DataFrame, dt: float = DT, rule: RallyRule = RallyRule()) -> DataFrame:
    """runs() of resting(), by match: each player's steps, the samples' activity and its runs in one walk through sorted partitions.

    Speeds of a window are added in the order of its samples, as there.  Serves make no difference here.
    """
    half = half_window(rule.activity_s, dt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for b in batches:
            if not b.num_rows:
                continue
            m = b.column("match_id")
            new = np.zeros(b.num_rows, bool)
            for c in (m.fill_null(0).to_numpy(zero_copy_only=False), m.is_null().to_numpy(zero_copy_only=False)):
                new[1:] |= c[1:] != c[:-1]
            there = ~(b.column("x").is_null().to_numpy(zero_copy_only=False) | b.column("y").is_null().to_numpy(zero_copy_only=False))
            cols = [*(b.column(c).to_numpy(zero_copy_only=False) for c in ("k", "time_s", "slot", "x", "y")), there]
            out, cuts = [], [0, *np.flatnonzero(new).tolist(), b.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if walk is None or walk.match != m[i].as_py():
                    out += walk.take(*[c[:0] for c in cols], end=True) if walk else []
                    walk = _Rest(m[i].as_py(), dt, half, rule.quiet_speed)
                out += walk.take(*[c[i:j] for c in cols])
            if out:
                yield table(out)
        if walk and (out := walk.take(*[c[:0] for c in cols], end=True)):
            yield table(out)

    def table(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_RUNS)], schema=_RUNS)

    parts = track.select("match_id", "k", "time_s", "slot", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).repartition("match_id").sortWithinPartitions("match_id", "k", "time_s", "slot")
    return parts.mapInArrow(run, "match_id int, run bigint, resting boolean, start_s double, end_s double")


def breaks(rest: DataFrame, rule: RallyRule = RallyRule(), keys: tuple = ("match_id",), least=None) -> DataFrame:
    """keys (match_id), start_s, end_s: runs of rest that last long enough; least may be a column of keys."""
    least = F.lit(rule.min_break) if least is None else least
    return runs(rest, "resting", keys).filter(F.col("resting") & (F.col("end_s") - F.col("start_s") >= least)).select(*keys, "start_s", "end_s")


def rallies(rest: DataFrame, rule: RallyRule = RallyRule(), keys: tuple = ("match_id",), least=None) -> DataFrame:
    """keys (match_id), rally_index, start_s, end_s: what the breaks leave, where it lasts long enough."""
    return between(runs(rest, "resting", tuple(keys)), rule, keys, least)


def between(found: DataFrame, rule: RallyRule = RallyRule(), keys: tuple = ("match_id",), least=None) -> DataFrame:
    """rallies() from runs of rest."""
    keys = list(keys)
    least = F.lit(rule.min_break) if least is None else least
    match = Window.partitionBy(*keys)
    found = found.dropna(subset=keys).withColumns({"lo": F.min("start_s").over(match), "hi": F.max("end_s").over(match), "nth": F.row_number().over(match.orderBy("run"))})
    # the match's end closes the last gap; it goes with the first run, so rest is read once
    rests = F.when(F.col("resting") & (F.col("end_s") - F.col("start_s") >= least), F.struct("start_s", "end_s"))
    last = F.when(F.col("nth") == 1, F.struct(F.col("hi").alias("start_s"), F.lit(None).cast("double").alias("end_s")))
    edges = found.withColumn("edge", F.explode(F.array_compact(F.array(rests, last)))).select(*keys, "lo", "edge.start_s", "edge.end_s")
    order = match.orderBy("start_s", F.col("end_s").asc_nulls_last())
    gaps = edges.select(*keys, F.coalesce(F.lag("end_s").over(order), F.col("lo")).alias("start_s"), F.col("start_s").alias("end_s"))
    kept = gaps.filter(F.col("end_s") - F.col("start_s") >= rule.min_rally)
    return kept.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("start_s")) - 1).cast("int").alias("rally_index"), "start_s", "end_s")


def excluding(track: DataFrame, lo: float, hi: float) -> DataFrame:
    """The track outside [lo, hi), with piece 0 before and 1 after."""
    return track.filter((F.col("time_s") < lo) | (F.col("time_s") >= hi)).withColumn("piece", F.when(F.col("time_s") < lo, 0).otherwise(1))


def within_span(track: DataFrame, lo: float, hi: float) -> DataFrame:
    """The track inside [lo, hi)."""
    return track.filter((F.col("time_s") >= lo) & (F.col("time_s") < hi))
