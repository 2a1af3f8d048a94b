"""Smoothing and kinematics of tracks (match_id, slot, k, time_s, x, y), one row for each sample and player."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import COURT, DT, CourtSpec, RallyRule, Smoothing, half_window


def _player(keys: tuple = ("match_id",)):
    return Window.partitionBy(*keys, "slot").orderBy("k")


def _step(keys: tuple = ("match_id",)):
    back = lambda c: F.lag(c).over(_player(keys))
    return F.sqrt(F.pow(F.col("x") - back("x"), 2) + F.pow(F.col("y") - back("y"), 2))


def median_filter(track: DataFrame, window: int = Smoothing.window) -> DataFrame:
    """x and y as the medians of a centred window of rows; missing positions stay missing and don't count."""
    near = _player().rowsBetween(-(window // 2), window // 2)
    middle = lambda c: F.when(F.col("x").isNotNull(), F.percentile(c, 0.5).over(near)).alias(c)
    return track.select(*[c for c in track.columns if c not in ("x", "y")], middle("x"), middle("y"))


class _Path:
    """One player's alpha-beta filter: a gated momentum estimate that coasts over short gaps."""

    def __init__(self, alpha: float, dt: float, rule: Smoothing):
        self.alpha, self.beta, self.dt, self.rule = alpha, alpha * alpha / (2 - alpha), dt, rule
        self.at = self.seen = None
        self.speed, self.rejected, self.coasted = (0.0, 0.0), 0, 0

    def _ahead(self):
        return self.at[0] + self.speed[0] * self.dt, self.at[1] + self.speed[1] * self.dt

    def _seed(self, z):
        self.at = self.seen = z
        self.speed, self.rejected = (0.0, 0.0), 0

    def __call__(self, z):
        """(position or None, measured)"""
        if z is None:
            if self.at is not None and self.coasted < self.rule.gap_coast:
                self.coasted += 1
                self.at = self._ahead()
                return self.at, False
            self._seed(None)
            return None, False
        self.coasted = 0
        if self.at is None:
            self._seed(z)
            return z, True
        if math.dist(z, self.seen) > self.rule.max_speed * self.dt:
            self.rejected += 1
            if self.rejected <= self.rule.max_rejects:
                self.at = self._ahead()
                return self.at, False
            self._seed(z)
            return None, False
        self.rejected, self.seen = 0, z
        px, py = self._ahead()
        rx, ry = z[0] - px, z[1] - py
        self.at = (px + self.alpha * rx, py + self.alpha * ry)
        vx, vy = self.speed[0] + self.beta * rx / self.dt, self.speed[1] + self.beta * ry / self.dt
        fast = math.hypot(vx, vy)
        if fast > self.rule.max_speed:
            vx, vy = vx * self.rule.max_speed / fast, vy * self.rule.max_speed / fast
        self.speed = (vx, vy)
        return self.at, True


def alpha_beta(track: DataFrame, alpha: float | None = Smoothing.alpha, dt: float = DT, rule: Smoothing = Smoothing()) -> DataFrame:
    """match_id, slot, k, time_s, x, y, solid: the filtered path of each player; solid marks measured positions.

    The filter is a recurrence, so a player's samples run through one state machine in order, streamed in batches from partitions
    that are sorted by player and sample.  alpha None passes tracks through.
    """
    if alpha is None:
        return track.select("match_id", "slot", "k", "time_s", "x", "y", F.col("x").isNotNull().alias("solid"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, path = None, None
        for b in batches:
            out = []
            for m, s, x, y in zip(b.match_id, b.slot, b.x, b.y):
                if (m, s) != who:
                    who, path = (m, s), _Path(alpha, dt, rule)
                p, solid = path(None if math.isnan(x) else (x, y))
                out.append((*(p or (None, None)), solid))
            x, y, solid = zip(*out) if out else ((), (), ())
            yield pd.DataFrame({"match_id": b.match_id, "slot": b.slot, "k": b.k, "time_s": b.time_s, "x": pd.array(x, "Float64"), "y": pd.array(y, "Float64"), "solid": list(solid)})

    parts = track.select("match_id", "slot", "k", "time_s", "x", "y").repartition("match_id", "slot").sortWithinPartitions("match_id", "slot", "k")
    return parts.mapInPandas(run, "match_id int, slot int, k bigint, time_s double, x double, y double, solid boolean")


def smoothed(track: DataFrame, alpha: float | None = Smoothing.alpha, dt: float = DT, rule: Smoothing = Smoothing()) -> DataFrame:
    """The median filter, then the alpha-beta filter."""
    return alpha_beta(track if alpha is None else median_filter(track, rule.window), alpha, dt, rule)


def distance_covered(track: DataFrame, dt: float = DT, max_speed: float = Smoothing.max_speed) -> DataFrame:
    """match_id, slot, metres: the sum of steps that a player could have made; a gap breaks the chain."""
    steps = track.withColumn("step", _step())
    return steps.groupBy("match_id", "slot").agg(F.coalesce(F.sum(F.when(F.col("step") <= max_speed * dt, F.col("step"))), F.lit(0.0)).alias("metres"))


def peak_speed(track: DataFrame, dt: float = DT) -> DataFrame:
    """match_id, slot, peak: the highest implied speed; 0 where there is none."""
    return track.withColumn("step", _step()).groupBy("match_id", "slot").agg(F.coalesce(F.max(F.col("step") / dt), F.lit(0.0)).alias("peak"))


def court_summary(raw: DataFrame, track: DataFrame, dt: float = DT, court: CourtSpec = COURT, max_speed: float = Smoothing.max_speed) -> DataFrame:
    """A row for each player: positions, metres, means, share in front, ranges, peak speed after and before smoothing."""
    steps = track.withColumn("step", _step())
    out = steps.groupBy("match_id", "slot").agg(
        F.count("x").alias("positions"), F.coalesce(F.sum(F.when(F.col("step") <= max_speed * dt, F.col("step"))), F.lit(0.0)).alias("metres"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"),
        (100.0 * F.sum(F.when(F.col("y") < court.short_line, 1).otherwise(0)) / F.count("x")).alias("front"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"),
        F.coalesce(F.max(F.col("step") / dt), F.lit(0.0)).alias("peak"),
    )
    return out.join(peak_speed(raw, dt).withColumnRenamed("peak", "raw_peak"), ["match_id", "slot"])


def coasted(track: DataFrame) -> DataFrame:
    """match_id, coasted: positions that were not measured."""
    return track.groupBy("match_id").agg(F.sum(F.when(F.col("x").isNotNull() & ~F.col("solid"), 1).otherwise(0)).cast("bigint").alias("coasted"))


def speeds(track: DataFrame, dt: float = DT, keys: tuple = ("match_id",)) -> DataFrame:
    """The track with speed, null where either end of a step is missing."""
    return track.withColumn("speed", _step(keys) / dt)


def activity(track: DataFrame, dt: float = DT, window_s: float = RallyRule.activity_s, keys: tuple = ("match_id",)) -> DataFrame:
    """keys (match_id), k, time_s, activity: the mean of both players' speeds in a centred window of samples.

    Speeds are summed by sample first; the window then adds sums and counts.
    """
    half = half_window(window_s, dt)
    by_sample = speeds(track, dt, keys).groupBy(*keys, "k", "time_s").agg(F.sum("speed").alias("s"), F.count("speed").alias("n"))
    near = Window.partitionBy(*keys).orderBy("k").rowsBetween(-half, half)
    return by_sample.select(*keys, "k", "time_s", (F.sum("s").over(near) / F.nullif(F.sum("n").over(near), F.lit(0))).alias("activity"))


def radial(track: DataFrame, court: CourtSpec = COURT) -> DataFrame:
    """The track with radial, the distance to the middle of the short line."""
    return track.withColumn("radial", F.sqrt(F.pow(F.col("x") - court.half, 2) + F.pow(F.col("y") - court.short_line, 2)))


def trail(track: DataFrame, max_gap: int = 3) -> DataFrame:
    """match_id, slot, k, x0, y0, x, y, weight: the lines of each path between seen positions at most max_gap samples apart; later ones are stronger."""
    order, match = Window.partitionBy("match_id", "slot").orderBy("k"), Window.partitionBy("match_id")
    rows = track.withColumn("_n", F.max("k").over(match) + 1).filter("x is not null")
    rows = rows.withColumn("_gap", F.col("k") - F.lag("k").over(order)).withColumn("x0", F.lag("x").over(order)).withColumn("y0", F.lag("y").over(order))
    return rows.filter(F.col("_gap") <= max_gap).select("match_id", "slot", "k", "x0", "y0", "x", "y", (0.35 + 0.65 * (F.col("k") + 1) / F.col("_n")).alias("weight"))


def wide(track: DataFrame, columns: tuple = ("x", "y"), form: str = "%.4f") -> DataFrame:
    """match_id, k, p0_x, p0_y, p1_x, p1_y as text, a row for each sample."""
    seat = [F.max(F.when((F.col("slot") == n) & F.col(c).isNotNull(), F.format_string(form, c))).alias(f"p{n}_{c}") for n in (0, 1) for c in columns]
    return track.groupBy("match_id", "k").agg(*seat)


def samples(track: DataFrame, keys: tuple = ("match_id",)) -> DataFrame:
    """keys (match_id), k, time_s, blobs and both players' positions, a row for each sample."""
    at = lambda slot, c: F.max(F.when(F.col("slot") == slot, F.col(c))).alias(f"{c}{slot}")
    return track.groupBy(*keys, "k", "time_s").agg(F.min("blobs").alias("blobs"), at(0, "x"), at(0, "y"), at(1, "x"), at(1, "y"))
