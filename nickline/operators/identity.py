"""Who is who: shirts, fences, association of detections with tracks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Detector


def shirt_distance(a, b, lightness: float = Detector.lightness):
    """Between two (l, a, b) column triples; NaN where either is missing."""
    (l1, a1, b1), (l2, a2, b2) = a, b
    far = F.sqrt(F.lit(lightness) * F.pow(l1 - l2, 2) + F.pow(a1 - a2, 2) + F.pow(b1 - b2, 2))
    return F.coalesce(far, F.lit(float("nan")))


def unfenced(blobs: DataFrame, zones: DataFrame, tolerance: float = Detector.ignore) -> DataFrame:
    """blobs (fx, fy centre, fh height) that no fence (x0, y0, x1, y1, height or null) takes in; fences are few and drawn by hand."""
    z = F.broadcast(zones)
    inside = F.col("fx").between(z["x0"], z["x1"]) & F.col("fy").between(z["y0"], z["y1"])
    alike = z["height"].isNull() | (F.abs(F.col("fh") - z["height"]) <= tolerance * z["height"])
    return blobs.join(z, inside & alike, "left_anti")


def largest(blobs: DataFrame, keys: tuple, rule: Detector = Detector()) -> DataFrame:
    """The largest blobs of each frame among those big and tall enough; equal areas by det_id."""
    order = Window.partitionBy(*keys).orderBy(F.col("area").desc(), "det_id")
    return blobs.filter((F.col("area") >= rule.min_area) & (F.col("h") >= rule.min_height)).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= rule.candidates)


def association_cost(rows: DataFrame, rule: Detector = Detector()) -> DataFrame:
    """rows of a track (tx, ty, gate, gap, mine, theirs, misses) with a detection (cx, cy), with cost; null where it is out of reach or refused."""
    far = F.sqrt(F.pow(F.col("tx") - F.col("cx"), 2) + F.pow(F.col("ty") - F.col("cy"), 2))
    known = lambda c: ~F.isnan(c)
    out = (far > F.col("gate")) | (known("mine") & (F.col("mine") > rule.anchor_max)) | ((F.col("misses") > 0) & known("mine") & known("theirs") & (F.col("mine") > rule.ratio * F.col("theirs")))
    cost = far + F.when(known("gap"), rule.colour_weight * F.col("gap")).otherwise(0.0) + F.when(known("mine"), rule.anchor_weight * F.col("mine")).otherwise(0.0)
    return rows.withColumn("cost", F.when(~out, cost))


def assign(costs: DataFrame, keys: tuple) -> DataFrame:
    """keys, slot, det_id: of each frame's reachable pairs (slot, det_id, cost), the most that can stand together, then the cheapest."""
    keys = list(keys)
    ok = costs.filter("cost is not null").select(*keys, "slot", "det_id", "cost")
    a, b = ok.filter("slot = 0"), ok.filter("slot = 1").select(*keys, F.col("det_id").alias("det_1"), F.col("cost").alias("cost_1"))
    both = a.join(b, keys).filter(F.col("det_id") != F.col("det_1")).select(*keys, F.lit(2).alias("n"), (F.col("cost") + F.col("cost_1")).alias("total"), F.array(F.struct(F.lit(0).alias("slot"), "det_id"), F.struct(F.lit(1).alias("slot"), F.col("det_1").alias("det_id"))).alias("pairs"))
    single = ok.select(*keys, F.lit(1).alias("n"), F.col("cost").alias("total"), F.array(F.struct(F.col("slot").cast("int").alias("slot"), "det_id")).alias("pairs"))
    best = both.unionByName(single).groupBy(*keys).agg(F.min_by("pairs", F.struct(-F.col("n"), F.col("total"), F.col("pairs"))).alias("pairs"))
    return best.select(*keys, F.explode("pairs").alias("p")).select(*keys, "p.slot", "p.det_id")


def seed(detections: DataFrame, keys: tuple, rule: Detector = Detector()) -> DataFrame:
    """keys, first, second: the two detections (det_id, near_0, near_1: distances from the players' shirts) that each look like and lean to their player."""
    keys = list(keys)
    lean = lambda own, other: (F.col(own) <= rule.seed_max) & (F.col(other) - F.col(own) >= rule.seed_margin)
    a = detections.filter(lean("near_0", "near_1")).select(*keys, F.col("det_id").alias("first"), "near_0")
    b = detections.filter(lean("near_1", "near_0")).select(*keys, F.col("det_id").alias("second"), "near_1")
    pairs = a.join(b, keys).filter(F.col("first") != F.col("second"))
    return pairs.groupBy(*keys).agg(F.min_by(F.struct("first", "second"), F.struct(F.col("near_0") + F.col("near_1"), "first", "second")).alias("p")).select(*keys, "p.first", "p.second")


def separate(samples: DataFrame, radius: float = Detector.collapse_px) -> DataFrame:
    """samples (cx0, cy0, source0, cx1, …) with kept0 and kept1: of two slots on one body, a predicted one goes."""
    near = F.coalesce(F.sqrt(F.pow(F.col("cx0") - F.col("cx1"), 2) + F.pow(F.col("cy0") - F.col("cy1"), 2)) <= radius, F.lit(False))
    guess = lambda n: F.coalesce(F.col(f"source{n}") == "predicted", F.lit(False))
    return samples.withColumn("kept0", F.col("cx0").isNotNull() & ~(near & guess(0))).withColumn("kept1", F.col("cx1").isNotNull() & ~(near & guess(1)))


def loitering(rows: DataFrame, keys: tuple, rule: Detector = Detector()) -> DataFrame:
    """rows (keys, ms, cx, cy, anchor) with loiters: three seconds in one spot, looking unlike the player."""
    span = int(rule.still_s * 1000)
    recent = Window.partitionBy(*keys).orderBy("ms").rangeBetween(-span + 1, 0)
    size = F.sqrt(F.pow(F.max("cx").over(recent) - F.min("cx").over(recent), 2) + F.pow(F.max("cy").over(recent) - F.min("cy").over(recent), 2))
    full = (F.count("*").over(recent) >= rule.still_samples) & (F.min("ms").over(recent) <= F.col("ms") - int(span * 0.8))
    return rows.withColumn("loiters", F.coalesce(full & (size < rule.still_px) & (F.avg(F.when(~F.isnan("anchor"), F.col("anchor"))).over(recent) > rule.still_anchor), F.lit(False)))


def _fold(rows: DataFrame, keys: tuple, order: str, columns: list[str], schema: str, start, step) -> DataFrame:
    """A recurrence along each key, streamed through partitions sorted by key and order."""
    keys = list(keys)
    kinds = ", ".join(f"`{k}` {t}" for k, t in rows.select(*keys, order).dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, state = None, None
        for b in batches:
            out = []
            for key, values in zip(zip(*[b[k] for k in keys]), zip(*[b[c] for c in columns])):
                if key != who:
                    who, state = key, start()
                state, made = step(state, *values)
                out.append(made)
            yield pd.concat([b[[*keys, order]].reset_index(drop=True), pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])], axis=1)

    return rows.select(*keys, order, *columns).repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, f"{kinds}, {schema}")


def evidence(rows: DataFrame, keys: tuple, order: str = "k", rule: Detector = Detector()) -> DataFrame:
    """keys, k, evidence, n: the running mean of how much more a body looks like player 0 (lean; NaN doesn't count)."""

    def step(state, lean):
        if lean == lean:
            e, n = state
            state = (lean if n == 0 else rule.identity_memory * e + (1 - rule.identity_memory) * lean, n + 1)
        return state, state

    return _fold(rows, keys, order, ["lean"], "evidence double, n bigint", lambda: (0.0, 0), step)


def kalman(rows: DataFrame, keys: tuple, order: str = "k", value: str = "cx", rule: Detector = Detector()) -> DataFrame:
    """keys, k, at, speed, variance: a constant-velocity filter of one axis, a step a sample; missing values are predicted only."""
    q, r = rule.accel**2, rule.noise**2

    def step(state, z):
        if state is None:
            return (None, (None, None, None)) if z != z or z is None else ((z, 0.0, r, 0.0, 100.0), (z, 0.0, r))
        x, v, a, b, c = state
        x, a, b, c = x + v, a + 2 * b + c + q / 4, b + c + q / 2, c + q
        if z == z and z is not None:
            g, h = a / (a + r), b / (a + r)
            e = z - x
            x, v, a, b, c = x + g * e, v + h * e, a - g * a, b - g * b, c - h * b
        return (x, v, a, b, c), (x, v, a)

    return _fold(rows, keys, order, [value], "at double, speed double, variance double", lambda: None, step)


def track_summary(slots: DataFrame) -> DataFrame:
    """match_id, frames, both, one, none, observed, split, coasted of rows (match_id, k, slot, source or null)."""
    by = slots.groupBy("match_id", "k").agg(F.count("source").alias("n"), *[F.sum(F.when(c, 1).otherwise(0)).alias(a) for a, c in (("o", F.col("source") != "predicted"), ("s", F.col("source") == "split"), ("p", F.col("source") == "predicted"))])
    count = lambda n, a: F.sum(F.when(F.col("n") == n, 1).otherwise(0)).cast("bigint").alias(a)
    return by.groupBy("match_id").agg(F.count("*").alias("frames"), count(2, "both"), count(1, "one"), count(0, "none"), *[F.sum(c).cast("bigint").alias(a) for c, a in (("o", "observed"), ("s", "split"), ("p", "coasted"))])


def roster(samples: DataFrame, lightness: float = 1.0, keys: tuple = ("match_id", "slot")) -> DataFrame:
    """keys, l, a, b (truncated medians of the shirt samples) and spread, the median distance from them (null under two samples).

    A roster is a video's; without match_id among the keys, all matches are one.
    """
    middle = samples.groupBy(*keys).agg(*[F.percentile(c, 0.5).cast("int").alias(f"m{c}") for c in "lab"], F.count("*").alias("n"))
    far = samples.join(middle, list(keys)).withColumn("d", shirt_distance(tuple(F.col(c) for c in "lab"), tuple(F.col(f"m{c}") for c in "lab"), lightness))
    return far.groupBy(*keys).agg(*[F.first(f"m{c}").alias(c) for c in "lab"], F.when(F.first("n") >= 2, F.percentile("d", 0.5)).alias("spread"))


def separation(found: DataFrame, lightness: float = 1.0) -> DataFrame:
    """match_id, separation: how far apart the two shirts of a roster (match_id, slot, l, a, b) are."""
    one, two = (found.filter(F.col("slot") == n).select("match_id", *[F.col(c).cast("double").alias(f"{c}{n}") for c in "lab"]) for n in (0, 1))
    far = shirt_distance(tuple(F.col(f"{c}0") for c in "lab"), tuple(F.col(f"{c}1") for c in "lab"), lightness)
    return one.join(two, "match_id").select("match_id", far.alias("separation"))


def standing(edits: DataFrame, keys: tuple = ("match_id",), order: str = "nr") -> DataFrame:
    """The edits (keys, nr, action, ...) that no undo took back; an undo takes back the last one that stands, or nothing.

    An edit goes when the number of standing ones falls below what it was with that edit, so running sums and minima tell.
    """
    past = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*keys).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    rows = edits.withColumn("_sum", F.sum(F.when(F.col("action") == "undo", -1).otherwise(1)).over(past))
    rows = rows.withColumn("_depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(past)))
    rows = rows.withColumn("_low", F.coalesce(F.min("_depth").over(later), F.col("_depth")))
    return rows.filter((F.col("action") != "undo") & (F.col("_low") >= F.col("_depth"))).select(*edits.columns)


def fence(x, y, w, h, wide, high, tallest, pad: float = 8.0):
    """A struct of the padded box x0, y0, x1, y1 around a blob in fractions of the part looked at (wide, high), its height, and that relative to the tallest other blob."""
    edge = lambda c, size: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c / size))
    relative = F.when(tallest > 0, F.bround(h / tallest, 3))
    parts = {"x0": edge(x - pad, wide), "y0": edge(y - pad, high), "x1": edge(x + w + pad, wide), "y1": edge(y + h + pad, high), "height": h / high, "relative": relative}
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def risky(relative, most: float = 0.75):
    """Whether a fence is about as tall as a player, so that it would take players in, too."""
    return F.coalesce(relative >= most, F.lit(False))


def roster_state(samples: DataFrame) -> DataFrame:
    """match_id, player_height (median over both players; null heights don't count), complete (both have a sample) of samples (match_id, slot, height)."""
    return samples.groupBy("match_id").agg(F.percentile("height", 0.5).alias("player_height"), (F.countDistinct("slot") == 2).alias("complete"))


def pick(points: DataFrame, blobs: DataFrame, keys: tuple, reach: float = 40.0) -> DataFrame:
    """keys, det_id: the blob (x, y, w, h, cx, cy) a click (px, py) falls in, or the nearest centre within reach."""
    rows = points.join(blobs, list(keys))
    inside = F.col("px").between(F.col("x"), F.col("x") + F.col("w")) & F.col("py").between(F.col("y"), F.col("y") + F.col("h"))
    far = F.when(inside, 0.0).otherwise(F.sqrt(F.pow(F.col("px") - F.col("cx"), 2) + F.pow(F.col("py") - F.col("cy"), 2)))
    return rows.withColumn("far", far).filter(F.col("far") <= reach).groupBy(*keys).agg(F.min_by("det_id", F.struct("far", "det_id")).alias("det_id"))
