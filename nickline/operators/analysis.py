"""From frames to paths on the court, and the search for detector settings."""

from __future__ import annotations

import dataclasses
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DETECTOR_GRID, LEVELS, WINDOW_S, WINDOWS, Detector
from . import geometry, tracker, tracks


def on_court(tracked: DataFrame, matrix, width: int, height: int, stride: int = 1) -> DataFrame:
    """match_id, slot, k, time_s, blobs, x, y, off of the tracker's rows of frames of that size; matrix takes fractions of the frame to metres.

    k counts the frames that were looked at.  A predicted position has no foot and no place on the court, and isn't off it.
    """
    fx, fy = geometry.foot_fraction(F.col("foot_x"), F.col("foot_y"), width, height)
    rows = tracked.withColumn("fx", fx).withColumn("fy", fy).withColumn("coasted", F.col("foot_x").isNull())
    first = tracked.groupBy("match_id").agg(F.min("frame_index").alias("_first"))
    rows = geometry.project(rows, matrix).join(F.broadcast(first), "match_id")
    k = F.floor((F.col("frame_index") - F.col("_first")) / stride).cast("bigint").alias("k")
    return rows.select("match_id", "slot", k, "time_s", "blobs", "x", "y", "off")


def paths(tracked: DataFrame, matrix, width: int, height: int, stride: int = 1, dt: float = 1 / 15, level: str = "normal") -> DataFrame:
    """on_court's rows smoothed: match_id, slot, k, time_s, blobs, x, y, solid, for play, rallies and shots."""
    raw = on_court(tracked, matrix, width, height, stride)
    found = tracks.smoothed(raw.select("match_id", "slot", "k", "time_s", "blobs", "x", "y"), LEVELS[level], dt)
    return found.join(raw.select("match_id", "slot", "k", "blobs"), ["match_id", "slot", "k"])


def windows(videos: DataFrame, count: int = WINDOWS, seconds: float = WINDOW_S) -> DataFrame:
    """match_id, nr, first, end: spans of frames spread over the middle of each video (match_id, frames, fps), those of more than five frames."""
    at = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("nr")
    rows = videos.select("match_id", "frames", F.coalesce(F.nullif("fps", F.lit(0.0)), F.lit(30.0)).alias("fps"), at)
    first = (F.col("frames") * (F.lit(0.1) + F.lit(0.8) * (F.col("nr") + 0.5) / count)).cast("bigint")
    rows = rows.withColumn("first", first).withColumn("end", F.least(F.col("frames"), F.col("first") + (F.lit(seconds) * F.col("fps")).cast("bigint")))
    return rows.filter(F.col("end") - F.col("first") > 5).select("match_id", "nr", "first", "end")


def tune(frames: DataFrame, spans: DataFrame, grid: dict = DETECTOR_GRID, stride: int = 2, rule: Detector = Detector()) -> DataFrame:
    """param, the grid's settings, share: how often both players are measured in the spans (match_id, nr, first, end), the best first.

    Every span is tracked anew by every setting, as a match of its own (match_id * 1000 + nr); settings are jobs side by side in one plan.
    """
    cut = frames.join(F.broadcast(spans.withColumnRenamed("match_id", "_match")), (F.col("match_id") == F.col("_match")) & (F.col("frame_index") >= F.col("first")) & (F.col("frame_index") < F.col("end")))
    cut = cut.withColumn("match_id", (F.col("match_id") * 1000 + F.col("nr")).cast("int")).select(*frames.columns)
    parts = None
    for i, values in enumerate(itertools.product(*grid.values())):
        seen = tracker.track(cut, stride, rule=dataclasses.replace(rule, **dict(zip(grid, values)))).groupBy("match_id", "frame_index").agg(F.count(F.when(F.col("source") != "predicted", 1)).alias("n"))
        share = seen.agg(F.coalesce(F.avg((F.col("n") == 2).cast("double")), F.lit(0.0)).alias("share"))
        one = share.select(F.lit(i).alias("param"), *[F.lit(v).alias(n) for n, v in zip(grid, values)], "share")
        parts = one if parts is None else parts.unionByName(one)
    return parts.orderBy(F.col("share").desc(), "param")


def clean_frame(frames: DataFrame, fps: float, at_s: float = 280.0, samples: int = 60, spacing: int = 40) -> DataFrame:
    """match_id, h, w, bgr: the median of frames spread from at_s on (or up to the end), in which who moves is gone.  A match's few samples are one group."""
    span = samples * spacing
    total = frames.groupBy("match_id").agg((F.max("frame_index") + 1).alias("_n"))
    rows = frames.join(F.broadcast(total), "match_id").withColumn("_from", F.least(F.lit(int(at_s * fps)), F.greatest(F.lit(0), F.col("_n") - span)))
    gone = F.col("frame_index") - F.col("_from")
    picked = rows.filter((gone >= 0) & (gone < span) & (gone % spacing == 0))

    def middle(key, pdf: pd.DataFrame) -> pd.DataFrame:
        stack = np.stack([np.frombuffer(b, np.uint8) for b in pdf.bgr])
        return pd.DataFrame([(*key, int(pdf.h.iloc[0]), int(pdf.w.iloc[0]), np.median(stack, axis=0).astype(np.uint8).tobytes())], columns=["match_id", "h", "w", "bgr"])

    return picked.select("match_id", "h", "w", "bgr").groupBy("match_id").applyInPandas(middle, "match_id int, h int, w int, bgr binary")


def draw_list(tracked: DataFrame, last: int = 24) -> DataFrame:
    """match_id, frame_index, slot, kind, numbers: what to draw over each frame: boxes (x, y, w, h), gates (x, y, radius) and the last centres as a trail (x, y, x, y, ...)."""
    order = Window.partitionBy("match_id", "slot").orderBy("frame_index").rowsBetween(-last + 1, 0)
    rows = tracked.withColumn("_trail", F.flatten(F.collect_list(F.when(F.col("cx").isNotNull(), F.array("cx", "cy"))).over(order)))
    box = F.when(F.col("cx").isNotNull(), F.transform(F.array("x", "y", "w", "h"), lambda v: v.cast("double")))
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), c.alias("numbers")) for n, c in (("box", box), ("gate", F.col("gate")), ("trail", F.when(F.size("_trail") >= 4, F.col("_trail"))))])).alias("d")
    return rows.select("match_id", "frame_index", "slot", kinds).select("match_id", "frame_index", "slot", "d.kind", "d.numbers").filter("numbers is not null")
