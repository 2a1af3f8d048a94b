"""Files that the engine reads and writes: calibrations, labels, rosters, settings, CSV tables, frames."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

COURT_SCHEMA = "video string, court struct<width: double, length: double, short_line: double, box: double>, points array<struct<name: string, image: array<double>, court: array<double>>>, residuals_cm array<double>"
LABEL_SCHEMA = "video string, marks array<struct<time_s: double, kind: string>>"
ROSTER_SCHEMA = "video string, roi array<double>, players array<struct<slot: int, name: string, shirt: array<int>, rgb: array<int>, samples: array<array<int>>, heights: array<double>, spread: double>>, ignore array<struct<box: array<double>, height: double, relative: double>>, separation double, note string"


def _json(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_court(spark, path: str) -> DataFrame:
    """place, name, image_x, image_y: a calibration's points; what it says of the court and of residuals isn't used."""
    points = _json(spark, path, COURT_SCHEMA).select(F.posexplode("points").alias("place", "p"))
    return points.select("place", "p.name", F.col("p.image")[0].alias("image_x"), F.col("p.image")[1].alias("image_y"))


def write_court(pairs: DataFrame, path: str, video: str = "") -> None:
    """A calibration of points (name, image_x, image_y, court_x, court_y, residual_cm), in order of their names."""
    one = F.struct("name", F.array("image_x", "image_y").alias("image"), F.array("court_x", "court_y").alias("court"), "residual_cm")
    found = pairs.agg(F.sort_array(F.collect_list(one)).alias("p"))
    points = F.transform("p", lambda x: F.struct(x["name"].alias("name"), x["image"].alias("image"), x["court"].alias("court")))
    found.select(F.lit(video).alias("video"), points.alias("points"), F.col("p.residual_cm").alias("residuals_cm")).coalesce(1).write.mode("overwrite").json(path)


def write_settings(found: dict, path: str, spark, part: str = "parameters", video: str = "") -> None:
    """A settings file that read_settings reads."""
    spark.createDataFrame([(json.dumps({"video": video, part: found}),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def frames_info(spark, path: str, **options) -> dict:
    """frames, fps, width and height of a video or stack, read from it without reading all frames."""
    reader = _FrameReader({"path": path, **{k: str(v) for k, v in options.items()}})
    frames, fps = reader.info()
    first = read_frames(spark, path, **options).select("h", "w").first()
    return {"frames": frames, "fps": fps, "width": first.w if first else 0, "height": first.h if first else 0}


def read_labels(spark, path: str, kinds: list[str] | None = None) -> DataFrame:
    """time_s, kind of the marks, of all kinds or those named; a mark without a kind ends a rally."""
    marks = _json(spark, path, LABEL_SCHEMA).select(F.explode("marks").alias("m")).select("m.time_s", F.coalesce("m.kind", F.lit("rally")).alias("kind"))
    return marks.filter(F.col("kind").isin(kinds)) if kinds else marks


def write_labels(marks: DataFrame, path: str, video: str = "") -> None:
    """One document of all marks (time_s, kind) in order of time."""
    listed = marks.agg(F.sort_array(F.collect_list(F.struct("time_s", "kind"))).alias("marks"))
    listed.select(F.lit(video).alias("video"), "marks").coalesce(1).write.mode("overwrite").json(path)


def marked(edits: DataFrame, keys: tuple = ("match_id",), near: float = 0.4) -> DataFrame:
    """keys, time_s, kind of the marks that a log of edits (keys, nr, action mark or undo, time_s, kind) leaves.

    A mark replaces those within near seconds of it, an undo takes the last that is left.  What a person marked on one video is one group.
    """
    keys = list(keys)
    kinds = ", ".join(f"`{k}` {t}" for k, t in edits.select(*keys).dtypes)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        left: list = []
        for e in pdf.sort_values("nr").itertuples():
            left = left[:-1] if e.action == "undo" else [*(m for m in left if abs(m[0] - e.time_s) > near), (round(e.time_s, 2), e.kind)]
        return pd.DataFrame([(*key, *m) for m in left], columns=[*keys, "time_s", "kind"])

    return edits.select(*keys, "nr", "action", "time_s", "kind").groupBy(*keys).applyInPandas(run, f"{kinds}, time_s double, kind string")


def write_roster(samples: DataFrame, zones: DataFrame, path: str, video: str = "") -> None:
    """One roster of shirt samples (slot, l, a, b) and fences (x0, y0, x1, y1, height) that read_roster reads."""
    one = samples.groupBy("slot").agg(F.sort_array(F.collect_list(F.array("l", "a", "b"))).alias("samples")).select(F.struct("slot", "samples").alias("player"))
    fences = zones.select(F.struct(F.array("x0", "y0", "x1", "y1").alias("box"), "height").alias("zone"))
    both = one.unionByName(fences, allowMissingColumns=True).agg(F.sort_array(F.collect_list("player")).alias("players"), F.collect_list("zone").alias("ignore"))
    both.select(F.lit(video).alias("video"), "players", "ignore").coalesce(1).write.mode("overwrite").json(path)


def read_roster(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(slot, shirt samples as l, a, b; zones x0, y0, x1, y1, height).  A player without samples has the shirt as one."""
    found = _json(spark, path, ROSTER_SCHEMA)
    own = F.when(F.size("p.samples") > 0, F.col("p.samples")).when(F.col("p.shirt").isNotNull(), F.array("p.shirt"))
    players = found.select(F.explode("players").alias("p")).select("p.slot", F.explode(own).alias("s"))
    zones = found.select(F.explode("ignore").alias("z")).select(*[F.col("z.box")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], F.col("z.height").alias("height"))
    return players.select("slot", *[F.col("s")[i].alias(n) for i, n in enumerate("lab")]), zones


def read_settings(spark, path: str, allowed: set[str], part: str = "parameters") -> dict:
    """A part of a settings file as a dictionary; a name that isn't allowed is an error."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).limit(1).collect())
    found = json.loads(text).get(part, {})
    if unknown := set(found) - allowed:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return found


def write_table(rows: DataFrame, path: str, order: list[str], digits: int = 3) -> None:
    """A CSV file with a header, numbers cut to the digits given."""
    shown = [F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes]
    rows.select(*shown).orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


class FrameSource(DataSource):
    """Frames of stacked arrays (.npy: n, h, w, 3) or, where OpenCV is installed, of videos.

    Options: path, match_id, start_s, duration_s, stride, fps (0 or unset: the video's, or 30).  Every stride-th frame of the span is read;
    a partition is a contiguous range of 300 read frames.
    """

    @classmethod
    def name(cls):
        return "frames"

    def schema(self):
        return "match_id int, frame_index bigint, time_s double, h int, w int, bgr binary"

    def reader(self, schema):
        return _FrameReader(self.options)


class _Range(InputPartition):
    def __init__(self, first, last):
        self.first, self.last = first, last


def _video(path: str):
    try:
        import cv2
    except ImportError as e:
        raise ImportError("reading a video takes OpenCV; .npy stacks of frames don't") from e
    found = cv2.VideoCapture(path)
    if not found.isOpened():
        raise OSError(f"cannot open {path}")
    return cv2, found


class _FrameReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.match = options["path"], int(options.get("match_id", 0))
        self.stride, self.start = int(options.get("stride", 1)), float(options.get("start_s", 0))
        self.duration = float(options["duration_s"]) if "duration_s" in options else None
        self.rate = float(options.get("fps", 0))

    def info(self) -> tuple[int, float]:
        """(frames, frames a second)"""
        if self.path.endswith(".npy"):
            import numpy as np

            return len(np.load(self.path, mmap_mode="r")), self.rate or 30.0
        cv2, video = _video(self.path)
        return int(video.get(cv2.CAP_PROP_FRAME_COUNT)), self.rate or video.get(cv2.CAP_PROP_FPS) or 30.0

    def partitions(self):
        total, fps = self.info()
        first = round(self.start * fps)
        last = total if self.duration is None else min(total, first + round(self.duration * fps))
        step = 300 * self.stride
        return [_Range(a, min(a + step, last)) for a in range(first, last, step)] or [_Range(0, 0)]

    def read(self, part):
        _, fps = self.info()
        if self.path.endswith(".npy"):
            import numpy as np

            stack = np.load(self.path, mmap_mode="r")
            for i in range(part.first, part.last, self.stride):
                yield self.match, i, i / fps, int(stack.shape[1]), int(stack.shape[2]), stack[i].tobytes()
            return
        cv2, video = _video(self.path)
        video.set(cv2.CAP_PROP_POS_FRAMES, part.first)
        for i in range(part.first, part.last):
            if not video.grab():
                return
            if (i - part.first) % self.stride == 0:
                frame = video.retrieve()[1]
                yield self.match, i, i / fps, frame.shape[0], frame.shape[1], frame.tobytes()


def read_frames(spark, path: str, **options) -> DataFrame:
    spark.dataSource.register(FrameSource)
    return spark.read.format("frames").options(path=path, **{k: str(v) for k, v in options.items()}).load()
