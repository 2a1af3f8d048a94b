"""Commands over tables of tracks; any prefix that only one command has will do."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DT, LEVELS, RallyRule, ScoreRule, ShotRule
from .operators import analysis, fitting, geometry, identity, matching, outcomes, scoreboard, segments, shots, tracker, tracks
from .sources import files


def resolve(word: str, names) -> str:
    """The command of that name or prefix."""
    found = [n for n in names if n == word] or [n for n in names if n.startswith(word)]
    if len(found) != 1:
        raise SystemExit(2)
    return found[0]


def _points(spark, at: str) -> DataFrame:
    return spark.read.parquet(at)


def _rallies(a, t) -> DataFrame:
    return segments.rallies(segments.resting(t, segments.play_segments(t, a.dt), a.dt, RallyRule(quiet_speed=a.quiet, min_break=a.min_break)), RallyRule(min_break=a.min_break))


def _is_video(path: str) -> bool:
    return path.rsplit(".", 1)[-1].lower() in ("npy", "mp4", "mov", "avi", "mkv")


def _matrix(spark, at: str | None):
    """Image to metres by a calibration file, or the stored one."""
    if not at:
        return geometry.MATRIX
    known = geometry.landmarks()
    points = files.read_court(spark, at).orderBy("place").collect()
    if unknown := [p.name for p in points if p.name not in known]:
        raise SystemExit(f"unknown landmarks: {', '.join(unknown)}")
    return geometry.fit([(known[p.name], (p.image_x, p.image_y)) for p in points])[1]


def _seen(spark, a) -> DataFrame:
    """Paths on the court from a video: detected, tracked, projected, smoothed."""
    info = files.frames_info(spark, a.tracks)
    a.dt = a.stride / info["fps"]
    tracked = tracker.track(files.read_frames(spark, a.tracks, stride=a.stride), a.stride)
    return analysis.paths(tracked, _matrix(spark, a.court), info["width"], info["height"], a.stride, a.dt, a.level)


def autotune(spark, a) -> DataFrame:
    info = files.frames_info(spark, a.tracks)
    video = spark.createDataFrame([(0, info["frames"], float(info["fps"]))], "match_id int, frames bigint, fps double")
    return analysis.tune(files.read_frames(spark, a.tracks), analysis.windows(video), stride=a.stride)


def calibrate(spark, a) -> DataFrame:
    """Residuals of a calibration file's points."""
    known = geometry.landmarks()
    points = files.read_court(spark, a.tracks)
    rows = spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in known.items()], "name string, court_x double, court_y double")
    return geometry.residuals(points.join(rows, "name"), _matrix(spark, a.tracks)).orderBy("place")


def _sampled(spark, a):
    """(frames of a score's pace, frames a second)"""
    fps = files.frames_info(spark, a.tracks)["fps"]
    return files.read_frames(spark, a.tracks, stride=max(1, round(fps / ScoreRule.hz))), ScoreRule.hz


def score_board(spark, a) -> DataFrame:
    seen = scoreboard.patches(*_sampled(spark, a)).cache()
    first = seen.select("width").first()
    return scoreboard.box_changes(seen, first.width if first else 1)


def score_digits(spark, a) -> DataFrame:
    return scoreboard.board_points(scoreboard.readings(*_sampled(spark, a)).cache())


KINDS = {"mark": "rally", "game_mark": "game", "shot": "shot", "volley": "volley", "winner": "winner"}


def label(spark, a) -> DataFrame:
    """The marks of a label file, with those of the options added; --out writes a label file."""
    added = [(round(t, 2), kind) for option, kind in KINDS.items() for t in getattr(a, option)]
    new = spark.createDataFrame(added, "time_s double, kind string")
    return files.read_labels(spark, a.tracks).unionByName(new) if a.tracks.endswith(".json") else new


def roster(spark, a) -> DataFrame:
    """The players' shirts of a roster file and how far apart they are."""
    samples = files.read_roster(spark, a.tracks)[0].withColumn("match_id", F.lit(0))
    found = identity.roster(samples)
    return found.join(identity.separation(found), "match_id", "left").select("slot", "l", "a", "b", "spread", "separation").orderBy("slot")


def volleys(spark, a) -> DataFrame:
    """name, value: the volley model fitted to marks, and its scores."""
    found = _rallies(a, a.track)
    hits = shots.shots(a.track, found)[0]
    rows = fitting.volley_features(hits, shots.within(tracks.radial(a.track), found)).dropna(subset=fitting.FEATURES)
    known = fitting.volley_labels(hits, _points(spark, a.points)).filter("y is not null")
    key = ["match_id", "rally_index", "time_s", "player"]
    rows = rows.join(known.select(*key, "y"), key).withColumn("rally", F.concat_ws("-", "match_id", "rally_index")).withColumn("shot", F.concat_ws("-", *key)).cache()
    out = fitting.fit_volleys(rows, "rally", fitting.FEATURES, "shot")
    flat = [(n, float(x)) for n, v in out.items() for n, x in (((f"{n}_{k}", y) for k, y in v.items()) if isinstance(v, dict) else ((f"{n}_{k}", y) for k, y in enumerate(v)) if isinstance(v, list) else ((n, v),)) if x is not None]
    return spark.createDataFrame(flat, "name string, value double")


def demo(spark, a) -> DataFrame:
    """What to draw over the frames."""
    return analysis.draw_list(tracker.track(files.read_frames(spark, a.tracks, stride=a.stride), a.stride)).withColumn("numbers", F.concat_ws(" ", F.transform("numbers", lambda v: F.format_string("%.1f", v))))


def track(spark, a) -> DataFrame:
    return tracker.track(files.read_frames(spark, a.tracks, stride=a.stride), a.stride).drop("gate", "shirt")


def play(spark, a) -> DataFrame:
    return segments.play_segments(a.track, a.dt)


def smooth(spark, a) -> DataFrame:
    return tracks.smoothed(a.track, LEVELS[a.level], a.dt)


def birdseye(spark, a) -> DataFrame:
    """Primitives to draw: a point on the plan for each position."""
    from .operators.geometry import plan_point

    x, y = plan_point(F.col("x"), F.col("y"))
    return tracks.smoothed(a.track, LEVELS[a.level], a.dt).filter("x is not null").select("match_id", "slot", "k", x.alias("px"), y.alias("py"), "solid")


def rallies(spark, a) -> DataFrame:
    return _rallies(a, a.track)


def shot_list(spark, a) -> DataFrame:
    return shots.shots(a.track, _rallies(a, a.track), ShotRule())[0]


def winners(spark, a) -> DataFrame:
    found = _rallies(a, a.track)
    return outcomes.outcomes(found, shots.shots(a.track, found)[0], _points(spark, a.points))


def evaluate(spark, a) -> DataFrame:
    return matching.scores(matching.greedy_match(_rallies(a, a.track).select("match_id", F.col("end_s").alias("time_s")), _points(spark, a.points).select("match_id", "time_s"), a.tolerance))


def train(spark, a) -> DataFrame:
    return fitting.grid_search(a.track, _points(spark, a.points).select("match_id", "time_s"), tolerance=a.tolerance)


def crossval(spark, a) -> DataFrame:
    return fitting.cross_validate(a.track, _points(spark, a.points).select("match_id", "time_s"), tolerance=a.tolerance)


COMMANDS = {"track": track, "play": play, "smooth": smooth, "birdseye": birdseye, "rallies": rallies, "shots": shot_list, "winners": winners, "evaluate": evaluate, "train": train, "crossval": crossval, "autotune": autotune, "calibrate": calibrate, "scoreboard": score_board, "scoredigits": score_digits, "label": label, "roster": roster, "volleys": volleys, "demo": demo}

#: Commands that read something else than paths.
FROM_FILES = {"track", "autotune", "calibrate", "scoreboard", "scoredigits", "label", "roster", "demo"}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    argv = sys.argv[1:] if argv is None else argv
    if not argv:
        print("commands: " + ", ".join(COMMANDS), file=sys.stderr)
        raise SystemExit(2)
    name = resolve(argv[0], COMMANDS)
    p = argparse.ArgumentParser(prog=f"nickline {name}")
    p.add_argument("tracks", help="a Parquet table match_id, slot, k, time_s, blobs, x, y, or a video (.npy, .mp4); a file for calibrate, roster and label")
    p.add_argument("--court", help="a calibration file, for videos")
    p.add_argument("--out", help="write CSV here instead of showing rows")
    p.add_argument("--points", help="a Parquet table of points or reference times: match_id, time_s, row, game")
    p.add_argument("--level", choices=LEVELS, default="normal")
    p.add_argument("--stride", type=int, default=2)
    p.add_argument("--dt", type=float, default=DT)
    p.add_argument("--quiet", type=float, default=RallyRule.quiet_speed)
    p.add_argument("--min-break", type=float, default=RallyRule.min_break)
    p.add_argument("--tolerance", type=float, default=5.0)
    if name == "label":
        for option in KINDS:
            p.add_argument("--" + option.replace("_", "-"), type=float, action="append", default=[], metavar="SECONDS")
    a = p.parse_args(argv[1:])
    spark = spark or SparkSession.builder.getOrCreate()
    if name not in FROM_FILES:
        a.track = _seen(spark, a) if _is_video(a.tracks) else spark.read.parquet(a.tracks)
    out = COMMANDS[name](spark, a)
    if a.out and name == "label":
        files.write_labels(out, a.out, a.tracks)
    elif a.out:
        files.write_table(out, a.out, [c for c in ("match_id", "rally_index", "frame_index", "slot", "time_s", "k", "name") if c in out.columns])
    else:
        out.show(50, truncate=False)
    return out
