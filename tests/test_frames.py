"""Score boxes, clean frames, rosters and marks: from files through the commands."""

import json
import os

import numpy as np
import pytest

from nickline.cli import main
from nickline.config import SCORE_BOX
from nickline.operators import analysis, identity, scoreboard, tracks, vision
from nickline.plans import bridge, more
from nickline.sources import files

FOLDER = "/root/testdata/sf0.01"


def board_clip(values, hold=8, h=720, w=1280):
    """Frames at 2 Hz whose score box shows a bar in the first cell, at a place of its own for every value."""
    out = np.full((len(values) * hold, h, w, 3), 60, np.uint8)
    x0, y0, x1, y1 = int(SCORE_BOX[0] * w), int(SCORE_BOX[1] * h), int(SCORE_BOX[2] * w), int(SCORE_BOX[3] * h)
    tall, wide = (y1 - y0) // 2, (x1 - x0) // 5
    out[:, y0:y1, x0:x1] = 20
    for n, v in enumerate(values):
        left = x0 + 5 + 4 * v
        out[n * hold : (n + 1) * hold, y0 + tall // 4 : y0 + tall - tall // 4, left : left + 3] = 220
    assert left + 3 < x0 + wide
    return out


def test_points_are_read_off_a_board(spark, tmp_path):
    np.save(tmp_path / "clip.npy", board_clip([0, 1, 2]))
    frames = files.read_frames(spark, str(tmp_path / "clip.npy"), fps=2)
    found = scoreboard.board_points(scoreboard.readings(frames, 2.0)).orderBy("time_s").collect()
    assert [(r.time_s, r.row, r.game, r.score_since_start) for r in found] == [(4.0, 0, 0, 1), (8.0, 0, 0, 2)]


def test_changes_of_the_box_are_found(spark, tmp_path):
    np.save(tmp_path / "clip.npy", board_clip([0, 1], hold=20))
    frames = files.read_frames(spark, str(tmp_path / "clip.npy"), fps=2)
    seen = scoreboard.patches(frames, 2.0)
    assert [r.time_s for r in scoreboard.box_changes(seen, seen.first().width).collect()] == [10.0]


def test_score_commands(spark, tmp_path):
    np.save(tmp_path / "clip.npy", np.repeat(board_clip([0, 1], hold=20, h=360, w=640), 15, 0))  # 30 a second
    assert [round(r.time_s, 3) for r in main(["scoreboard", str(tmp_path / "clip.npy")], spark).collect()] == [10.0]
    assert main(["scoredig", str(tmp_path / "clip.npy")], spark).columns == ["match_id", "time_s", "row", "game", "score_since_start"]


def test_who_moves_is_gone_from_a_clean_frame(spark, tmp_path):
    clip = np.full((40, 6, 40, 3), 90, np.uint8)
    for i in range(40):
        clip[i, 2, i] = 250
    np.save(tmp_path / "clip.npy", clip)
    got = analysis.clean_frame(files.read_frames(spark, str(tmp_path / "clip.npy"), fps=10), 10.0, 280.0, 10, 4).first()
    assert set(got.bgr) == {90} and (got.h, got.w) == (6, 40)


def test_a_draw_list_has_boxes_and_trails(spark, tmp_path):
    from .test_tracker import scene

    np.save(tmp_path / "clip.npy", scene(12))
    rows = main(["demo", str(tmp_path / "clip.npy"), "--stride", "1"], spark).collect()
    assert {r.kind for r in rows} == {"box", "gate", "trail"}
    assert max(len(r.numbers.split()) for r in rows if r.kind == "trail") <= 48


def test_trails_leave_long_gaps_open(spark):
    rows = [(0, 0, k, None if k in (2, 3, 6, 7, 8) else float(k), 1.0) for k in range(11)]
    t = spark.createDataFrame(rows, "match_id int, slot int, k bigint, x double, y double")
    assert [(r.k, r.x0) for r in tracks.trail(t).orderBy("k").collect()] == [(1, 0.0), (4, 1.0), (5, 4.0), (10, 9.0)]


def test_rosters_round_trip(spark, tmp_path):
    samples = spark.createDataFrame([(0, 110, 128, 128), (0, 114, 128, 128), (1, 150, 130, 125)], "slot int, l int, a int, b int")
    zones = spark.createDataFrame([(0.1, 0.2, 0.3, 0.4, None), (0.5, 0.5, 0.6, 0.6, 0.2)], "x0 double, y0 double, x1 double, y1 double, height double")
    files.write_roster(samples, zones, str(tmp_path / "r"))
    got, fences = files.read_roster(spark, str(tmp_path / "r"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, samples.collect()))
    assert sorted(map(str, fences.collect())) == sorted(map(str, zones.collect()))
    (tmp_path / "old.json").write_text(json.dumps({"players": [{"slot": 0, "shirt": [1, 2, 3]}, {"slot": 1, "samples": [[4, 5, 6]], "shirt": [9, 9, 9]}]}))
    assert sorted(map(tuple, files.read_roster(spark, str(tmp_path / "old.json"))[0].collect())) == [(0, 1, 2, 3), (1, 4, 5, 6)]
    shown = main(["roster", str(tmp_path / "r")], spark).collect()
    assert [(r.slot, r.l) for r in shown] == [(0, 112), (1, 150)] and shown[0].separation == pytest.approx(np.sqrt(38**2 + 4 + 9))


def test_edits_are_taken_back(spark):
    log = [(0, n, a) for n, a in enumerate(["undo", "sample", "ignore", "undo", "sample", "undo", "undo", "undo", "ignore"])]
    left = identity.standing(spark.createDataFrame(log, "match_id int, nr int, action string"))
    assert [r.nr for r in left.collect()] == [8]
    marks = [(0, 0, "mark", 1.0, "rally"), (0, 1, "mark", 5.0, "shot"), (0, 2, "mark", 5.3, "volley"), (0, 3, "undo", 0.0, None), (0, 4, "mark", 9.128, "game")]
    kept = files.marked(spark.createDataFrame(marks, "match_id int, nr int, action string, time_s double, kind string"))
    assert [(r.time_s, r.kind) for r in kept.collect()] == [(1.0, "rally"), (9.13, "game")]


def test_label_command(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"marks": [{"time_s": 3.0, "kind": "shot"}]}')
    out = main(["label", str(tmp_path / "m.json"), "--mark", "1.234", "--volley", "2", "--out", str(tmp_path / "out")], spark)
    assert out.count() == 3
    assert sorted(map(tuple, files.read_labels(spark, str(tmp_path / "out")).collect())) == [(1.23, "rally"), (2.0, "volley"), (3.0, "shot")]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_volley_command(spark, tmp_path):
    bridge.track(spark, FOLDER).write.parquet(str(tmp_path / "t"))
    more.q_marks(spark, FOLDER).write.parquet(str(tmp_path / "m"))
    got = {r["name"]: r["value"] for r in main(["volleys", str(tmp_path / "t"), "--points", str(tmp_path / "m")], spark).collect()}
    assert got["labelled"] >= 8 and 0 <= got["heldout_ap"] <= 1 and "weights_0" in got


def test_cuts_match_a_plain_reading():
    rng = np.random.default_rng(5)
    for _ in range(300):
        column = rng.integers(0, 12, rng.integers(5, 60)).astype(float)
        low, high = sorted(rng.integers(1, len(column), 2))
        want = None
        if high > low:
            k = min(range(low, high), key=lambda c: (column[c], c))
            left, right = column[:k], column[k:]
            if column[k] <= 0.55 * min(max(left), max(right)) and min(sum(left), sum(right)) >= 0.3 * max(sum(left), sum(right)):
                want = k
        assert vision.thinnest(column, low, high, 0.55, 0.30) == want
