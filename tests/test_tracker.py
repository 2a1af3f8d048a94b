import numpy as np
import pytest

from nickline.operators import tracker, vision
from nickline.sources.files import read_court, read_frames, read_labels, read_settings


def scene(n, h=270, w=480):
    """A dark and a light figure crossing a floor."""
    out = np.full((n, h, w, 3), 90, np.uint8)
    for i in range(n):
        for x, y, colour in ((90 + 3 * i, 120, 20), (380 - 3 * i, 160, 230)):
            out[i, y : y + 60, x : x + 16] = colour
    return out


def test_parts_of_a_mask():
    mask = np.zeros((20, 20), bool)
    mask[2:6, 2:5] = mask[6:9, 5:8] = True  # touch at a corner
    mask[12:15, 10:18] = True
    assert vision.components(mask) == [(10, 12, 8, 3, 24), (2, 2, 6, 7, 21)]
    assert vision.components(np.zeros((4, 4), bool)) == []


def test_opening_and_closing():
    back, frame = np.zeros((40, 40), np.uint8), np.zeros((40, 40), np.uint8)
    frame[5, 5] = 200  # a speck
    frame[10:30, 10:20] = 200
    frame[18, 10:20] = 0  # a crack
    mask = vision.foreground(frame, back)
    assert not mask[5, 5] and mask[10:30, 10:20].all() and mask.sum() == 200


def test_splits():
    column = np.array([10.0] * 12 + [1.0] + [10.0] * 12)
    assert vision.valley(column) == 12
    assert vision.valley(np.array([10.0] * 25)) is None
    shallow = np.array([10.0] * 12 + [7.0] + [10.0] * 12)
    assert vision.valley(shallow) is None
    assert vision.guided(shallow, (0, 0, 25, 10), [(5, 5), (20, 5)]) == 12
    assert vision.guided(shallow, (0, 0, 25, 10), [(5, 5)]) is None


def test_digits():
    cell = np.full((60, 40), 30.0)
    cell[15:45, 18:23] = 200
    mask = vision.digit(cell)
    assert mask.shape == (32, 24) and 0.05 <= mask.mean() <= 0.40
    assert vision.digit(np.full((60, 40), 30.0)) is None
    assert len(list(vision.cells(np.zeros((20, 50))))) == 10


def test_two_players_are_followed(spark, tmp_path):
    frames = scene(40)
    np.save(tmp_path / "clip.npy", frames)
    df = read_frames(spark, str(tmp_path / "clip.npy"), fps=25)
    assert df.count() == 40
    rows = [r for r in tracker.track(df).orderBy("frame_index", "slot").collect()]
    assert len(rows) == 80
    light = [r.cx for r in rows if r.slot == 0 and r.cx is not None]
    dark = [r.cx for r in rows if r.slot == 1 and r.cx is not None]
    assert len(light) >= 30 and len(dark) >= 30
    assert light[0] > light[-1] and dark[0] < dark[-1]  # the brighter one is first, and each goes its own way
    assert tracker.resolved(tracker.track(df)).first().share > 0.6


def test_from_frames_to_rallies(spark, tmp_path):
    from nickline.cli import main
    from nickline.operators import analysis, geometry

    # both figures run, then stand; feet lie on the court of a plain calibration
    moving, still = scene(60), np.repeat(scene(60)[-1:], 40, 0)
    np.save(tmp_path / "clip.npy", np.concatenate([moving, moving[::-1], still, moving]))
    to_metres = lambda x, y: (x * 6.4, y * 9.75)
    points = [{"name": n, "image": [x / 6.4, y / 9.75]} for n, (x, y) in geometry.landmarks().items()]
    (tmp_path / "court.json").write_text(__import__("json").dumps({"points": points}))
    args = [str(tmp_path / "clip.npy"), "--court", str(tmp_path / "court.json"), "--stride", "1"]
    path = main(["smooth", *args], spark)
    rows = path.filter("x is not null").collect()
    assert len(rows) > 200 and {r.slot for r in rows} == {0, 1}
    tracked = {(r.frame_index, r.slot): r for r in tracker.track(read_frames(spark, args[0], fps=30)).collect()}
    matrix = geometry.fit([(m, (m[0] / 6.4, m[1] / 9.75)) for m in geometry.landmarks().values()])[1]
    raw = analysis.on_court(tracker.track(read_frames(spark, args[0], fps=30)), matrix, 480, 270).collect()
    assert len(raw) == len(tracked)
    for r in raw:
        got = tracked[(r.k, r.slot)]
        if got.foot_x is None:
            assert r.x is None and not r.off
        else:
            assert (r.x, r.y) == pytest.approx(to_metres((64 + got.foot_x) / 480, (37 + got.foot_y) / 270), abs=1e-6)
    assert main(["rallies", *args, "--quiet", "0.3", "--min-break", "0.5"], spark).columns == ["match_id", "rally_index", "start_s", "end_s"]
    residuals = main(["calibrate", str(tmp_path / "court.json")], spark).collect()
    assert len(residuals) == 14 and all(r.residual_cm < 0.01 for r in residuals)


def test_settings_are_searched_over_spans(spark, tmp_path):
    from nickline.operators import analysis

    np.save(tmp_path / "clip.npy", scene(40))
    frames = read_frames(spark, str(tmp_path / "clip.npy"), fps=25)
    spans = analysis.windows(spark.createDataFrame([(0, 40, 25.0)], "match_id int, frames bigint, fps double"), 2, 0.6)
    assert [(r.nr, r["first"], r["end"]) for r in spans.orderBy("nr").collect()] == [(0, 12, 27), (1, 28, 40)]
    found = analysis.tune(frames, spans, {"difference": (25, 250)}, 1).collect()
    assert [r.difference for r in found] == [25, 250] and found[0].share > found[1].share == 0


def test_calibrations_and_settings_round_trip(spark, tmp_path):
    from nickline.sources.files import write_court, write_settings

    rows = spark.createDataFrame([("tee", 0.1, 0.2, 3.2, 4.26, 1.5)], "name string, image_x double, image_y double, court_x double, court_y double, residual_cm double")
    write_court(rows, str(tmp_path / "court"))
    assert read_court(spark, str(tmp_path / "court")).first().image_y == 0.2
    write_settings({"quiet_speed": 0.9}, str(tmp_path / "set"), spark)
    assert read_settings(spark, str(tmp_path / "set"), {"quiet_speed"}) == {"quiet_speed": 0.9}


def test_stride_and_span(spark, tmp_path):
    np.save(tmp_path / "clip.npy", np.zeros((50, 4, 4, 3), np.uint8))
    got = read_frames(spark, str(tmp_path / "clip.npy"), fps=10, start_s=1, duration_s=2, stride=3)
    assert sorted(r.frame_index for r in got.collect()) == list(range(10, 30, 3))


def test_files(spark, tmp_path):
    (tmp_path / "labels.json").write_text('{"video": "v", "marks": [{"time_s": 1.5, "kind": "volley"}, {"time_s": 2.5, "extra": 1}]}')
    assert [(r.time_s, r.kind) for r in read_labels(spark, str(tmp_path / "labels.json")).collect()] == [(1.5, "volley"), (2.5, "rally")]
    (tmp_path / "court.json").write_text('{"points": [{"name": "tee", "image": [0.1, 0.2], "court": [3.2, 4.26]}]}')
    assert read_court(spark, str(tmp_path / "court.json")).first().image_y == 0.2
    (tmp_path / "set.json").write_text('{"parameters": {"quiet_speed": 0.9}}')
    assert read_settings(spark, str(tmp_path / "set.json"), {"quiet_speed"}) == {"quiet_speed": 0.9}
    with pytest.raises(ValueError):
        read_settings(spark, str(tmp_path / "set.json"), {"min_break"})


def test_identity_is_put_right():
    blob = lambda x, shirt: vision.Blob(x, 50.0, int(x) - 8, 20, 16, 60, 900, float(shirt[0]), shirt)
    a, b = (200, 128, 128), (60, 128, 128)
    p = tracker.Pursuit((a, b))
    p.bodies = [tracker.Body(blob(100, b), 0, p.anchors, p.rule), tracker.Body(blob(300, a), 1, p.anchors, p.rule)]
    for body in p.bodies:
        body.leans = 10
    out = tracker.Sample([blob(100, b), blob(300, a)], [None, None])
    p._reconcile(out)
    assert out.slots[0].cx == 300 and p.bodies[0].slot == 0


def test_one_body_is_reported_once():
    p = tracker.Pursuit()
    real, guess = vision.Blob(10, 10, 0, 0, 5, 5, 500), vision.Blob(15, 12, 0, 0, 5, 5, 0, source="predicted")
    out = tracker.Sample([real, guess], [None, None])
    p._separate(out)
    assert out.slots == [real, None]
