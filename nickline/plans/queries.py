"""The engine's queries over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import COURT
from ..operators import geometry, matching, outcomes, segments, shots, tracks
from . import bridge
from .oracles import STEPS, alpha_beta, box, chain

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(*names: str):
    return [F.round(F.col(n), 6).alias(n) for n in names]


def s6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_track = bridge.track


@query("speeds", chain(f"SELECT match_id, slot, k, {s6('speed')} FROM sp", "sp"))
def q_speeds(spark, d):
    return tracks.speeds(_track(spark, d)).select("match_id", "slot", "k", *r6("speed"))


@query("activity", chain(f"SELECT match_id, k, {s6('activity')} FROM act", "act"))
def q_activity(spark, d):
    return tracks.activity(_track(spark, d)).select("match_id", "k", *r6("activity"))


@query("resting", chain("SELECT match_id, k, resting FROM rest", "rest"))
def q_resting(spark, d):
    return segments.resting(_track(spark, d)).select("match_id", "k", "resting")


@query("breaks", chain(f"SELECT match_id, {s6('start_s', 'end_s')} FROM br", "br"))
def q_breaks(spark, d):
    return segments.breaks(segments.resting(_track(spark, d))).select("match_id", *r6("start_s", "end_s"))


def _rallies(spark, d):
    return segments.rallies(segments.resting(_track(spark, d)))


@query("rallies", chain(f"SELECT match_id, CAST(rally_index AS INT) AS rally_index, {s6('start_s', 'end_s')}, round(end_s - start_s, 6) AS duration FROM ra", "ra"))
def q_rallies(spark, d):
    return _rallies(spark, d).withColumn("duration", F.col("end_s") - F.col("start_s")).select("match_id", "rally_index", *r6("start_s", "end_s", "duration"))


@query("rally_ends", chain(f"SELECT match_id, {s6('end_s')} FROM ra", "ra"))
def q_rally_ends(spark, d):
    return _rallies(spark, d).select("match_id", *r6("end_s"))


@query("occupancy", chain(f"SELECT match_id, k, {s6('occupancy')} FROM occ", "occ"))
def q_occupancy(spark, d):
    return segments.occupancy(_track(spark, d)).select("match_id", "k", *r6("occupancy"))


@query("play_segments", chain(f"SELECT match_id, {s6('start_s', 'end_s')}, playing FROM seg", "seg"))
def q_play_segments(spark, d):
    return segments.play_segments(_track(spark, d)).select("match_id", *r6("start_s", "end_s"), "playing")


@query("suppress_breaks", chain("SELECT t.match_id, CAST(count(x) FILTER (NOT coalesce(playing, false)) AS BIGINT) AS dropped FROM t LEFT JOIN seg g ON t.match_id = g.match_id AND t.time_s BETWEEN g.start_s AND g.end_s GROUP BY 1", "t", "seg"))
def q_suppress(spark, d):
    t = _track(spark, d)
    return segments.suppress_breaks(t, segments.play_segments(t))[1]


@query("rallies_in_play", chain(f"SELECT match_id, CAST(rally_index AS INT) AS rally_index, {s6('start_s', 'end_s')} FROM rap", "rap"))
def q_rallies_in_play(spark, d):
    t = _track(spark, d)
    return segments.rallies(segments.resting(t, segments.play_segments(t))).select("match_id", "rally_index", *r6("start_s", "end_s"))


_H = geometry.MATRIX


def _apply(m, x, y, i):
    row = lambda r: f"({m[r][0]}::DOUBLE * {x} + {m[r][1]}::DOUBLE * {y} + {m[r][2]}::DOUBLE)"
    return f"CASE WHEN abs{row(2)} < 1e-12::DOUBLE THEN 'nan'::DOUBLE ELSE {row(i)} / {row(2)} END"


def _inverse():
    import numpy as np

    return np.linalg.inv(np.array(_H)).tolist()


_I = _inverse()
_FOOT = f"SELECT match_id, slot, k, k % 13 = 0 AS coasted, {_apply(_I, 'x', 'y', 0)} + CASE WHEN k % 17 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS fx, {_apply(_I, 'x', 'y', 1)} AS fy FROM t"
_PROJ = f"SELECT *, CASE WHEN NOT coasted THEN {_apply(_H, 'fx', 'fy', 0)} END AS px, CASE WHEN NOT coasted THEN {_apply(_H, 'fx', 'fy', 1)} END AS py FROM foot"
_INSIDE = "px BETWEEN -0.5::DOUBLE AND 6.9::DOUBLE AND py BETWEEN -0.5::DOUBLE AND 10.25::DOUBLE AND NOT isnan(px) AND NOT isnan(py)"


def _foot(spark, d):
    x, y = geometry.applied(_I, F.col("x"), F.col("y"))
    return _track(spark, d).select("match_id", "slot", "k", (F.col("k") % 13 == 0).alias("coasted"), (x + F.when(F.col("k") % 17 == 0, 0.5).otherwise(0.0)).alias("fx"), y.alias("fy"))


@query("project_homography", chain(f"SELECT match_id, slot, k, CASE WHEN {_INSIDE} THEN round(px, 6) END AS x, CASE WHEN {_INSIDE} THEN round(py, 6) END AS y, coalesce(px IS NOT NULL AND NOT ({_INSIDE}), false) AS off FROM proj", "t", foot=_FOOT, proj=_PROJ))
def q_project(spark, d):
    return geometry.project(_foot(spark, d), _H).select("match_id", "slot", "k", *r6("x", "y"), "off")


@query("project_dropped", chain(f"SELECT match_id, CAST(count(*) FILTER (coalesce(px IS NOT NULL AND NOT ({_INSIDE}), false)) AS BIGINT) AS dropped FROM proj GROUP BY 1", "t", foot=_FOOT, proj=_PROJ))
def q_dropped(spark, d):
    return geometry.project(_foot(spark, d), _H).groupBy("match_id").agg(F.sum(F.col("off").cast("bigint")).alias("dropped"))


@query("image_points", chain(f"SELECT match_id, slot, k, round({_apply(_I, 'x', 'y', 0)}, 6) AS u, round({_apply(_I, 'x', 'y', 1)}, 6) AS v FROM t", "t"))
def q_image(spark, d):
    u, v = geometry.applied(_I, F.col("x"), F.col("y"))
    return _track(spark, d).select("match_id", "slot", "k", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


@query("service_box", chain(f"SELECT match_id, slot, k, {box('x', 'y')} AS box FROM t", "t"))
def q_box(spark, d):
    return _track(spark, d).select("match_id", "slot", "k", geometry.service_box(F.col("x"), F.col("y")).alias("box"))


@query("serve_ready", chain("SELECT match_id, k, CAST(server AS INT) AS server, server IS NOT NULL AS ready FROM sr", "sr"))
def q_serve(spark, d):
    return geometry.serve_ready(tracks.samples(_track(spark, d))).select("match_id", "k", "server", "ready")


@query("plan_points", chain("SELECT match_id, slot, k, CAST(round_even(26.0::DOUBLE + x * 46.0::DOUBLE, 0) AS INT) AS px, CAST(round_even(26.0::DOUBLE + y * 46.0::DOUBLE, 0) AS INT) AS py FROM t", "t"))
def q_plan(spark, d):
    px, py = geometry.plan_point(F.col("x"), F.col("y"))
    return _track(spark, d).select("match_id", "slot", "k", px.alias("px"), py.alias("py"))


# The floor's named points in metres.
_MARKS = """('front_left_corner', 0.0::DOUBLE, 0.0::DOUBLE), ('front_right_corner', 6.4, 0.0), ('back_left_corner', 0.0, 9.75), ('back_right_corner', 6.4, 9.75),
  ('short_left', 0.0, 4.26), ('short_right', 6.4, 4.26), ('tee', 3.2, 4.26), ('half_court_back', 3.2, 9.75),
  ('box_left_inner_front', 1.6, 4.26), ('box_left_outer_back', 0.0, 5.86), ('box_left_inner_back', 1.6, 5.86),
  ('box_right_inner_front', 4.8, 4.26), ('box_right_outer_back', 6.4, 5.86), ('box_right_inner_back', 4.8, 5.86)"""


@query("landmarks", f"SELECT name, round(court_x, 6) AS court_x, round(court_y, 6) AS court_y FROM (VALUES {_MARKS}) AS v(name, court_x, court_y)")
def q_landmarks(spark, d):
    return spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in geometry.landmarks().items()], "name string, court_x double, court_y double").select("name", *r6("court_x", "court_y"))


@query("residuals", f"WITH p AS (SELECT name, court_x, court_y, {_apply(_I, 'court_x', 'court_y', 0)} + 0.001::DOUBLE AS image_x, {_apply(_I, 'court_x', 'court_y', 1)} AS image_y FROM (VALUES {_MARKS}) AS v(name, court_x, court_y)) SELECT name, round(100 * sqrt(pow({_apply(_H, 'image_x', 'image_y', 0)} - court_x, 2) + pow({_apply(_H, 'image_x', 'image_y', 1)} - court_y, 2)), 6) AS residual_cm FROM p")
def q_residuals(spark, d):
    u, v = geometry.applied(_I, F.col("court_x"), F.col("court_y"))
    points = q_landmarks(spark, d).withColumn("image_x", u + 0.001).withColumn("image_y", v)
    return geometry.residuals(points, _H).select("name", *r6("residual_cm"))


_LOW = "greatest(" + ", ".join(f"({_I[1][0]}::DOUBLE * {x}::DOUBLE + {_I[1][1]}::DOUBLE * m + {_I[1][2]}::DOUBLE) / ({_I[2][0]}::DOUBLE * {x}::DOUBLE + {_I[2][1]}::DOUBLE * m + {_I[2][2]}::DOUBLE)" for x in (0.0, 3.2, 6.4)) + ")"


@query("visible_depth", f"WITH RECURSIVE b AS (SELECT 0 AS n, 0.0::DOUBLE AS lo, 9.75::DOUBLE AS hi UNION ALL SELECT n + 1, CASE WHEN low > 1.0::DOUBLE THEN lo ELSE m END, CASE WHEN low > 1.0::DOUBLE THEN m ELSE hi END FROM (SELECT *, {_LOW} AS low FROM (SELECT *, (lo + hi) / 2 AS m FROM b WHERE n < 40))) SELECT round(lo, 6) AS depth FROM b WHERE n = 40")
def q_depth(spark, d):
    return spark.createDataFrame([(round(geometry.visible_depth(_I), 6),)], "depth double")


@query("median_filter", chain(f"SELECT match_id, slot, k, {s6('x', 'y')} FROM md", "md"))
def q_median(spark, d):
    return tracks.median_filter(_track(spark, d)).select("match_id", "slot", "k", *r6("x", "y"))


@query("alpha_beta", chain(f"SELECT match_id, slot, k, {s6('x', 'y')}, solid FROM ab WHERE k >= 0", "t", recursive=True, ab=alpha_beta("t")))
def q_alpha(spark, d):
    return tracks.alpha_beta(_track(spark, d)).select("match_id", "slot", "k", *r6("x", "y"), "solid")


@query("smoothed", chain(f"SELECT match_id, slot, k, {s6('x', 'y')}, solid FROM ab WHERE k >= 0", "md", recursive=True, ab=alpha_beta("md")))
def q_smoothed(spark, d):
    return tracks.smoothed(_track(spark, d)).select("match_id", "slot", "k", *r6("x", "y"), "solid")


@query("coasted", chain("SELECT match_id, CAST(count(*) FILTER (x IS NOT NULL AND NOT solid) AS BIGINT) AS coasted FROM ab WHERE k >= 0 GROUP BY 1", "md", recursive=True, ab=alpha_beta("md")))
def q_coasted(spark, d):
    return tracks.coasted(tracks.smoothed(_track(spark, d)))


@query("distance_covered", chain("SELECT match_id, slot, round(coalesce(sum(speed * 0.1::DOUBLE) FILTER (speed * 0.1::DOUBLE <= 0.7::DOUBLE), 0), 6) AS metres FROM sp GROUP BY 1, 2", "sp"))
def q_distance(spark, d):
    return tracks.distance_covered(_track(spark, d)).select("match_id", "slot", *r6("metres"))


@query("peak_speed", chain("SELECT match_id, slot, round(coalesce(max(speed), 0), 6) AS peak FROM sp GROUP BY 1, 2", "sp"))
def q_peak(spark, d):
    return tracks.peak_speed(_track(spark, d)).select("match_id", "slot", *r6("peak"))


_SUM = ("metres", "mean_x", "mean_y", "front", "min_x", "max_x", "min_y", "max_y", "peak", "raw_peak")


@query("court_summary", chain(
    f"SELECT match_id, slot, positions, {s6(*_SUM)} FROM (SELECT match_id, slot, count(x) AS positions, coalesce(sum(step) FILTER (step <= 0.7::DOUBLE), 0) AS metres, avg(x) AS mean_x, avg(y) AS mean_y, 100.0::DOUBLE * count(*) FILTER (y < 4.26::DOUBLE) / count(x) AS front, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, coalesce(max(step / 0.1::DOUBLE), 0) AS peak FROM st GROUP BY 1, 2) JOIN (SELECT match_id, slot, coalesce(max(speed), 0) AS raw_peak FROM sp GROUP BY 1, 2) USING (match_id, slot)",
    "sp", "md", st="SELECT *, sqrt(pow(x - lag(x) OVER pl, 2) + pow(y - lag(y) OVER pl, 2)) AS step FROM md WINDOW pl AS (PARTITION BY match_id, slot ORDER BY k)"))
def q_summary(spark, d):
    t = _track(spark, d)
    return tracks.court_summary(t, tracks.median_filter(t)).select("match_id", "slot", "positions", *r6(*_SUM))


@query("radial", chain("SELECT match_id, slot, k, round(sqrt(pow(x - 3.2::DOUBLE, 2) + pow(y - 4.26::DOUBLE, 2)), 6) AS radial FROM t", "t"))
def q_radial(spark, d):
    return tracks.radial(_track(spark, d), COURT).select("match_id", "slot", "k", *r6("radial"))


def _smooth(track, rallies):
    return shots.range_smooth(shots.within(tracks.radial(track), rallies))


def _rows(spark, d):
    return _smooth(*_held(spark, d))


@query("range_smooth", chain(f"SELECT match_id, CAST(rally_index AS INT) AS rally_index, slot, k, {s6('smooth')} FROM sm", "sm"))
def q_range(spark, d):
    return _rows(spark, d).select("match_id", "rally_index", "slot", "k", *r6("smooth"))


@query("local_peaks", chain(f"SELECT match_id, CAST(rally_index AS INT) AS rally_index, slot, k, {s6('smooth')} FROM pk", "pk"))
def q_peaks(spark, d):
    return shots.local_peaks(_rows(spark, d)).select("match_id", "rally_index", "slot", "k", *r6("smooth"))


@query("prominence", chain(f"SELECT match_id, CAST(rally_index AS INT) AS rally_index, slot, {s6('time_s', 'prominence')} FROM pm", "pm"))
def q_prominence(spark, d):
    return shots.prominent(_rows(spark, d)).select("match_id", "rally_index", "slot", *r6("time_s", "prominence"))


@query("peak_suppression", chain(f"SELECT match_id, CAST(rally_index AS INT) AS rally_index, slot, {s6('time_s', 'prominence')} FROM ca", "ca"))
def q_nms(spark, d):
    return shots.candidates(_rows(spark, d)).select("match_id", "rally_index", "slot", *r6("time_s", "prominence"))


@query("server", chain("SELECT match_id, CAST(rally_index AS INT) AS rally_index, CAST(server AS INT) AS server FROM se", "se"))
def q_server(spark, d):
    return shots.servers(_track(spark, d), _rallies(spark, d))


# Every eleventh sample one player stands in a box and the other waits behind the other half.
_SERVED = "SELECT match_id, k, slot, time_s, blobs, CASE WHEN x IS NULL OR k % 11 <> 0 THEN x WHEN slot = (k // 11) % 2 THEN 5.4::DOUBLE ELSE 1.6::DOUBLE END AS x, CASE WHEN y IS NULL OR k % 11 <> 0 THEN y WHEN slot = (k // 11) % 2 THEN 5.0::DOUBLE ELSE 7.0::DOUBLE END AS y FROM t"
_SERVE_STEPS = {"t2": _SERVED, "s2": STEPS["s"].replace("FROM t ", "FROM t2 "), "sb2": STEPS["sb"].replace("FROM s", "FROM s2"), "sr2": STEPS["sr"].replace("FROM sb", "FROM sb2"), "se2": STEPS["se"].replace("sr.", "sr2.").replace("FROM sr ", "FROM sr2 ")}


def _served(track, rallies):
    there, own = F.col("x").isNull() | (F.col("k") % 11 != 0), F.col("slot") == F.expr("(k div 11) % 2")
    put = lambda c, a, b: F.when(there, F.col(c)).when(own, a).otherwise(b).alias(c)
    return shots.servers(track.select("match_id", "k", "slot", "time_s", "blobs", put("x", 5.4, 1.6), put("y", 5.0, 7.0)), rallies)


def _servers(spark, d):
    return _served(_track(spark, d), _rallies(spark, d))


@query("server_in_box", chain("SELECT match_id, CAST(rally_index AS INT) AS rally_index, CAST(server AS INT) AS server FROM se2", "t", "ra", **_SERVE_STEPS))
def q_server_in_box(spark, d):
    return _servers(spark, d)


@query("served_alternation", chain(f"SELECT match_id, CAST(rally_index AS INT) AS rally_index, slot, {s6('time_s')}, taken FROM al2", "ca", "ra", "t", **_SERVE_STEPS, al2=STEPS["al"].replace("JOIN se ", "JOIN se2 ")))
def q_served_alternation(spark, d):
    t, r = _held(spark, d)
    return shots.alternated(shots.candidates(_smooth(t, r)), _served(t, r)).select("match_id", "rally_index", "slot", *r6("time_s"), "taken")


@query("alternation", chain(f"SELECT match_id, CAST(rally_index AS INT) AS rally_index, slot, {s6('time_s')}, taken FROM al", "al"))
def q_alternation(spark, d):
    t, r = _held(spark, d)
    return shots.alternated(shots.candidates(_smooth(t, r)), shots.servers(t, r)).select("match_id", "rally_index", "slot", *r6("time_s"), "taken")


_POINT = "CASE WHEN event_type = 'purchase' AND event_id % 40 = 0 THEN event_id END AS point"


def _held(spark, d):
    """The track and its rallies, each made once: what looks samples up in rallies reads both several times."""
    t = _track(spark, d).select("match_id", "k", "slot", "time_s", "blobs", "x", "y", F.expr(_POINT)).localCheckpoint()
    return t, segments.between(segments.rest_runs(t)).localCheckpoint()


def _shots(spark, d):
    return shots.shots(*_held(spark, d))


@query("shots", chain(f"SELECT match_id, CAST(rally_index AS INT) AS rally_index, {s6('time_s')}, player, {s6('position_x_m', 'position_y_m')}, 'radial_peak' AS source FROM sh", "sh"))
def q_shots(spark, d):
    return _shots(spark, d)[0].select("match_id", "rally_index", *r6("time_s"), "player", *r6("position_x_m", "position_y_m"), "source")


@query("shot_stats", chain("SELECT ra.match_id, CAST(ra.rally_index AS INT) AS rally_index, round(end_s - start_s, 6) AS duration, coalesce(candidates, 0) AS candidates, coalesce(dropped, 0) AS dropped, coalesce(anchored, false) AS anchored FROM ra LEFT JOIN (SELECT match_id, rally_index, count(*) AS candidates, count(*) FILTER (NOT taken) AS dropped, bool_or(server IS NOT NULL) AS anchored FROM al GROUP BY 1, 2) a ON a.match_id = ra.match_id AND a.rally_index = ra.rally_index", "ra", "al"))
def q_stats(spark, d):
    return _shots(spark, d)[1].select("match_id", "rally_index", *r6("duration"), "candidates", "dropped", "anchored")


@query("shot_summary", chain("SELECT match_id, count(*) AS shots, count(DISTINCT rally_index) AS rallies, round(median(gap), 6) AS median_interval FROM (SELECT *, time_s - lag(time_s) OVER (PARTITION BY match_id, rally_index ORDER BY time_s) AS gap FROM sh) GROUP BY 1", "sh"))
def q_shot_summary(spark, d):
    return shots.shot_summary(_shots(spark, d)[0]).select("match_id", "shots", "rallies", *r6("median_interval"))


def _pointed(track):
    t = track.filter("point is not null")
    return t.select("match_id", (F.col("point") % 2).cast("int").alias("row"), F.least(F.expr("k div 400"), F.lit(4)).cast("int").alias("game"), "time_s")


def _points(spark, d):
    return _pointed(_track(spark, d).select("*", F.expr(_POINT)))


@query("nearest_point", chain(f"SELECT match_id, CAST(rally_index AS INT) AS rally_index, {s6('end_s', 'point_s')}, row, game FROM rp", "rp"))
def q_nearest(spark, d):
    return outcomes.rally_points(_rallies(spark, d), _points(spark, d)).select("match_id", "rally_index", *r6("end_s", "point_s"), "row", "game")


@query("hitters", chain("SELECT match_id, CAST(rally_index AS INT) AS rally_index, CAST(server AS INT) AS server, CAST(last_hitter AS INT) AS last_hitter FROM hi", "hi"))
def q_hitters(spark, d):
    return outcomes.hitters(_shots(spark, d)[0])


@query("row_votes", chain(f"SELECT match_id, crossed, {s6('agreement')}, CAST(votes AS BIGINT) AS votes FROM vo", "vo"))
def q_votes(spark, d):
    t, r = _held(spark, d)
    return outcomes.row_votes(r, shots.shots(t, r)[0], _pointed(t)).select("match_id", "crossed", *r6("agreement"), "votes")


def _outcomes(spark, d):
    t, r = _held(spark, d)
    return outcomes.outcomes(r, shots.shots(t, r)[0], _pointed(t))


@query("outcomes", chain(f"SELECT match_id, CAST(rally_index AS INT) AS rally_index, {s6('end_s')}, kind, scorer, game FROM ou", "ou"))
def q_outcomes(spark, d):
    return _outcomes(spark, d).select("match_id", "rally_index", *r6("end_s"), "kind", "scorer", "game")


@query("game_tally", chain("SELECT match_id, game, count(*) FILTER (kind = 'winner') AS winners, count(*) FILTER (kind = 'error') AS errors, count(*) FILTER (kind = 'let') AS lets, count(*) FILTER (kind <> 'let' AND scorer = 0) AS points_0, count(*) FILTER (kind <> 'let' AND scorer = 1) AS points_1 FROM ou GROUP BY 1, 2", "ou"))
def q_tally(spark, d):
    return outcomes.game_tally(_outcomes(spark, d))


def _match_pairs(spark, d):
    return matching.greedy_match(_rallies(spark, d).select("match_id", F.col("end_s").alias("time_s")), _points(spark, d).select("match_id", "time_s"), 5.0)


_NEAR = "list_sort(list_transform(list_filter(free, lambda r: abs(r - time_s) <= 5.0::DOUBLE), lambda r: {'d': abs(r - time_s), 'r': r}))"
_GREEDY = {
    "de": "SELECT match_id, end_s AS time_s, row_number() OVER (PARTITION BY match_id ORDER BY end_s) AS i FROM ra",
    "fr": "SELECT m.match_id, coalesce(list_sort(list(p.time_s) FILTER (p.time_s IS NOT NULL)), []) AS free FROM (SELECT match_id FROM ra UNION SELECT match_id FROM po) m LEFT JOIN po p USING (match_id) GROUP BY 1",
    "gr": f"""SELECT match_id, 0 AS i, free, NULL::DOUBLE AS detected_s, NULL::DOUBLE AS reference_s FROM fr UNION ALL
      SELECT match_id, i + 1, CASE WHEN len(near) > 0 THEN list_filter(free, lambda r: r <> near[1].r) ELSE free END, time_s, near[1].r FROM (SELECT g.match_id, g.i, g.free, d.time_s, {_NEAR} AS near FROM gr g JOIN de d ON d.match_id = g.match_id AND d.i = g.i + 1)""",
    "pr": "SELECT match_id, detected_s, reference_s FROM gr WHERE i > 0 UNION ALL SELECT match_id, NULL, unnest(free) FROM (SELECT match_id, arg_max(free, i) AS free FROM gr GROUP BY 1)",
}


@query("greedy_match", chain(f"SELECT match_id, {s6('detected_s', 'reference_s')} FROM pr", "ra", "po", recursive=True, **_GREEDY))
def q_greedy(spark, d):
    return _match_pairs(spark, d).select("match_id", *r6("detected_s", "reference_s"))


@query("match_scores", chain("SELECT match_id, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0 END, 6) AS f1 FROM (SELECT match_id, count(*) FILTER (detected_s IS NOT NULL AND reference_s IS NOT NULL) AS tp, count(*) FILTER (reference_s IS NULL) AS fp, count(*) FILTER (detected_s IS NULL) AS fn FROM pr GROUP BY 1)", "ra", "po", recursive=True, **_GREEDY))
def q_scores(spark, d):
    return matching.scores(_match_pairs(spark, d)).select("match_id", "tp", "fp", "fn", *r6("precision", "recall", "f1"))
