"""Queries of fitting, scoreboard and identity, and their SQL."""

from __future__ import annotations

import itertools

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import fitting, identity, scoreboard, segments, shots, tracks
from . import bridge
from .oracles import _rallies as rallies_sql
from .oracles import chain
from .queries import _NEAR, _held, _points, _rallies, _shots, query, r6, s6

_track = bridge.track


def _marks(spark, d):
    t = _track(spark, d).filter("event_type in ('click', 'view') and event_id % 25 = 0")
    return t.select("match_id", "time_s", F.when(F.col("event_id") % 175 == 0, "volley").otherwise("shot").alias("kind"))


_MARKS = "SELECT match_id, time_s, CASE WHEN event_id % 175 = 0 THEN 'volley' ELSE 'shot' END AS kind FROM t WHERE event_type IN ('click', 'view') AND event_id % 25 = 0"


@query("marks", chain(f"SELECT match_id, {s6('time_s')}, kind FROM mk", "t", mk=_MARKS))
def q_marks(spark, d):
    return _marks(spark, d).select("match_id", *r6("time_s"), "kind")


@query("window_slice", chain("SELECT match_id, count(*) AS n, min(k) AS first_k, max(k) AS last_k FROM t WHERE time_s >= 10.0::DOUBLE AND time_s < 30.0::DOUBLE GROUP BY 1", "t"))
def q_slice(spark, d):
    return segments.within_span(_track(spark, d), 10.0, 30.0).groupBy("match_id").agg(F.count("*").alias("n"), F.min("k").alias("first_k"), F.max("k").alias("last_k"))


@query("excluding", chain("SELECT match_id, CASE WHEN time_s < 10.0::DOUBLE THEN 0 ELSE 1 END AS piece, count(*) AS n FROM t WHERE time_s < 10.0::DOUBLE OR time_s >= 30.0::DOUBLE GROUP BY 1, 2", "t"))
def q_excluding(spark, d):
    return segments.excluding(_track(spark, d), 10.0, 30.0).groupBy("match_id", "piece").agg(F.count("*").alias("n"))


@query("time_blocks", chain("SELECT match_id, CAST(fold AS INT) AS fold, round(a + (b - a) * fold / 3, 6) AS lo, round(a + (b - a) * (fold + 1) / 3, 6) AS hi FROM (SELECT match_id, min(time_s) AS a, max(time_s) AS b FROM t GROUP BY 1), (SELECT unnest([0, 1, 2]) AS fold)", "t"))
def q_blocks(spark, d):
    return fitting.time_blocks(_track(spark, d)).select("match_id", "fold", *r6("lo", "hi"))


_GRID = ", ".join(f"({i}, {q}::DOUBLE, {b}::DOUBLE, {v}::DOUBLE)" for i, (q, b, v) in enumerate(itertools.product(*fitting.GRID.values())))
#: Every setting as a match of its own, numbered match_id * 1000 + param.
_SEARCH = {
    "gp": f"SELECT * FROM (VALUES {_GRID}) AS v(param, quiet_speed, min_break, serve_bonus)",
    "gs": "SELECT CAST(a.match_id * 1000 + param AS BIGINT) AS match_id, a.k, a.time_s, min_break, activity IS NULL OR activity < CASE WHEN server IS NOT NULL AND serve_bonus <> 1 THEN quiet_speed * serve_bonus ELSE quiet_speed END AS resting FROM act a JOIN sr USING (match_id, k), gp",
    "gb": "SELECT match_id, min(time_s) AS start_s, max(time_s) AS end_s FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY k) - row_number() OVER (PARTITION BY match_id, resting ORDER BY k) AS g FROM gs) WHERE resting GROUP BY match_id, g, min_break HAVING max(time_s) - min(time_s) >= min_break",
    "gl": rallies_sql("gb", "gs"),
    "gd": "SELECT match_id, end_s AS time_s, row_number() OVER (PARTITION BY match_id ORDER BY end_s) AS i FROM gl",
    "gf": "SELECT m.match_id, coalesce(list_sort(list(p.time_s) FILTER (p.time_s IS NOT NULL)), []) AS free FROM (SELECT DISTINCT match_id FROM gs) m LEFT JOIN po p ON p.match_id = m.match_id // 1000 GROUP BY 1",
    "gg": f"""SELECT match_id, 0 AS i, free, 0 AS tp, 0 AS fp FROM gf UNION ALL
      SELECT match_id, i + 1, CASE WHEN len(near) > 0 THEN list_filter(free, lambda r: r <> near[1].r) ELSE free END, tp + CASE WHEN len(near) > 0 THEN 1 ELSE 0 END, fp + CASE WHEN len(near) > 0 THEN 0 ELSE 1 END FROM (SELECT g.*, {_NEAR} AS near FROM gg g JOIN gd d ON d.match_id = g.match_id AND d.i = g.i + 1)""",
    "gc": "SELECT match_id // 1000 AS match_id, CAST(match_id % 1000 AS INT) AS param, arg_max(tp, i) AS tp, arg_max(fp, i) AS fp, arg_max(len(free), i) AS fn FROM gg GROUP BY gg.match_id",
}


@query("grid_search", chain("SELECT CAST(match_id AS INT) AS match_id, param, quiet_speed, min_break, serve_bonus, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY f1 DESC, param) AS n FROM (SELECT *, CASE WHEN tp > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0 END AS f1 FROM gc JOIN gp USING (param))) WHERE n = 1", "act", "sr", "po", recursive=True, **_SEARCH))
def q_grid(spark, d):
    return fitting.grid_search(_track(spark, d), _points(spark, d).select("match_id", "time_s")).select("match_id", "param", "quiet_speed", "min_break", "serve_bonus", "tp", "fp", "fn", *r6("f1"))


@query("time_block_cv")
def q_cv(spark, d):
    return fitting.cross_validate(_track(spark, d), _points(spark, d).select("match_id", "time_s")).select("match_id", "fold", "param", "tp", "fp", "fn", *r6("precision", "recall", "f1"))


def _radial_rows(spark, d):
    t, r = _held(spark, d)
    return shots.within(tracks.radial(t), r)


_REACH = """SELECT match_id, rally_index, slot, k, ms, CASE WHEN n >= 2 THEN (l - f) / 1.0::DOUBLE END AS radial_v, CASE WHEN n >= 2 THEN l - m END AS out_reach FROM (
  SELECT *, count(radial) OVER w AS n, first_value(radial IGNORE NULLS) OVER w AS f, last_value(radial IGNORE NULLS) OVER w AS l, min(radial) OVER w AS m FROM rw WINDOW w AS (PARTITION BY match_id, rally_index, slot ORDER BY k ROWS BETWEEN 10 PRECEDING AND CURRENT ROW))"""


@query("reach_features", chain(f"SELECT match_id, CAST(rally_index AS INT) AS rally_index, slot, k, {s6('radial_v', 'out_reach')} FROM re", "rw", re=_REACH))
def q_reach(spark, d):
    return fitting.reach(_radial_rows(spark, d)).select("match_id", "rally_index", "slot", "k", *r6("radial_v", "out_reach"))


_FEATURES = """SELECT g.match_id, g.rally_index, g.time_s, g.player, CASE WHEN ok THEN g.position_y_m - 4.26::DOUBLE END AS depth_short, CASE WHEN ok THEN gap / middle END AS interval_norm, CASE WHEN ok THEN radial_v END AS radial_v, CASE WHEN ok THEN out_reach END AS out_reach FROM (
  SELECT g.*, r.radial_v, r.out_reach, gap IS NOT NULL AND middle > 1e-6::DOUBLE AND r.radial_v IS NOT NULL AS ok FROM (
    SELECT *, median(gap) OVER (PARTITION BY match_id, rally_index) AS middle, count(*) OVER (PARTITION BY match_id, rally_index) AS n FROM (SELECT *, time_s - lag(time_s) OVER (PARTITION BY match_id, rally_index ORDER BY time_s) AS gap FROM sh)) g
  LEFT JOIN re r ON r.match_id = g.match_id AND r.rally_index = g.rally_index AND r.slot = g.player AND r.ms = CAST(round(g.time_s * 1000) AS BIGINT) WHERE g.n >= 2) g"""


@query("volley_features", chain(f"SELECT match_id, CAST(rally_index AS INT) AS rally_index, {s6('time_s')}, player, {s6('depth_short', 'interval_norm', 'radial_v', 'out_reach')} FROM fe", "rw", "sh", re=_REACH, fe=_FEATURES))
def q_features(spark, d):
    found = fitting.volley_features(_shots(spark, d)[0], _radial_rows(spark, d))
    return found.select("match_id", "rally_index", *r6("time_s"), "player", *r6("depth_short", "interval_norm", "radial_v", "out_reach"))


@query("label_join", chain(
    f"SELECT match_id, CAST(rally_index AS INT) AS rally_index, {s6('time_s')}, player, CAST(CASE WHEN v IS NOT NULL AND (o IS NULL OR v <= o) THEN 1 WHEN o IS NOT NULL THEN 0 END AS INT) AS y FROM (SELECT s.match_id, s.rally_index, s.time_s, s.player, min(abs(s.time_s - m.time_s)) FILTER (kind = 'volley') AS v, min(abs(s.time_s - m.time_s)) FILTER (kind <> 'volley') AS o FROM sh s LEFT JOIN mk m ON m.match_id = s.match_id AND abs(s.time_s - m.time_s) <= 1.0::DOUBLE GROUP BY 1, 2, 3, 4)",
    "sh", mk=_MARKS))
def q_labels(spark, d):
    return fitting.volley_labels(_shots(spark, d)[0], _marks(spark, d)).select("match_id", "rally_index", *r6("time_s"), "player", "y")


def _labelled(spark, d):
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    return docs.join(labels, "doc_id").select("doc_id", "source", "lang", F.col("toxic").alias("y"), (F.col("n_chars") / 1000.0).alias("size"), (F.col("doc_id") % 7).cast("double").alias("week"))


_LAB = "lab AS (SELECT d.doc_id, source, lang, toxic AS y, n_chars / 1000.0::DOUBLE AS size, CAST(doc_id % 7 AS DOUBLE) AS week FROM documents d JOIN labels USING (doc_id))"


@query("standardise", f"WITH {_LAB} SELECT lang, round(avg(size), 6) AS mean_size, round(CASE WHEN stddev_pop(size) < 1e-9 THEN 1.0::DOUBLE ELSE stddev_pop(size) END, 6) AS std_size FROM lab GROUP BY 1")
def q_standardise(spark, d):
    return fitting.standardised(_labelled(spark, d), ["size"], ("lang",)).select("lang", *r6("mean_size", "std_size"))


@query("logistic")
def q_logistic(spark, d):
    m = fitting.logistic(_labelled(spark, d), ["size", "week"])
    return spark.createDataFrame([(i, round(float(w), 6)) for i, w in enumerate(m["weights"])], "place int, weight double")


@query("group_folds", f"WITH {_LAB} SELECT source, CAST((dense_rank() OVER (ORDER BY source) - 1) % 3 AS INT) AS fold, count(*) AS n FROM lab GROUP BY source")
def q_folds(spark, d):
    return fitting.folds(_labelled(spark, d), "source").groupBy("source", "fold").agg(F.count("*").alias("n"))


@query("average_precision", f"WITH {_LAB}, r AS (SELECT lang, y, row_number() OVER w AS n, sum(y) OVER w AS h FROM lab WINDOW w AS (PARTITION BY lang ORDER BY size DESC, doc_id ROWS UNBOUNDED PRECEDING)) SELECT lang, round(CASE WHEN sum(y) > 0 THEN sum(y * CAST(h AS DOUBLE) / n) / sum(y) ELSE 0 END, 6) AS ap FROM r GROUP BY 1")
def q_ap(spark, d):
    return fitting.average_precision(_labelled(spark, d), ("lang",), "size", "y", "doc_id").select("lang", *r6("ap"))


@query("precision_at_k", f"WITH {_LAB}, r AS (SELECT lang, y, row_number() OVER (PARTITION BY lang ORDER BY size DESC, doc_id) AS n FROM lab) SELECT lang, CAST(k AS INT) AS k, round(avg(y), 6) AS precision FROM r, (SELECT unnest([5, 10, 20]) AS k) WHERE n <= k GROUP BY 1, 2")
def q_at(spark, d):
    return fitting.precision_at(_labelled(spark, d), ("lang",), "size", "y", "doc_id").select("lang", "k", *r6("precision"))


@query("precision_recall", f"WITH {_LAB}, c AS (SELECT lang, count(*) FILTER (size >= 2 AND y = 1) AS tp, count(*) FILTER (size >= 2 AND y = 0) AS fp, count(*) FILTER (size < 2 AND y = 1) AS fn FROM lab GROUP BY 1) SELECT lang, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0 END, 6) AS f1 FROM c")
def q_pr(spark, d):
    return fitting.precision_recall(_labelled(spark, d), "size", "y", ("lang",), 2.0).select("lang", "tp", "fp", "fn", *r6("precision", "recall", "f1"))


@query("cross_validated")
def q_cross(spark, d):
    return fitting.cross_validated(_labelled(spark, d), "source", ["size", "week"]).select("doc_id", "fold", *r6("score"))


#: Patches of four rows; a band is three columns wide.
_WIDTH = 16


def _patches(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    i = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(F.col("label").alias("cell"), i.cast("bigint").alias("i"), F.transform("embedding", lambda v: v.cast("double") * 256).alias("patch"))


_PATCH = "pa AS (SELECT label AS cell, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 256) AS patch FROM embeddings)"
_DIFF = """st AS (SELECT cell, i, max(m) AS difference FROM (SELECT cell, i, ((j - 1) % 16) // 3 AS c, avg(abs(patch[j] - last[j])) AS m FROM (SELECT *, unnest(generate_series(1, 64)) AS j FROM (SELECT *, lag(patch) OVER (PARTITION BY cell ORDER BY i) AS last FROM pa) WHERE last IS NOT NULL) WHERE (j - 1) % 16 < 15 GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query("cell_difference", f"WITH {_PATCH}, {_DIFF} SELECT cell, i, {s6('difference')} FROM st")
def q_difference(spark, d):
    return scoreboard.steps(_patches(spark, d), _WIDTH).filter("difference is not null").select("cell", "i", *r6("difference"))


@query("noise_level", f"WITH {_PATCH}, {_DIFF}, m AS (SELECT cell, median(difference) AS middle FROM st GROUP BY 1) SELECT cell, round(middle, 6) AS middle, round(median(abs(difference - middle)) + 1e-6, 6) AS spread, round(greatest(2.5::DOUBLE, middle + 4 * (median(abs(difference - middle)) + 1e-6)), 6) AS level FROM st JOIN m USING (cell) GROUP BY cell, middle")
def q_level(spark, d):
    return scoreboard.noise_level(scoreboard.steps(_patches(spark, d), _WIDTH)).select("cell", *r6("middle", "spread", "level"))


_STEADY = "pb AS (SELECT cell, i, first_value(patch) OVER (PARTITION BY cell, i // 14 ORDER BY i) AS patch FROM pa)"
_LEVEL = "lv AS (SELECT cell, greatest(2.5::DOUBLE, any_value(middle) + 4.0::DOUBLE * (median(abs(difference - middle)) + 1e-6::DOUBLE)) AS level, count(*) + 1 AS n FROM (SELECT *, median(difference) OVER (PARTITION BY cell) AS middle FROM st) GROUP BY 1 HAVING count(*) >= 2)"
_FAR = "list_max(list_transform([0, 1, 2, 3, 4], lambda c: list_avg(list_transform(list_filter(generate_series(1, 64), lambda j: ((j - 1) % 16) // 3 = c), lambda j: abs({a}[j] - {b}[j])))))"
# place by place: the settled patch, the last change, and the place from which to look on
_SETTLE = f"""wc AS (SELECT l.cell, least(n - 1, 4) AS i, n, level, p.patch AS settled, least(n - 1, 4) + 1 AS due, NULL::BIGINT AS last, NULL::DOUBLE AS magnitude FROM lv l JOIN pb p ON p.cell = l.cell AND p.i = least(n - 1, 4) UNION ALL
  SELECT cell, i, n, level, CASE WHEN turn THEN onward ELSE settled END, CASE WHEN turn THEN i + 6 ELSE due END, CASE WHEN turn AND new THEN i ELSE last END, CASE WHEN turn AND new THEN far END FROM (
    SELECT w.cell, w.i + 1 AS i, w.n, w.level, w.settled, w.due, w.last, a.ahead[len(a.ahead)] AS onward, {_FAR.format(a="a.ahead[1]", b="w.settled")} AS far, w.last IS NULL OR (w.i + 1 - w.last) / 2.0::DOUBLE >= 6.0::DOUBLE AS new,
      w.i + 1 >= w.due AND len(list_filter(a.ahead, lambda q: {_FAR.format(a="q", b="w.settled")} <= w.level)) = 0 AS turn FROM wc w JOIN ah a ON a.cell = w.cell AND a.i = w.i + 1))"""
_AHEAD = "ah AS (SELECT cell, i, list(patch) OVER (PARTITION BY cell ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS ahead FROM pb)"


@query("score_changes", f"WITH RECURSIVE {_PATCH}, {_STEADY}, {_DIFF.replace('FROM pa)', 'FROM pb)')}, {_LEVEL}, {_AHEAD}, {_SETTLE} SELECT cell, i, {s6('magnitude')} FROM wc WHERE magnitude IS NOT NULL")
def q_changes(spark, d):
    held = F.first("patch").over(Window.partitionBy("cell", F.expr("i div 14")).orderBy("i"))
    return scoreboard.score_changes(_patches(spark, d).withColumn("patch", held), _WIDTH).select("cell", "i", *r6("magnitude"))


def _readings(spark, d):
    held = F.first("patch").over(Window.partitionBy("cell", F.expr("i div 4")).orderBy("i"))
    return _patches(spark, d).select("cell", "i", F.when(F.expr("(i div 4) % 7") != 3, F.transform(held, lambda v: F.when(v > 0, 1).otherwise(0))).alias("mask"))


_READ = "rd AS (SELECT cell, i, CASE WHEN (i // 4) % 7 <> 3 THEN list_transform(first_value(patch) OVER (PARTITION BY cell, i // 4 ORDER BY i), lambda v: CASE WHEN v > 0 THEN 1 ELSE 0 END) END AS mask FROM pa)"
_UNLIKE = "CASE WHEN {a} IS NULL OR {b} IS NULL THEN ({a} IS NULL) <> ({b} IS NULL) ELSE len(list_filter(generate_series(1, 64), lambda j: {a}[j] <> {b}[j])) / 64.0::DOUBLE > 0.04::DOUBLE END"
_WALK = f"""wk AS (SELECT cell, i, i AS start, mask AS anchor FROM rd WHERE i = 0 UNION ALL SELECT cell, i, CASE WHEN un THEN i ELSE start END, CASE WHEN un THEN mask ELSE anchor END FROM (SELECT r.cell, r.i, r.mask, w.start, w.anchor, {_UNLIKE.format(a='r.mask', b='w.anchor')} AS un FROM wk w JOIN rd r ON r.cell = w.cell AND r.i = w.i + 1))"""
_RUNS = "ru AS (SELECT cell, start AS i, any_value(anchor) AS mask FROM wk GROUP BY cell, start HAVING count(*) >= 3)"
_SCORE = f"sc AS (SELECT cell, i, CAST(sum(turn) OVER (PARTITION BY cell ORDER BY i) AS BIGINT) AS score, turn FROM (SELECT cell, i, CASE WHEN last IS NOT NULL AND {_UNLIKE.format(a='mask', b='last')} THEN 1 ELSE 0 END AS turn FROM (SELECT *, lag(mask) OVER (PARTITION BY cell ORDER BY i) AS last FROM ru WHERE mask IS NOT NULL)))"


@query("stable_runs", f"WITH RECURSIVE {_PATCH}, {_READ}, {_WALK}, {_RUNS} SELECT cell, i, CAST(list_sum(mask) AS BIGINT) AS ink FROM ru")
def q_runs(spark, d):
    return scoreboard.stable_runs(_readings(spark, d)).select("cell", "i", F.when(F.col("mask").isNotNull(), F.aggregate("mask", F.lit(0), lambda s, x: s + x)).cast("bigint").alias("ink"))


@query("score_points", f"WITH RECURSIVE {_PATCH}, {_READ}, {_WALK}, {_RUNS}, {_SCORE} SELECT cell, i, score AS score_since_start FROM sc WHERE turn = 1")
def q_points(spark, d):
    return scoreboard.points(scoreboard.stable_runs(_readings(spark, d)))


@query("board", f"WITH RECURSIVE {_PATCH}, {_READ}, {_WALK}, {_RUNS}, {_SCORE} SELECT r.cell, CAST(coalesce(max(score) FILTER (turn = 1), 0) AS BIGINT) AS value FROM (SELECT DISTINCT cell FROM ru) r LEFT JOIN sc ON sc.cell = r.cell GROUP BY 1")
def q_board(spark, d):
    return scoreboard.board(scoreboard.stable_runs(_readings(spark, d)))


# Two shirts that tests call the players'.
_A, _B = (110.0, 128.0, 128.0), (150.0, 130.0, 125.0)
_LAB3 = ("l", "a", "b")


def _detections(spark, d):
    e = F.col("event_id")
    return _track(spark, d).filter("x is not null").select(
        "match_id", "k", "slot", "time_s", e.alias("det_id"), (F.col("x") * 40).alias("cx"), (F.col("y") * 40).alias("cy"), (380 + e % 900).alias("area"), (40 + e % 40).alias("h"),
        (100 + e % 60).cast("double").alias("l"), (120 + e % 17).cast("double").alias("a"), (118 + e % 23).cast("double").alias("b"),
    )


_DET = "SELECT match_id, k, slot, time_s, event_id AS det_id, x * 40 AS cx, y * 40 AS cy, 380 + event_id % 900 AS area, 40 + event_id % 40 AS h, CAST(100 + event_id % 60 AS DOUBLE) AS l, CAST(120 + event_id % 17 AS DOUBLE) AS a, CAST(118 + event_id % 23 AS DOUBLE) AS b FROM t WHERE x IS NOT NULL"


def _near(df, shirt, weight=1.0):
    return identity.shirt_distance(tuple(F.col(c) for c in _LAB3), tuple(F.lit(v) for v in shirt), weight)


def _nearsql(shirt, weight=1.0, p=""):
    return f"sqrt({weight}::DOUBLE * pow({p}l - {shirt[0]}::DOUBLE, 2) + pow({p}a - {shirt[1]}::DOUBLE, 2) + pow({p}b - {shirt[2]}::DOUBLE, 2))"


@query("shirt_distance", chain(f"SELECT det_id, round({_nearsql(_A)}, 6) AS near_0, round({_nearsql(_B)}, 6) AS near_1, round({_nearsql(_A, 0.4)}, 6) AS soft_0 FROM dt", "t", dt=_DET))
def q_shirt(spark, d):
    df = _detections(spark, d)
    return df.select("det_id", F.round(_near(df, _A), 6).alias("near_0"), F.round(_near(df, _B), 6).alias("near_1"), F.round(_near(df, _A, 0.4), 6).alias("soft_0"))


_FENCES = [(0.0, 0.0, 0.35, 0.5, None), (0.5, 0.5, 0.8, 0.8, 0.5)]


@query("fences", chain("SELECT det_id FROM (SELECT det_id, cx / 256 AS fx, cy / 390 AS fy, h / 100.0::DOUBLE AS fh FROM dt) WHERE NOT (fx BETWEEN 0 AND 0.35::DOUBLE AND fy BETWEEN 0 AND 0.5::DOUBLE) AND NOT (fx BETWEEN 0.5::DOUBLE AND 0.8::DOUBLE AND fy BETWEEN 0.5::DOUBLE AND 0.8::DOUBLE AND abs(fh - 0.5::DOUBLE) <= 0.30::DOUBLE * 0.5::DOUBLE)", "t", dt=_DET))
def q_fences(spark, d):
    blobs = _detections(spark, d).select("det_id", (F.col("cx") / 256).alias("fx"), (F.col("cy") / 390).alias("fy"), (F.col("h") / 100.0).alias("fh"))
    return identity.unfenced(blobs, spark.createDataFrame(_FENCES, "x0 double, y0 double, x1 double, y1 double, height double")).select("det_id")


@query("largest_blobs", chain("SELECT match_id, s, det_id, place FROM (SELECT match_id, k // 5 AS s, det_id, row_number() OVER (PARTITION BY match_id, k // 5 ORDER BY area DESC, det_id) AS place FROM dt WHERE area >= 400 AND h >= 45) WHERE place <= 4", "t", dt=_DET))
def q_largest(spark, d):
    return identity.largest(_detections(spark, d).withColumn("s", F.expr("k div 5")), ("match_id", "s")).select("match_id", "s", "det_id", F.col("place").cast("bigint").alias("place"))


def _pairs(spark, d):
    df = _detections(spark, d)
    before = Window.partitionBy("match_id", "slot").orderBy("k")
    track = df.select("match_id", "k", "slot", *[F.lag(c).over(before).alias(f"t{c[-1] if c in ('cx', 'cy') else c}") for c in ("cx", "cy", *_LAB3)]).filter("tx is not null")
    other = df.select("match_id", "k", "det_id", "cx", "cy", *_LAB3)
    rows = track.join(other, ["match_id", "k"]).withColumn("gate", F.lit(60.0)).withColumn("misses", F.col("k") % 2)
    near = [_near(rows, _A), _near(rows, _B)]
    rows = rows.withColumn("gap", identity.shirt_distance(tuple(F.col(f"t{c}") for c in _LAB3), tuple(F.col(c) for c in _LAB3)))
    return rows.withColumn("mine", F.when(F.col("slot") == 0, near[0]).otherwise(near[1])).withColumn("theirs", F.when(F.col("slot") == 0, near[1]).otherwise(near[0]))


_PAIRS = f"""SELECT *, CASE WHEN far > 60 OR mine > 40 OR (k % 2 > 0 AND mine > 2.0::DOUBLE * theirs) THEN NULL ELSE far + 0.8::DOUBLE * gap + 0.6::DOUBLE * mine END AS cost FROM (
  SELECT t.match_id, t.k, t.slot, d.det_id, sqrt(pow(tx - d.cx, 2) + pow(ty - d.cy, 2)) AS far, sqrt(0.4::DOUBLE * pow(tl - d.l, 2) + pow(ta - d.a, 2) + pow(tb - d.b, 2)) AS gap,
    CASE WHEN t.slot = 0 THEN {_nearsql(_A, p='d.')} ELSE {_nearsql(_B, p='d.')} END AS mine, CASE WHEN t.slot = 0 THEN {_nearsql(_B, p='d.')} ELSE {_nearsql(_A, p='d.')} END AS theirs
  FROM (SELECT match_id, k, slot, lag(cx) OVER w AS tx, lag(cy) OVER w AS ty, lag(l) OVER w AS tl, lag(a) OVER w AS ta, lag(b) OVER w AS tb FROM dt WINDOW w AS (PARTITION BY match_id, slot ORDER BY k)) t JOIN dt d ON d.match_id = t.match_id AND d.k = t.k WHERE tx IS NOT NULL)"""


@query("association_cost", chain(f"SELECT match_id, k, slot, det_id, {s6('cost')} FROM pr", "t", dt=_DET, pr=_PAIRS))
def q_cost(spark, d):
    return identity.association_cost(_pairs(spark, d)).select("match_id", "k", "slot", "det_id", *r6("cost"))


@query("assign", chain(
    "SELECT match_id, k, unnest(p).slot AS slot, unnest(p).det AS det_id FROM (SELECT match_id, k, arg_min(p, (-n, total, p)) AS p FROM (SELECT a.match_id, a.k, 2 AS n, a.cost + b.cost AS total, [{'slot': 0, 'det': a.det_id}, {'slot': 1, 'det': b.det_id}] AS p FROM pr a JOIN pr b ON a.match_id = b.match_id AND a.k = b.k AND a.slot = 0 AND b.slot = 1 AND a.det_id <> b.det_id WHERE a.cost IS NOT NULL AND b.cost IS NOT NULL UNION ALL SELECT match_id, k, 1, cost, [{'slot': CAST(slot AS INT), 'det': det_id}] FROM pr WHERE cost IS NOT NULL) GROUP BY 1, 2)",
    "t", dt=_DET, pr=_PAIRS))
def q_assign(spark, d):
    return identity.assign(identity.association_cost(_pairs(spark, d)), ("match_id", "k"))


@query("seed", chain(f"SELECT match_id, s, arg_min(f, (total, f, g)) AS first, arg_min(g, (total, f, g)) AS second FROM (SELECT a.match_id, a.s, a.det_id AS f, b.det_id AS g, a.n0 + b.n1 AS total FROM nr a JOIN nr b ON a.match_id = b.match_id AND a.s = b.s AND a.det_id <> b.det_id WHERE a.n0 <= 28 AND a.n1 - a.n0 >= 6 AND b.n1 <= 28 AND b.n0 - b.n1 >= 6) GROUP BY 1, 2", "t", dt=_DET, nr=f"SELECT match_id, k // 5 AS s, det_id, {_nearsql(_A)} AS n0, {_nearsql(_B)} AS n1 FROM dt"))
def q_seed(spark, d):
    df = _detections(spark, d).withColumn("s", F.expr("k div 5"))
    return identity.seed(df.withColumn("near_0", _near(df, _A)).withColumn("near_1", _near(df, _B)), ("match_id", "s"))


_SLOTS = "SELECT match_id, k, slot, cx, cy, CASE WHEN det_id % 3 = 0 THEN 'predicted' WHEN det_id % 7 = 0 THEN 'split' ELSE 'measured' END AS source FROM dt"


def _slots(spark, d):
    i = F.col("det_id")
    return _detections(spark, d).withColumn("source", F.when(i % 3 == 0, "predicted").when(i % 7 == 0, "split").otherwise("measured"))


@query("separate", chain("SELECT match_id, k, cx0 IS NOT NULL AND NOT (coalesce(near, false) AND coalesce(s0 = 'predicted', false)) AS kept0, cx1 IS NOT NULL AND NOT (coalesce(near, false) AND coalesce(s1 = 'predicted', false)) AS kept1 FROM (SELECT *, sqrt(pow(cx0 - cx1, 2) + pow(cy0 - cy1, 2)) <= 80 AS near FROM (SELECT match_id, k, max(cx) FILTER (slot = 0) AS cx0, max(cy) FILTER (slot = 0) AS cy0, max(source) FILTER (slot = 0) AS s0, max(cx) FILTER (slot = 1) AS cx1, max(cy) FILTER (slot = 1) AS cy1, max(source) FILTER (slot = 1) AS s1 FROM sl GROUP BY 1, 2))", "t", dt=_DET, sl=_SLOTS))
def q_separate(spark, d):
    seat = [F.max(F.when(F.col("slot") == n, F.col(c))).alias(f"{c}{n}") for n in (0, 1) for c in ("cx", "cy", "source")]
    return identity.separate(_slots(spark, d).groupBy("match_id", "k").agg(*seat), 80.0).select("match_id", "k", "kept0", "kept1")


@query("track_summary", chain("SELECT match_id, count(*) AS frames, count(*) FILTER (n = 2) AS both, count(*) FILTER (n = 1) AS one, count(*) FILTER (n = 0) AS none, CAST(sum(o) AS BIGINT) AS observed, CAST(sum(s) AS BIGINT) AS split, CAST(sum(p) AS BIGINT) AS coasted FROM (SELECT match_id, k, count(source) AS n, count(*) FILTER (source <> 'predicted') AS o, count(*) FILTER (source = 'split') AS s, count(*) FILTER (source = 'predicted') AS p FROM sl GROUP BY 1, 2) GROUP BY 1", "t", dt=_DET, sl=_SLOTS))
def q_track_summary(spark, d):
    return identity.track_summary(_slots(spark, d))


@query("loitering", chain(f"SELECT match_id, slot, ms, coalesce(n >= 10 AND lo <= ms - 2400 AND sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) < 25 AND m > 28, false) AS loiters FROM (SELECT match_id, slot, ms, count(*) OVER w AS n, min(ms) OVER w AS lo, max(cx) OVER w AS x1, min(cx) OVER w AS x0, max(cy) OVER w AS y1, min(cy) OVER w AS y0, avg(anchor) OVER w AS m FROM (SELECT match_id, slot, CAST(round(time_s * 1000) AS BIGINT) AS ms, cx, cy, {_nearsql(_A)} AS anchor FROM dt) WINDOW w AS (PARTITION BY match_id, slot ORDER BY ms RANGE BETWEEN 2999 PRECEDING AND CURRENT ROW))", "t", dt=_DET))
def q_loiter(spark, d):
    df = _detections(spark, d)
    rows = df.withColumn("ms", F.round(F.col("time_s") * 1000).cast("bigint")).withColumn("anchor", _near(df, _A))
    return identity.loitering(rows, ("match_id", "slot")).select("match_id", "slot", "ms", "loiters")


_ORD = f"SELECT match_id, slot, k, row_number() OVER (PARTITION BY match_id, slot ORDER BY k) AS n, cx, {_nearsql(_B)} - {_nearsql(_A)} AS lean FROM dt"


@query("identity_evidence", chain("SELECT match_id, slot, k, round(e, 6) AS evidence, n FROM ev", "t", recursive=True, dt=_DET, od=_ORD, ev="SELECT match_id, slot, k, n, lean AS e FROM od WHERE n = 1 UNION ALL SELECT o.match_id, o.slot, o.k, o.n, 0.88::DOUBLE * v.e + (1 - 0.88::DOUBLE) * o.lean FROM ev v JOIN od o ON o.match_id = v.match_id AND o.slot = v.slot AND o.n = v.n + 1"))
def q_evidence(spark, d):
    df = _detections(spark, d)
    rows = df.withColumn("lean", _near(df, _B) - _near(df, _A))
    return identity.evidence(rows, ("match_id", "slot")).select("match_id", "slot", "k", *r6("evidence"), "n")


_KAL = """SELECT match_id, slot, k, n, cx AS x, 0.0::DOUBLE AS v, 16.0::DOUBLE AS a, 0.0::DOUBLE AS b, 100.0::DOUBLE AS c FROM od WHERE n = 1 UNION ALL
  SELECT match_id, slot, k, n, px + pa / (pa + 16) * (z - px), v + pb / (pa + 16) * (z - px), pa - pa / (pa + 16) * pa, pb - pa / (pa + 16) * pb, pc - pb / (pa + 16) * pb FROM (SELECT o.match_id, o.slot, o.k, o.n, o.cx AS z, s.x + s.v AS px, s.v, s.a + 2 * s.b + s.c + 25 / 4.0::DOUBLE AS pa, s.b + s.c + 25 / 2.0::DOUBLE AS pb, s.c + 25 AS pc FROM kf s JOIN od o ON o.match_id = s.match_id AND o.slot = s.slot AND o.n = s.n + 1)"""


@query("kalman", chain("SELECT match_id, slot, k, round(x, 6) AS at, round(v, 6) AS speed, round(a, 6) AS variance FROM kf", "t", recursive=True, dt=_DET, od=_ORD, kf=_KAL))
def q_kalman(spark, d):
    return identity.kalman(_detections(spark, d), ("match_id", "slot")).select("match_id", "slot", "k", *r6("at", "speed", "variance"))


_MID = "SELECT match_id, slot, CAST(trunc(median(l)) AS INT) AS ml, CAST(trunc(median(a)) AS INT) AS ma, CAST(trunc(median(b)) AS INT) AS mb FROM dt GROUP BY 1, 2"


@query("roster", chain("SELECT s.match_id, s.slot, any_value(ml) AS l, any_value(ma) AS a, any_value(mb) AS b, round(median(sqrt(pow(s.l - ml, 2) + pow(s.a - ma, 2) + pow(s.b - mb, 2))), 6) AS spread FROM dt s JOIN m ON m.match_id = s.match_id AND m.slot = s.slot GROUP BY 1, 2", "t", dt=_DET, m=_MID))
def q_roster(spark, d):
    return identity.roster(_detections(spark, d)).select("match_id", "slot", "l", "a", "b", *r6("spread"))


@query("pick", chain("SELECT match_id, s, arg_min(det_id, (far, det_id)) AS det_id FROM (SELECT match_id, k // 5 AS s, det_id, CASE WHEN 128 BETWEEN cx - 10 AND cx + 10 AND 200 BETWEEN cy - h / 2.0::DOUBLE AND cy + h / 2.0::DOUBLE THEN 0 ELSE sqrt(pow(128 - cx, 2) + pow(200 - cy, 2)) END AS far FROM dt) WHERE far <= 40 GROUP BY 1, 2", "t", dt=_DET))
def q_pick(spark, d):
    blobs = _detections(spark, d).select("match_id", F.expr("k div 5").alias("s"), "det_id", (F.col("cx") - 10).alias("x"), (F.col("cy") - F.col("h") / 2.0).alias("y"), F.lit(20.0).alias("w"), F.col("h").cast("double").alias("h"), "cx", "cy")
    clicks = blobs.select("match_id", "s").distinct().withColumn("px", F.lit(128.0)).withColumn("py", F.lit(200.0))
    return identity.pick(clicks, blobs, ("match_id", "s"))


_TRAIL = "SELECT *, row_number() OVER w AS n, k - lag(k) OVER w AS gap FROM t WHERE x IS NOT NULL WINDOW w AS (PARTITION BY match_id, slot ORDER BY k)"


@query("trail_segments", chain("SELECT match_id, slot, k, round(0.35::DOUBLE + 0.65::DOUBLE * (k + 1) / (SELECT max(k) + 1 FROM t u WHERE u.match_id = tr.match_id), 6) AS weight FROM tr WHERE gap <= 3", "t", tr=_TRAIL))
def q_trail(spark, d):
    return tracks.trail(_track(spark, d)).select("match_id", "slot", "k", *r6("weight"))


@query("positions_wide", chain("SELECT match_id, k, max(printf('%.4f', x)) FILTER (slot = 0) AS p0_x, max(printf('%.4f', y)) FILTER (slot = 0) AS p0_y, max(printf('%.4f', x)) FILTER (slot = 1) AS p1_x, max(printf('%.4f', y)) FILTER (slot = 1) AS p1_y FROM t GROUP BY 1, 2", "t"))
def q_wide(spark, d):
    return tracks.wide(_track(spark, d))
