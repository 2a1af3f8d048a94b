"""Queries of frame places, notations and spans, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import analysis, geometry, identity, scoreboard
from ..sources import files
from . import bridge
from .more import _DET, _MID, _detections
from .oracles import chain
from .queries import _I, _apply, query, r6

#: Fixed values for 1280 x 720: looked at as 480 x 270, from (64, 37) to (453, 268).
_SIZE = (1280, 720)


@query("foot_fraction", chain("SELECT match_id, slot, k, round((cx + 64) / 480.0::DOUBLE, 6) AS fx, round((cy + h / 2.0::DOUBLE + 37) / 270.0::DOUBLE, 6) AS fy FROM dt", "t", dt=_DET))
def q_foot(spark, d):
    fx, fy = geometry.foot_fraction(F.col("cx"), F.col("cy") + F.col("h") / 2.0, *_SIZE)
    return _detections(spark, d).select("match_id", "slot", "k", fx.alias("fx"), fy.alias("fy")).select("match_id", "slot", "k", *r6("fx", "fy"))


@query("roi_boxes", chain("""SELECT match_id, slot, k, round(greatest(0.0::DOUBLE, ((x / 10 - 0.2::DOUBLE) * 480 - 64) / 389.0::DOUBLE), 6) AS x0, round(greatest(0.0::DOUBLE, ((y / 10 - 0.2::DOUBLE) * 270 - 37) / 231.0::DOUBLE), 6) AS y0,
  round(least(1.0::DOUBLE, ((x / 10 + 0.4::DOUBLE) * 480 - 64) / 389.0::DOUBLE), 6) AS x1, round(least(1.0::DOUBLE, ((y / 10 + 0.4::DOUBLE) * 270 - 37) / 231.0::DOUBLE), 6) AS y1 FROM t WHERE x IS NOT NULL""", "t"))
def q_boxes(spark, d):
    x, y = F.col("x") / 10, F.col("y") / 10
    out = geometry.box_in_roi(x - 0.2, y - 0.2, x + 0.4, y + 0.4, *_SIZE)
    rows = bridge.track(spark, d).filter("x is not null")
    return rows.select("match_id", "slot", "k", *[c.alias(n) for c, n in zip(out, ("x0", "y0", "x1", "y1"))]).select("match_id", "slot", "k", *r6("x0", "y0", "x1", "y1"))


@query("spread_windows", chain("SELECT match_id, CAST(nr AS INT) AS nr, first, least(frames, first + 360) AS \"end\" FROM (SELECT match_id, frames, nr, CAST(trunc(frames * (0.1::DOUBLE + 0.8::DOUBLE * (nr + 0.5::DOUBLE) / 5)) AS BIGINT) AS first FROM (SELECT match_id, count(DISTINCT k) AS frames FROM t GROUP BY 1), (SELECT unnest([0, 1, 2, 3, 4]) AS nr)) WHERE least(frames, first + 360) - first > 5", "t"))
def q_windows(spark, d):
    videos = bridge.track(spark, d).groupBy("match_id").agg(F.countDistinct("k").alias("frames")).withColumn("fps", F.lit(0.0))
    return analysis.windows(videos)


_NOTES = "SELECT match_id, slot, k, CASE k % 4 WHEN 0 THEN (slot + 1) || '=0.' || k || ',0.5@' || (k // 10) || '.5' WHEN 1 THEN ' tee =0.' || k || ', 0.25' WHEN 2 THEN '0.1,0.2,0.3,0.' || k ELSE '1,x@' || k END AS note FROM t"


@query("notations", chain("""SELECT match_id, slot, k, CASE WHEN p THEN CAST(regexp_extract(note, '^([0-9]+)=', 1) AS INT) - 1 END AS player, CASE WHEN p THEN CAST(regexp_extract(note, '@(.*)$', 1) AS DOUBLE) END AS time_s,
  CASE WHEN m THEN trim(regexp_extract(note, '^([^=]*)=', 1)) END AS landmark, CASE WHEN b THEN CAST(regexp_extract(note, '([^,]*)$', 1) AS DOUBLE) END AS y1
  FROM (SELECT *, k % 4 = 0 AS p, k % 4 = 1 AS m, k % 4 = 2 AS b FROM nt)""", "t", nt=_NOTES))
def q_notations(spark, d):
    k = F.col("k").cast("string")
    note = F.when(F.col("k") % 4 == 0, F.concat((F.col("slot") + 1).cast("string"), F.lit("=0."), k, F.lit(",0.5@"), F.expr("cast(k div 10 as string)"), F.lit(".5")))
    note = note.when(F.col("k") % 4 == 1, F.concat(F.lit(" tee =0."), k, F.lit(", 0.25"))).when(F.col("k") % 4 == 2, F.concat(F.lit("0.1,0.2,0.3,0."), k)).otherwise(F.concat(F.lit("1,x@"), k))
    rows = bridge.track(spark, d).withColumn("note", note)
    return rows.select("match_id", "slot", "k", text.player(F.col("note"))["slot"].alias("player"), text.player(F.col("note"))["time_s"].alias("time_s"), text.landmark(F.col("note"))["name"].alias("landmark"), text.box(F.col("note"))["y1"].alias("y1"))


@query("roster_separation", chain("SELECT p.match_id, round(sqrt(pow(p.ml - q.ml, 2) + pow(p.ma - q.ma, 2) + pow(p.mb - q.mb, 2)), 6) AS separation FROM m p JOIN m q ON p.match_id = q.match_id AND p.slot = 0 AND q.slot = 1", "t", dt=_DET, m=_MID))
def q_separation(spark, d):
    return identity.separation(identity.roster(_detections(spark, d), keys=("match_id", "slot"))).select("match_id", *r6("separation"))


@query("sampled_frames", chain("SELECT DISTINCT match_id, k AS frame_index, k // 5 AS i FROM t WHERE k % 5 = 0", "t"))
def q_sampled(spark, d):
    frames = bridge.track(spark, d).select("match_id", F.col("k").alias("frame_index")).distinct()
    return scoreboard.sampled(frames, 10.0)


# A log of edits for each fifty samples of a match.
_EDITS = "SELECT match_id, k // 50 AS clip, (k % 50) * 2 + slot AS nr, CASE WHEN event_type = 'error' OR event_id % 4 = 0 THEN 'undo' WHEN event_id % 3 = 0 THEN 'ignore' ELSE 'sample' END AS action, (event_id * 37) % 100 * 0.13::DOUBLE AS time_s, event_type AS kind FROM t"


def _edits(spark, d):
    e = F.col("event_id")
    action = F.when((F.col("event_type") == "error") | (e % 4 == 0), "undo").when(e % 3 == 0, "ignore").otherwise("sample")
    t = bridge.track(spark, d)
    return t.select("match_id", F.expr("k div 50").alias("clip"), (F.col("k") % 50 * 2 + F.col("slot")).alias("nr"), action.alias("action"), ((e * 37) % 100 * F.lit(0.13)).alias("time_s"), F.col("event_type").alias("kind"))


_NUMBERED = "SELECT *, row_number() OVER (PARTITION BY match_id, clip ORDER BY nr) AS n FROM ed"
_STACK = """SELECT match_id, clip, 0 AS n, CAST([] AS {kind}[]) AS held FROM eo WHERE n = 1 UNION ALL
  SELECT s.match_id, s.clip, e.n, CASE WHEN action = 'undo' THEN list_slice(held, 1, len(held) - 1) ELSE list_append({left}, {item}) END FROM {name} s JOIN eo e ON e.match_id = s.match_id AND e.clip = s.clip AND e.n = s.n + 1"""
_TOP = "SELECT match_id, clip, unnest(held) AS h FROM (SELECT match_id, clip, arg_max(held, n) AS held FROM {name} GROUP BY 1, 2)"


@query("roster_edits", chain("SELECT match_id, clip, h.nr AS nr, h.action AS action FROM tp", "t", recursive=True, ed=_EDITS, eo=_NUMBERED, es=_STACK.format(kind="STRUCT(nr BIGINT, action VARCHAR)", left="held", item="{'nr': e.nr, 'action': action}", name="es"), tp=_TOP.format(name="es")))
def q_roster_edits(spark, d):
    return identity.standing(_edits(spark, d), ("match_id", "clip")).select("match_id", "clip", "nr", "action")


@query("label_edits", chain("SELECT match_id, clip, h.time_s AS time_s, h.kind AS kind FROM tp", "t", recursive=True, ed=_EDITS, eo=_NUMBERED, es=_STACK.format(kind="STRUCT(time_s DOUBLE, kind VARCHAR)", left="list_filter(held, lambda m: abs(m.time_s - e.time_s) > 0.4::DOUBLE)", item="{'time_s': round(e.time_s, 2), 'kind': e.kind}", name="es"), tp=_TOP.format(name="es")))
def q_label_edits(spark, d):
    return files.marked(_edits(spark, d), ("match_id", "clip")).select("match_id", "clip", "time_s", "kind")


@query("roster_state", chain("SELECT match_id, round(median(h / 231.0::DOUBLE) FILTER (det_id % 5 <> 0), 6) AS player_height, count(DISTINCT slot) = 2 AS complete FROM dt GROUP BY 1", "t", dt=_DET))
def q_state(spark, d):
    rows = _detections(spark, d).withColumn("height", F.when(F.col("det_id") % 5 != 0, F.col("h") / 231.0))
    return identity.roster_state(rows).select("match_id", *r6("player_height"), "complete")


@query("fence_boxes", chain("SELECT det_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (cx - 10 - 8) / 389)), 6) AS x0, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (cy - 8) / 231)), 6) AS y0, round(least(1.0::DOUBLE, (cx + 10 + 8) / 389), 6) AS x1, round(least(1.0::DOUBLE, (cy + h + 8) / 231), 6) AS y1, det_id % 3 > 0 AND round_even(h / 80.0::DOUBLE, 3) >= 0.75::DOUBLE AS risky FROM dt", "t", dt=_DET))
def q_fence_boxes(spark, d):
    tallest = F.when(F.col("det_id") % 3 > 0, 80.0)
    rows = _detections(spark, d).withColumn("f", identity.fence(F.col("cx") - 10, F.col("cy"), F.lit(20.0), F.col("h"), F.lit(389.0), F.lit(231.0), tallest))
    return rows.select("det_id", "f.*").select("det_id", *r6("x0", "y0", "x1", "y1"), identity.risky(F.col("relative")).alias("risky"))


# The floor's lines in metres.
_LINES = """('wall', 0.0::DOUBLE, 0.0::DOUBLE, 6.4::DOUBLE, 0.0::DOUBLE), ('wall', 0.0, 0.0, 0.0, 9.75), ('wall', 6.4, 0.0, 6.4, 9.75), ('wall', 0.0, 9.75, 6.4, 9.75), ('line', 0.0, 4.26, 6.4, 4.26), ('line', 3.2, 4.26, 3.2, 9.75),
  ('box', 0.0, 4.26, 1.6, 4.26), ('box', 0.0, 5.86, 1.6, 5.86), ('box', 0.0, 4.26, 0.0, 5.86), ('box', 1.6, 4.26, 1.6, 5.86), ('box', 4.8, 4.26, 6.4, 4.26), ('box', 4.8, 5.86, 6.4, 5.86), ('box', 4.8, 4.26, 4.8, 5.86), ('box', 6.4, 4.26, 6.4, 5.86)"""


@query("court_lines", "SELECT part, " + ", ".join(f"CAST(round_even({_apply(_I, f'x{e}', f'y{e}', i)} * {size}, 0) AS INT) AS {n}{e}" for e in (0, 1) for i, (n, size) in enumerate((("x", 1280), ("y", 720)))) + f" FROM (VALUES {_LINES}) AS v(part, x0, y0, x1, y1)")
def q_lines(spark, d):
    return geometry.drawn_lines(spark, _I, *_SIZE)
