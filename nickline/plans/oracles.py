"""The core queries in DuckDB's SQL, as chains of named steps over the bridge."""

from __future__ import annotations

from . import bridge

DIST = "sqrt(pow(x - lag(x) OVER pl, 2) + pow(y - lag(y) OVER pl, 2))"
_BOX = "CASE WHEN {y} BETWEEN 3.81::DOUBLE AND 6.31::DOUBLE AND {x} <= 2.05::DOUBLE THEN 'L' WHEN {y} BETWEEN 3.81::DOUBLE AND 6.31::DOUBLE AND {x} >= 4.35::DOUBLE THEN 'R' END"


def box(x: str, y: str) -> str:
    return _BOX.format(x=x, y=y)


STEPS = {
    "t": bridge.sql(),
    "td": bridge.sql(bridge.BY_DAY),
    "s": "SELECT match_id, k, time_s, min(blobs) AS blobs, max(x) FILTER (slot = 0) AS x0, max(y) FILTER (slot = 0) AS y0, max(x) FILTER (slot = 1) AS x1, max(y) FILTER (slot = 1) AS y1 FROM t GROUP BY ALL",
    "sp": f"SELECT *, {DIST} / 0.1::DOUBLE AS speed FROM t WINDOW pl AS (PARTITION BY match_id, slot ORDER BY k)",
    "act": "SELECT match_id, k, time_s, sum(s) OVER w / nullif(sum(n) OVER w, 0) AS activity FROM (SELECT match_id, k, time_s, sum(speed) AS s, count(speed) AS n FROM sp GROUP BY ALL) WINDOW w AS (PARTITION BY match_id ORDER BY k ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)",
    "occ": "SELECT match_id, k, time_s, avg(CASE WHEN blobs >= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY match_id ORDER BY k ROWS BETWEEN 75 PRECEDING AND 75 FOLLOWING) AS occupancy FROM s",
    "seg": "SELECT match_id, min(time_s) AS start_s, max(time_s) AS end_s, playing FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY k) - row_number() OVER (PARTITION BY match_id, playing ORDER BY k) AS g FROM (SELECT *, occupancy >= 0.35::DOUBLE AS playing FROM occ)) GROUP BY match_id, playing, g",
    "rest": "SELECT match_id, k, time_s, activity IS NULL OR activity < 0.7::DOUBLE AS resting FROM act",
    "restp": "SELECT a.match_id, a.k, a.time_s, NOT coalesce(g.playing, false) OR activity IS NULL OR activity < 0.7::DOUBLE AS resting FROM act a LEFT JOIN seg g ON a.match_id = g.match_id AND a.time_s BETWEEN g.start_s AND g.end_s",
}


def _breaks(rest: str) -> str:
    return f"SELECT match_id, min(time_s) AS start_s, max(time_s) AS end_s FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY k) - row_number() OVER (PARTITION BY match_id, resting ORDER BY k) AS g FROM {rest}) WHERE resting GROUP BY match_id, g HAVING max(time_s) - min(time_s) >= 2.5::DOUBLE"


def _rallies(br: str, rest: str) -> str:
    return f"""SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY start_s) - 1 AS rally_index, start_s, end_s FROM (
      SELECT match_id, coalesce(lag(b1) OVER (PARTITION BY match_id ORDER BY b0, b1 NULLS LAST), lo) AS start_s, b0 AS end_s FROM (
        SELECT match_id, start_s AS b0, end_s AS b1 FROM {br} UNION ALL SELECT match_id, max(time_s), NULL FROM {rest} GROUP BY match_id)
      JOIN (SELECT match_id, min(time_s) AS lo FROM {rest} GROUP BY match_id) USING (match_id)) WHERE end_s - start_s >= 2.5::DOUBLE"""


STEPS |= {
    "br": _breaks("rest"), "brp": _breaks("restp"), "ra": _rallies("br", "rest"), "rap": _rallies("brp", "restp"),
    "rw": "SELECT t.*, r.rally_index, r.start_s, r.end_s, sqrt(pow(x - 3.2::DOUBLE, 2) + pow(y - 4.26::DOUBLE, 2)) AS radial, CAST(round(time_s * 1000) AS BIGINT) AS ms FROM t JOIN ra r ON t.match_id = r.match_id AND t.time_s >= r.start_s AND t.time_s < r.end_s",
    "sm": "SELECT *, CASE WHEN radial IS NOT NULL THEN avg(radial) OVER (PARTITION BY match_id, rally_index, slot ORDER BY ms RANGE BETWEEN 150 PRECEDING AND 150 FOLLOWING) END AS smooth FROM rw",
    "sv": "SELECT *, row_number() OVER w AS pos, lag(smooth) OVER w AS before, lead(smooth) OVER w AS after FROM sm WHERE smooth IS NOT NULL WINDOW w AS (PARTITION BY match_id, rally_index, slot ORDER BY k)",
    "pk": "SELECT * FROM sv WHERE smooth >= before AND smooth >= after",
    "pb": """SELECT p.match_id, p.rally_index, p.slot, p.pos, p.k, p.time_s, p.smooth, coalesce((SELECT max(q.pos) FROM sv q WHERE q.match_id = p.match_id AND q.rally_index = p.rally_index AND q.slot = p.slot AND q.pos < p.pos AND q.smooth > p.smooth), 0) AS lo,
             coalesce((SELECT min(q.pos) FROM sv q WHERE q.match_id = p.match_id AND q.rally_index = p.rally_index AND q.slot = p.slot AND q.pos > p.pos AND q.smooth > p.smooth), 1000000000) AS hi FROM pk p""",
    "pm": """SELECT match_id, rally_index, slot, time_s, smooth - greatest(l, r) AS prominence FROM (SELECT p.*, (SELECT min(q.smooth) FROM sv q WHERE q.match_id = p.match_id AND q.rally_index = p.rally_index AND q.slot = p.slot AND q.pos BETWEEN p.lo AND p.pos) AS l,
             (SELECT min(q.smooth) FROM sv q WHERE q.match_id = p.match_id AND q.rally_index = p.rally_index AND q.slot = p.slot AND q.pos BETWEEN p.pos AND p.hi) AS r FROM pb p) WHERE smooth - greatest(l, r) >= 0.4::DOUBLE""",
    "rk": "SELECT *, row_number() OVER (PARTITION BY match_id, rally_index, slot ORDER BY prominence DESC, time_s) AS i FROM pm",
    "nm": """SELECT match_id, rally_index, slot, i, [time_s] AS kept, true AS ok, time_s, prominence FROM rk WHERE i = 1 UNION ALL
             SELECT r.match_id, r.rally_index, r.slot, r.i, CASE WHEN len(list_filter(n.kept, lambda q: abs(q - r.time_s) < 0.4::DOUBLE)) = 0 THEN list_append(n.kept, r.time_s) ELSE n.kept END, len(list_filter(n.kept, lambda q: abs(q - r.time_s) < 0.4::DOUBLE)) = 0, r.time_s, r.prominence
             FROM nm n JOIN rk r ON r.match_id = n.match_id AND r.rally_index = n.rally_index AND r.slot = n.slot AND r.i = n.i + 1""",
    "ca": "SELECT match_id, rally_index, slot, time_s, prominence FROM nm WHERE ok",
    "sb": f"SELECT *, {box('x0', 'y0')} AS b0, {box('x1', 'y1')} AS b1 FROM s",
    "sr": """SELECT *, CASE WHEN x0 IS NULL OR x1 IS NULL THEN NULL WHEN b0 IS NOT NULL AND y1 >= 4.26::DOUBLE AND (b0 = 'L') <> (x1 < 3.2::DOUBLE) THEN 0 WHEN b1 IS NOT NULL AND y0 >= 4.26::DOUBLE AND (b1 = 'L') <> (x0 < 3.2::DOUBLE) THEN 1 END AS server FROM sb""",
    "se": """SELECT match_id, rally_index, arg_min(server, k) AS server FROM (SELECT sr.*, r.rally_index, min(time_s) OVER (PARTITION BY sr.match_id, r.rally_index) AS t0 FROM sr JOIN ra r ON sr.match_id = r.match_id AND time_s >= start_s AND time_s < end_s)
             WHERE server IS NOT NULL AND time_s <= t0 + 2.0::DOUBLE GROUP BY ALL""",
    "al": """SELECT *, begun = 1 AND NOT coalesce(pslot = slot AND pbegun = 1, false) AS taken FROM (SELECT *, lag(slot) OVER w AS pslot, lag(begun) OVER w AS pbegun FROM (
             SELECT *, max(CASE WHEN slot = starts THEN 1 ELSE 0 END) OVER w AS begun FROM (SELECT ca.*, server, coalesce(server, first_value(slot) OVER w) AS starts FROM ca LEFT JOIN se USING (match_id, rally_index) WINDOW w AS (PARTITION BY match_id, rally_index ORDER BY time_s, slot)) WINDOW w AS (PARTITION BY match_id, rally_index ORDER BY time_s, slot)) WINDOW w AS (PARTITION BY match_id, rally_index ORDER BY time_s, slot))""",
    "sh": "SELECT al.match_id, al.rally_index, round_even(al.time_s, 2) AS time_s, al.slot AS player, x AS position_x_m, y AS position_y_m FROM al JOIN t ON al.match_id = t.match_id AND al.slot = t.slot AND al.time_s = t.time_s WHERE taken AND x IS NOT NULL",
    "po": "SELECT match_id, CAST(event_id % 2 AS INT) AS row, CAST(least(k // 400, 4) AS INT) AS game, time_s FROM t WHERE event_type = 'purchase' AND event_id % 40 = 0",
    "rp": "SELECT * FROM (SELECT r.*, p.time_s AS point_s, p.row, p.game, row_number() OVER (PARTITION BY r.match_id, r.rally_index ORDER BY abs(p.time_s - r.end_s), p.time_s, p.row) AS n FROM ra r LEFT JOIN po p ON p.match_id = r.match_id AND abs(p.time_s - r.end_s) <= 3.0::DOUBLE) WHERE n = 1",
    "hi": "SELECT match_id, rally_index, arg_min(player, time_s) AS server, arg_max(player, time_s) AS last_hitter FROM sh GROUP BY ALL",
    "vo": """SELECT match_id, straight < cross_ AS crossed, CASE WHEN straight + cross_ > 0 THEN CAST(greatest(straight, cross_) AS DOUBLE) / (straight + cross_) ELSE 0.0::DOUBLE END AS agreement, straight + cross_ AS votes FROM (
             SELECT rp.match_id, CAST(count(*) FILTER (rp.row = h.server) AS BIGINT) AS straight, CAST(count(*) FILTER (rp.row <> h.server) AS BIGINT) AS cross_ FROM rp LEFT JOIN hi h ON h.match_id = rp.match_id AND h.rally_index = rp.rally_index + 1 GROUP BY 1)""",
    "ou": """SELECT match_id, rally_index, end_s, CASE WHEN row IS NULL OR last_hitter IS NULL THEN 'let' WHEN last_hitter = scorer THEN 'winner' ELSE 'error' END AS kind, CAST(scorer AS INT) AS scorer,
             CAST(CASE WHEN row IS NULL THEN coalesce(max(game) OVER (PARTITION BY match_id ORDER BY rally_index), 0) ELSE game END AS INT) AS game FROM (
             SELECT rp.*, h.last_hitter, CASE WHEN v.crossed THEN 1 - rp.row ELSE rp.row END AS scorer FROM rp LEFT JOIN hi h ON h.match_id = rp.match_id AND h.rally_index = rp.rally_index LEFT JOIN vo v ON v.match_id = rp.match_id)""",
    "md": "SELECT match_id, slot, k, time_s, CASE WHEN x IS NOT NULL THEN median(x) OVER w END AS x, CASE WHEN x IS NOT NULL THEN median(y) OVER w END AS y FROM t WINDOW w AS (PARTITION BY match_id, slot ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
}

_NEEDS = {
    "s": ["t"], "sp": ["t"], "act": ["sp"], "occ": ["s"], "seg": ["occ"], "rest": ["act"], "restp": ["act", "seg"], "br": ["rest"], "brp": ["restp"], "ra": ["br", "rest"], "rap": ["brp", "restp"], "rw": ["t", "ra"], "sm": ["rw"], "sv": ["sm"], "pk": ["sv"], "pb": ["pk", "sv"],
    "pm": ["pb", "sv"], "rk": ["pm"], "nm": ["rk"], "ca": ["nm"], "sb": ["s"], "sr": ["sb"], "se": ["sr", "ra"], "al": ["ca", "se"], "sh": ["al", "t"], "po": ["t"], "rp": ["ra", "po"], "hi": ["sh"], "vo": ["rp", "hi"], "ou": ["rp", "hi", "vo"], "md": ["t"],
}


def chain(select: str, *names: str, recursive: bool = False, **own: str) -> str:
    """WITH the named steps and all they need, then own steps, then select."""
    order: list[str] = []

    def need(n: str) -> None:
        if n not in order:
            for m in _NEEDS.get(n, []):
                need(m)
            order.append(n)

    for n in names:
        need(n)
    steps = [f"{n} AS {'MATERIALIZED ' if n in ('sv', 'sm', 'ra', 'sh', 't') else ''}({STEPS[n]})" for n in order] + [f"{n} AS ({q})" for n, q in own.items()]
    return f"WITH {'RECURSIVE ' if recursive or 'nm' in order else ''}" + ",\n".join(steps) + "\n" + select


_GAP = "sqrt(pow(t.x - s.sx, 2) + pow(t.y - s.sy, 2)) > 7.0::DOUBLE * 0.1::DOUBLE"
_AX, _AY = "(s.px + s.vx * 0.1::DOUBLE)", "(s.py + s.vy * 0.1::DOUBLE)"
_VX, _VY = f"(s.vx + b * (t.x - {_AX}) / 0.1::DOUBLE)", f"(s.vy + b * (t.y - {_AY}) / 0.1::DOUBLE)"


def alpha_beta(source: str, alpha: float = 0.32) -> str:
    """The filter's state machine as a recursive step over samples; mode: 0 gap coasted, 1 gap broken, 2 seeded, 3 outlier coasted, 4 re-seeded, 5 accepted."""
    case = lambda *values: "CASE mode " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"
    limit = lambda v: f"CASE WHEN sqrt(pow(nvx, 2) + pow(nvy, 2)) > 7.0::DOUBLE THEN {v} * 7.0::DOUBLE / sqrt(pow(nvx, 2) + pow(nvy, 2)) ELSE {v} END"
    return f"""SELECT match_id, slot, CAST(-1 AS BIGINT) AS k, NULL::DOUBLE AS time_s, NULL::DOUBLE AS px, NULL::DOUBLE AS py, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy, NULL::DOUBLE AS sx, NULL::DOUBLE AS sy, 0 AS rejected, 0 AS coasted, NULL::DOUBLE AS x, NULL::DOUBLE AS y, false AS solid
      FROM (SELECT DISTINCT match_id, slot FROM {source}) UNION ALL
      SELECT match_id, slot, k, time_s, {case('ax', 'NULL', 'zx', 'ax', 'zx', 'ax + a * (zx - ax)')}, {case('ay', 'NULL', 'zy', 'ay', 'zy', 'ay + a * (zy - ay)')},
        {case('vx', '0.0', '0.0', 'vx', '0.0', limit('nvx'))}, {case('vy', '0.0', '0.0', 'vy', '0.0', limit('nvy'))}, {case('sx', 'NULL', 'zx', 'sx', 'zx', 'zx')}, {case('sy', 'NULL', 'zy', 'sy', 'zy', 'zy')},
        {case('rejected', '0', '0', 'rejected + 1', '0', '0')}, {case('coasted + 1', 'coasted', '0', '0', '0', '0')},
        {case('ax', 'NULL', 'zx', 'ax', 'NULL', 'ax + a * (zx - ax)')}, {case('ay', 'NULL', 'zy', 'ay', 'NULL', 'ay + a * (zy - ay)')}, mode IN (2, 5)
      FROM (SELECT t.match_id, t.slot, t.k, t.time_s, t.x AS zx, t.y AS zy, s.px, s.py, s.vx, s.vy, s.sx, s.sy, s.rejected, s.coasted, {_AX} AS ax, {_AY} AS ay, {_VX} AS nvx, {_VY} AS nvy, a,
          CASE WHEN t.x IS NULL THEN CASE WHEN s.px IS NOT NULL AND s.coasted < 6 THEN 0 ELSE 1 END WHEN s.px IS NULL THEN 2 WHEN {_GAP} THEN CASE WHEN s.rejected < 4 THEN 3 ELSE 4 END ELSE 5 END AS mode
        FROM ab s JOIN {source} t ON t.match_id = s.match_id AND t.slot = s.slot AND t.k = s.k + 1, (SELECT {alpha}::DOUBLE AS a, {alpha}::DOUBLE * {alpha}::DOUBLE / (2 - {alpha}::DOUBLE) AS b))"""
