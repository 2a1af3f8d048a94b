"""Micro cases of the operators that walk a series."""

import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from nickline.config import Smoothing
from nickline.operators import matching, scoreboard, segments, shots
from nickline.operators.tracks import _Path


def path(points, alpha=0.32):
    p = _Path(alpha, 0.1, Smoothing())
    return [p(z) for z in points]


def test_gap_of_six_coasts_and_of_seven_breaks():
    z = (1.0, 1.0)
    six, seven = path([z, *[None] * 6, z]), path([z, *[None] * 7, z])
    assert all(p is not None and not s for p, s in six[1:7]) and six[7] == (z, True)
    assert seven[7] == (None, False) and seven[8] == (z, True)


def test_four_outliers_coast_and_a_fifth_seeds_anew():
    z, far = (1.0, 1.0), (5.0, 5.0)
    out = path([z, *[far] * 6])
    assert all(p is not None and not s for p, s in out[1:5])
    assert out[5] == (None, False) and out[6] == (far, True)


@given(st.floats(0, 6), st.floats(0, 9))
def test_constants_stay(x, y):
    assert all(np.allclose(p, (x, y)) and s for p, s in path([(x, y)] * 10))


@settings(max_examples=50)
@given(st.lists(st.tuples(st.floats(0, 6), st.floats(0, 9)), min_size=1, max_size=40))
def test_speed_is_bounded(points):
    p = _Path(0.5, 0.1, Smoothing())
    for z in points:
        p(z)
        assert np.hypot(*p.speed) <= 7.0 + 1e-9


def test_short_runs_settle():
    assert segments.settled([[0, 10, True], [10.1, 12, False], [12.1, 30, True]], 8) == [[0, 30, True]]
    assert segments.settled([[0, 3, True], [3.1, 5, False]], 8) == [[0, 5, True]]  # would change for ever
    assert segments.settled([[0, 3, True]], 8) == [[0, 3, True]]
    assert segments.settled([[0, 20, True], [20.1, 40, False]], 8) == [[0, 20, True], [20.1, 40, False]]


def _prominence(v, i):
    higher = np.flatnonzero(v > v[i])
    left, right = max(higher[higher < i], default=0), min(higher[higher > i], default=len(v) - 1)
    return v[i] - max(v[left : i + 1].min(), v[i : right + 1].min())


@settings(max_examples=200)
@given(st.lists(st.integers(0, 6), max_size=25))
def test_prominences_match_a_plain_walk(values):
    v = np.array(values, float)
    at, p = shots.prominences(v)
    want = [i for i in range(1, len(v) - 1) if v[i] >= v[i - 1] and v[i] >= v[i + 1]]
    assert at.tolist() == want
    assert p.tolist() == [_prominence(v, i) for i in want]


def test_suppression_keeps_the_stronger():
    assert shots.suppressed(np.array([0.0, 0.3, 1.0]), np.array([1.0, 2.0, 1.0]), 0.4).tolist() == [1, 2]


def test_alternation_is_the_first_of_each_run(spark):
    rng = random.Random(3)
    rows = [(0, r, rng.randint(0, 1), float(t)) for r in range(60) for t in range(rng.randint(1, 9))]
    serve = {r: rng.choice([None, 0, 1]) for r in range(60)}
    found = spark.createDataFrame(rows, "match_id int, rally_index int, slot int, time_s double")
    server = spark.createDataFrame([(0, r, s) for r, s in serve.items() if s is not None], "match_id int, rally_index int, server int")
    got = {(r.rally_index, r.time_s) for r in shots.alternated(found, server).filter("taken").collect()}
    want = set()
    for r, group in itertools.groupby(rows, key=lambda x: x[1]):
        group = list(group)
        turn = serve[r] if serve[r] is not None else group[0][2]
        for _, _, player, t in group:
            if player == turn:
                want.add((r, t))
                turn = 1 - turn
    assert got == want


@settings(max_examples=100)
@given(st.lists(st.floats(0, 50), max_size=12), st.lists(st.floats(0, 50), max_size=12))
def test_pairs_account_for_all(a, b):
    out = matching.pair(sorted(a), sorted(b), 5.0)
    assert sorted(d for d, _ in out if d is not None) == sorted(a)
    assert sorted(r for _, r in out if r is not None) == sorted(b)
    assert all(abs(d - r) <= 5 for d, r in out if None not in (d, r))


def test_pair_takes_the_first_of_equals():
    assert matching.pair([5.0], [4.0, 6.0], 5.0) == [(5.0, 4.0), (None, 6.0)]
    assert matching.pair([4.0, 6.0], [5.0], 5.0) == [(4.0, 5.0), (6.0, None)]


def test_stable_runs_skip_a_flash():
    one, two = [1, 0] * 8, [0, 1] * 8
    runs = scoreboard.held([one] * 3 + [None] * 3 + [one] * 3 + [two] + [one, one] + [two] * 4, 3)
    assert [(i, m) for i, m in runs] == [(0, one), (3, None), (6, one), (12, two)]


def test_changes_must_last_and_keep_apart():
    a, b = np.zeros(4), np.full(4, 10.0)
    diff = lambda x, y: float(np.abs(x - y).mean())
    flicker = np.array([a] * 8 + [b] * 2 + [a] * 10)
    assert scoreboard.changes(flicker, 2.5, diff) == []
    lasting = np.array([a] * 8 + [b] * 30)
    assert scoreboard.changes(lasting, 2.5, diff) == [(8, 10.0)]
    soon = np.array([a] * 8 + [b] * 7 + [a] * 20)
    assert [k for k, _ in scoreboard.changes(soon, 2.5, diff)] == [8]
