"""Shot queries at size: nothing is found or read twice, and no match's rows are sorted in one task for their ordinals."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from nickline.operators import fitting, segments, shots
from nickline.plans import bridge
from nickline.plans import places as _  # noqa: F401
from nickline.plans.queries import QUERIES

READ_ONCE = "game_tally hitters label_join local_peaks outcomes peak_suppression prominence range_smooth reach_features row_votes served_alternation shot_summary shot_stats shots".split()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def odd_events(spark, folder):
    day = dt.datetime(2024, 1, 1)
    at = [None, None, *[day + dt.timedelta(minutes=m) for m in (0, 0, 59, 60, 61, 1439, 1440, 1441, 14_399, 14_400, 20_000, 43_000)], day + dt.timedelta(microseconds=1), dt.datetime(1969, 12, 31, 23, 30), dt.datetime(1969, 12, 31, 22, 59)]
    rows = [(i * 7 % 97, t, "error" if i % 3 == 0 else "click", i / 7) for i, t in enumerate(at)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{folder}/events.parquet")


@pytest.mark.parametrize("match", [bridge.MATCH, bridge.BY_DAY])
def test_ordinals_are_those_of_one_sort(spark, tmp_path, match):
    odd_events(spark, tmp_path)
    events = spark.read.parquet(f"{tmp_path}/events.parquet")
    want = spark.sql(bridge._SHAPE.format(match=match.format(div="div"), div="div", events="{events}"), events=events)
    have = bridge.track(spark, str(tmp_path), match)
    assert have.dtypes == want.dtypes
    assert sorted(map(repr, have.collect())) == sorted(map(repr, want.collect()))
    assert any("row_number" in line and "hour_no" in line for line in plan(have).splitlines())


def test_rallies_read_their_samples_once(spark):
    rest = spark.createDataFrame([(m, k, k / 10, k // 40 % 2 == 1) for m in (1, 2, None) for k in range(200)], "match_id int, k long, time_s double, resting boolean")
    found = segments.rallies(rest)
    assert plan(found).count("LogicalRDD") == 1
    assert sorted(map(tuple, found.collect())) == [(m, i, *s) for m in (1, 2) for i, s in enumerate([(0.0, 4.0), (7.9, 12.0), (15.9, 19.9)])]


def test_labels_read_their_shots_once(spark):
    found = spark.createDataFrame([(1, 0, 1.0, 0), (1, 0, 5.0, 1), (1, 1, 9.0, 0), (1, 1, 9.0, 0), (2, 0, 1.0, 1)], "match_id int, rally_index int, time_s double, player int")
    marks = spark.createDataFrame([(1, 1.5, "volley"), (1, 0.5, "shot"), (1, 5.9, "volley"), (1, 5.2, "shot"), (1, 10.25, "shot"), (2, None, "volley")], "match_id int, time_s double, kind string")
    labelled = fitting.volley_labels(found, marks)
    assert sorted(map(tuple, labelled.collect()), key=repr) == [(1, 0, 1.0, 0, 1), (1, 0, 5.0, 1, 0), (1, 1, 9.0, 0, None), (1, 1, 9.0, 0, None), (2, 0, 1.0, 1, None)]
    assert plan(labelled).count("LogicalRDD") == 2


@pytest.mark.parametrize("name", READ_ONCE)
def test_events_are_sorted_once(spark, tmp_path, name):
    odd_events(spark, tmp_path)
    found = QUERIES[name](spark, str(tmp_path))
    assert plan(found).count("rn#") == 0 or name == "label_join" and plan(found).count("LogicalRDD") > 1
    found.collect()


def plain(v):
    def lowest(x):
        out = []
        for i, a in enumerate(x):
            j = i
            while j and x[j - 1] <= a:
                j -= 1
            out.append(min(x[j : i + 1]))
        return out

    at = [i for i in range(1, len(v) - 1) if v[i] >= v[i - 1] and v[i] >= v[i + 1]]
    left, right = lowest(v), lowest(v[::-1])[::-1]
    return at, [v[i] - max(left[i], right[i]) for i in at]


@given(st.lists(st.sampled_from([-1.5, 0.0, 0.25, 0.5, 1.0, 3.0]), max_size=25))
def test_prominences_are_those_of_a_plain_reading(v):
    at, p = shots.prominences(np.array(v, float))
    assert (at.tolist(), p.tolist()) == plain(v)
