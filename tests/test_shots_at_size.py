"""Shots of long matches: a row's work doesn't grow with its match, nor a peak's with its rally."""

import time

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nickline.operators import segments, shots
from nickline.plans import queries


def plain(times, strength, gap):
    kept = []
    for i in np.argsort(-strength, kind="stable"):
        if all(abs(times[i] - times[j]) >= gap for j in kept):
            kept.append(i)
    return sorted(kept)


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 5)), max_size=30), st.integers(1, 6))
def test_suppression_is_that_of_a_plain_reading(peaks, gap):
    t, p = np.array([a for a, _ in peaks], float), np.array([b for _, b in peaks], float)
    assert shots.suppressed(t, p, gap).tolist() == plain(t, p, gap)


def test_suppression_of_a_very_long_rally():
    began = time.process_time()
    assert len(shots.suppressed(np.arange(40_000.0), np.ones(40_000), 0.4)) == 40_000
    assert time.process_time() - began < 10


def test_rows_find_their_rally_among_very_many(spark):
    rallies = spark.range(12_000).selectExpr("1 AS match_id", "CAST(id AS INT) AS rally_index", "id * 5.0D + 1 AS start_s", "id * 5.0D + 4 AS end_s")
    rows = spark.range(240_000).selectExpr("1 AS match_id", "id AS k", "id * 0.25D AS time_s")
    began = time.time()
    out = shots.within(rows, rallies).agg(F.count("*").alias("n"), F.sum((F.col("rally_index") != F.floor(F.col("time_s") / 5)).cast("int")).alias("wrong")).first()
    assert (out.n, out.wrong) == (144_000, 0)
    assert time.time() - began < 30


def test_rallies_over_several_stretches_and_odd_ones(spark):
    spans = [(1, 0, -45.0, -29.0), (1, 1, -3.0, 95.0), (1, 2, 60.0, 130.0), (1, 3, 140.0, 140.0), (1, 4, 160.0, 150.0), (1, 5, 200.0, None), (2, 0, 0.0, 30.0)]
    rallies = spark.createDataFrame(spans, "match_id int, rally_index int, start_s double, end_s double")
    times = [-45.0, -30.0, -29.0, -3.0, 0.0, 30.0, 60.0, 94.9, 95.0, 129.9, 130.0, 140.0, 155.0, 210.0, None]
    rows = spark.createDataFrame([(m, t) for m in (1, 2, 3, None) for t in times], "match_id int, time_s double")
    found = sorted(map(tuple, shots.within(rows, rallies).select("match_id", "time_s", "rally_index").collect()))
    fits = [(m, t, i) for m in (1, 2) for t in times if t is not None for i in [next((i for n, i, a, b in spans if n == m and b is not None and a <= t < b), None)] if i is not None]
    assert found == fits


def test_rallies_wider_than_a_batch(spark):
    rows = spark.createDataFrame([(1, r, s, k, k / 10, float((k * (r + 2) + s) % 7)) if k % 9 else (1, r, s, k, k / 10, None) for r in range(3) for s in (0, 1) for k in range(50)], "match_id int, rally_index int, slot int, k bigint, time_s double, smooth double")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    want = sorted(map(tuple, shots.candidates(rows).collect()))
    spark.conf.set(key, "7")
    try:
        assert want and sorted(map(tuple, shots.candidates(rows).collect())) == want
    finally:
        spark.conf.set(key, before)


def test_runs_of_rest_in_one_walk_are_those_of_windows(spark):
    rng = np.random.default_rng(5)
    rows = []
    for m in (1, 2, None):
        for k in range(400):
            for s in (0, 1):
                if rng.random() < 0.9:
                    x, y = (float(rng.normal()) * (0.2 if k // 30 % 2 else 0.02) for _ in range(2))
                    rows.append((m, k, s, k * 0.1, 2, None if rng.random() < 0.1 or 150 < k < 170 else x, None if rng.random() < 0.05 else y))
    track = spark.createDataFrame(rows, "match_id int, k long, slot int, time_s double, blobs int, x double, y double")
    want = sorted(map(repr, segments.runs(segments.resting(track), "resting").select("match_id", "run", "resting", "start_s", "end_s").collect()))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    for size in ("7", "10000"):
        spark.conf.set(key, size)
        try:
            assert sorted(map(repr, segments.rest_runs(track).collect())) == want and len(want) > 20
        finally:
            spark.conf.set(key, before)
    assert segments.rest_runs(track.limit(0)).collect() == []


def test_rallies_of_shots_need_no_window_over_a_match(spark, tmp_path):
    odd = spark.sql("SELECT id AS event_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts, 'click' AS event_type, 0.5D AS value FROM range(3)")
    odd.write.parquet(f"{tmp_path}/events.parquet")
    made, plain = [], segments.between
    segments.between = lambda found, *a, **k: made.append(found) or plain(found, *a, **k)
    try:
        queries._held(spark, str(tmp_path))
    finally:
        segments.between = plain
    assert made and "Window" not in made[0]._jdf.queryExecution().optimizedPlan().toString()


def test_lookup_of_rallies_walks_no_lists(spark):
    rallies = spark.createDataFrame([(1, 0, 0.0, 4.0)], "match_id int, rally_index int, start_s double, end_s double")
    rows = spark.createDataFrame([(1, 1.0)], "match_id int, time_s double")
    text = shots.within(rows, rallies)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in text and "collect_list" not in text
