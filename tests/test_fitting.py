import numpy as np
import pytest

from nickline.config import VolleyRule
from nickline.operators import fitting


def newton(x, y, l2=1.0):
    d = np.hstack([np.ones((len(x), 1)), (x - x.mean(0)) / x.std(0)])
    b, pen = np.zeros(d.shape[1]), np.diag([0.0] + [l2] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-d @ b))
        b -= np.linalg.solve(d.T @ (d * np.maximum(p * (1 - p), 1e-6)[:, None]) + pen, d.T @ (p - y) + pen @ b)
    return b


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 2))
    y = (x[:, 0] + rng.normal(size=120) > 0.8).astype(int)
    return x, y, spark.createDataFrame([(i, i // 10, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "n int, rally int, a double, b double, y int").cache()


def test_logistic_matches_newton(rows):
    x, y, df = rows
    assert np.allclose(fitting.logistic(df, ["a", "b"])["weights"], newton(x, y), atol=1e-7)


def test_constant_feature(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (1.0, 0)], "a double, y int")
    assert fitting.standardised(df, ["a"]).first().std_a == 1.0
    assert np.isfinite(fitting.logistic(df, ["a"])["weights"]).all()


def test_average_precision(spark):
    df = spark.createDataFrame([(0, 1, 0.9, 1), (0, 2, 0.9, 0), (0, 3, 0.1, 1), (1, 1, 0.5, 0)], "g int, n int, score double, y int")
    got = {r.g: r.ap for r in fitting.average_precision(df, ("g",), "score", "y", "n").collect()}
    assert got[0] == pytest.approx((1 + 2 / 3) / 2) and got[1] == 0.0
    at = {(r.g, r.k): r.precision for r in fitting.precision_at(df, ("g",), "score", "y", "n", (2, 20)).collect()}
    assert at[0, 2] == 0.5 and at[0, 20] == pytest.approx(2 / 3)


def test_fit_reports_held_out(rows, spark):
    _, _, df = rows
    out = fitting.fit_volleys(df, "rally", ["a", "b"], "n", VolleyRule())
    assert 0 < out["heldout_ap"] <= 1 and out["labelled"] == 120
    with pytest.raises(ValueError):
        fitting.fit_volleys(df.limit(5), "rally", ["a", "b"], "n")


def test_first_of_equal_settings_wins(spark):
    track = spark.createDataFrame([(0, s, k, k * 0.1, 1.0, 1.0) for k in range(100) for s in (0, 1)], "match_id int, slot int, k bigint, time_s double, x double, y double")
    marks = spark.createDataFrame([(0, 5.0)], "match_id int, time_s double")
    assert fitting.grid_search(track, marks).first().param == 0
