import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nickline.operators import geometry

# A calibration's points in fractions of the frame and its residuals in centimetres.
POINTS = {
    "front_left_corner": (0.32394, 0.53892), "front_right_corner": (0.73441, 0.53774), "short_left": (0.24934, 0.71816), "short_right": (0.80338, 0.72170), "box_left_inner_front": (0.38461, 0.72052),
    "box_right_inner_front": (0.66412, 0.72170), "box_left_outer_back": (0.21054, 0.80012), "box_left_inner_back": (0.36240, 0.80307), "box_right_inner_back": (0.67706, 0.80602), "box_right_outer_back": (0.82925, 0.80602),
}
RESIDUALS = [13.1, 20.2, 11.6, 12.1, 14.3, 13.7, 9.2, 6.8, 5.7, 6.8]


def test_fit_has_the_known_residuals():
    marks = geometry.landmarks()
    _, to_court = geometry.fit([(marks[n], p) for n, p in POINTS.items()])
    q = np.array([[*p, 1.0] for p in POINTS.values()]) @ to_court.T
    far = 100 * np.linalg.norm(q[:, :2] / q[:, 2:] - [marks[n] for n in POINTS], axis=1)
    assert np.abs(far - RESIDUALS).max() < 0.06
    m = np.array(geometry.MATRIX)
    assert np.allclose(to_court / to_court[0, 0], m / m[0, 0], atol=2e-3)


def test_too_few_or_degenerate_points():
    with pytest.raises(ValueError):
        geometry.fit([((0, 0), (0, 0))] * 3)
    with pytest.raises(ValueError):
        geometry.fit([((float(i), float(i)), (float(i), float(i))) for i in range(5)])


@settings(max_examples=20, deadline=None)
@given(st.floats(0, 6.4), st.floats(0, 9.75))
def test_round_trip(x, y):
    m = np.array(geometry.MATRIX)
    q = m @ (np.linalg.inv(m) @ (x, y, 1.0))
    assert np.allclose(q[:2] / q[2], (x, y), atol=1e-9)


@pytest.mark.parametrize("lab, rgb", [((153, 126, 117), (130, 146, 164)), ((132, 129, 113), (111, 124, 149)), ((151, 127, 112), (124, 144, 170)), ((121, 127, 110), (92, 114, 142))])
def test_lab_to_rgb(lab, rgb):
    assert max(abs(a - b) for a, b in zip(geometry.lab_to_rgb(lab), rgb)) <= 1
