"""The filter of tracks on a stream of positions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..config import DT, Smoothing
from ..operators.tracks import _Path

_STATE = "k bigint, px double, py double, sx double, sy double, vx double, vy double, rejected int, coasted int"


def smooth_stream(track: DataFrame, alpha: float = Smoothing.alpha, dt: float = DT, rule: Smoothing = Smoothing()) -> DataFrame:
    """match_id, slot, k, time_s, x, y, solid of a stream of tracks, as alpha_beta() gives them.

    A player's filter is the state kept between batches.  Within a batch samples are put in order; one that comes after a later one was emitted is
    dropped, as a filter can't go back.
    """

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        path, last = _Path(alpha, dt, rule), -1
        if state.exists:
            last, px, py, sx, sy, vx, vy, path.rejected, path.coasted = state.get
            path.at, path.seen, path.speed = (None if px is None else (px, py)), (None if sx is None else (sx, sy)), (vx, vy)
        rows = pd.concat(list(parts)).sort_values("k")
        out = []
        for k, t, x, y in zip(rows.k, rows.time_s, rows.x, rows.y):
            if k > last:
                p, solid = path(None if x is None or math.isnan(x) else (float(x), float(y)))
                out.append((*key, k, t, *(p or (None, None)), solid))
                last = int(k)
        state.update((last, *(path.at or (None, None)), *(path.seen or (None, None)), *path.speed, path.rejected, path.coasted))
        yield pd.DataFrame(out, columns=["match_id", "slot", "k", "time_s", "x", "y", "solid"]).astype({"x": "float64", "y": "float64"})

    out = "match_id int, slot int, k bigint, time_s double, x double, y double, solid boolean"
    return track.groupBy("match_id", "slot").applyInPandasWithState(run, out, _STATE, "append", "NoTimeout")
