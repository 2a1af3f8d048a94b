"""Settings of the operators; every operator takes them explicitly."""

from __future__ import annotations

from dataclasses import dataclass

# A squash court in metres, and the defaults of each operator.


@dataclass(frozen=True)
class CourtSpec:
    width: float = 6.40
    length: float = 9.75
    short_line: float = 4.26
    box: float = 1.60

    @property
    def half(self) -> float:
        return self.width / 2


@dataclass(frozen=True)
class Smoothing:
    window: int = 5
    alpha: float = 0.32
    max_speed: float = 7.0
    max_rejects: int = 4
    gap_coast: int = 6


#: none passes tracks through.
LEVELS = {"none": None, "light": 0.50, "normal": 0.32, "strong": 0.18}


@dataclass(frozen=True)
class Play:
    window_s: float = 15.0
    fraction: float = 0.35
    min_segment_s: float = 8.0


@dataclass(frozen=True)
class RallyRule:
    quiet_speed: float = 0.70
    activity_s: float = 1.0
    box_margin: float = 0.45
    min_break: float = 2.5
    min_rally: float = 2.5
    serve_bonus: float = 1.0


@dataclass(frozen=True)
class ShotRule:
    smooth_s: float = 0.3
    prominence: float = 0.4
    gap_s: float = 0.4
    anchor_s: float = 2.0


@dataclass(frozen=True)
class OutcomeRule:
    window_s: float = 3.0


@dataclass(frozen=True)
class VolleyRule:
    l2: float = 1.0
    iterations: int = 25
    folds: int = 3
    least_labels: int = 8
    tolerance_s: float = 1.0
    reach_s: float = 1.0
    at: tuple = (5, 10, 20)


@dataclass(frozen=True)
class ScoreRule:
    hz: float = 2.0
    cells: int = 5
    level: float = 2.5
    sigmas: float = 4.0
    persist_s: float = 3.0
    settle_s: float = 2.0
    gap_s: float = 6.0
    stable_s: float = 1.5
    distance: float = 0.04


@dataclass(frozen=True)
class Detector:
    player_width: int = 480
    min_area: int = 400
    min_height: int = 45
    difference: int = 25
    chunk: int = 300
    background: int = 21
    accel: float = 5.0
    noise: float = 4.0
    sigmas: float = 3.5
    gate: tuple = (18.0, 100.0)
    coast: int = 6
    colour_weight: float = 0.8
    lightness: float = 0.4
    memory: float = 0.95
    anchor_weight: float = 0.6
    identity_memory: float = 0.88
    identity_least: int = 8
    identity_margin: float = 4.0
    seed_margin: float = 6.0
    seed_max: float = 28.0
    still_s: float = 3.0
    still_samples: int = 10
    still_px: float = 25.0
    still_anchor: float = 28.0
    ratio: float = 2.0
    anchor_max: float = 40.0
    revive: tuple = (18.0, 0.6)
    collapse_px: float = 16.0
    candidates: int = 4
    ignore: float = 0.30
    split_fraction: float = 0.55


COURT = CourtSpec()
#: The part of a frame that is looked at, as fractions of it (left, top, right, bottom).
ROI = (0.134, 0.138, 0.944, 0.992)
#: Where the score stands in a frame.
SCORE_BOX = (0.52656, 0.90093, 0.62865, 0.98796)
#: The settings that the search for a detector tries, five windows of twelve seconds.
DETECTOR_GRID = {"difference": (12, 15, 18, 22, 25, 30), "min_area": (300, 400, 550), "min_height": (35, 45)}
WINDOWS, WINDOW_S = 5, 12.0
#: Seconds between samples of the test tracks.
DT = 0.1


def half_window(seconds: float, dt: float) -> int:
    """Samples on each side of a centred window of that length."""
    return max(1, int(round(seconds / dt)) // 2)
