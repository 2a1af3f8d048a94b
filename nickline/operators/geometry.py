"""The court: homography, projection and places on it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import COURT, ROI, CourtSpec, Detector, RallyRule

#: Image fraction to metres, verified.
MATRIX = ((15.306796529, 6.277857336, -8.296124482), (-0.071907909, 32.670756234, -17.705441654), (0.017280455, 1.786243524, 0.025195448))


def landmarks(court: CourtSpec = COURT) -> dict[str, tuple[float, float]]:
    """Named points of the floor in metres; the names are fixed values, which calibration files carry."""
    w, n, s, b, h = court.width, court.length, court.short_line, court.box, court.half
    return {
        "front_left_corner": (0.0, 0.0), "front_right_corner": (w, 0.0), "back_left_corner": (0.0, n), "back_right_corner": (w, n),
        "short_left": (0.0, s), "short_right": (w, s), "tee": (h, s), "half_court_back": (h, n),
        "box_left_inner_front": (b, s), "box_left_outer_back": (0.0, s + b), "box_left_inner_back": (b, s + b),
        "box_right_inner_front": (w - b, s), "box_right_outer_back": (w, s + b), "box_right_inner_back": (w - b, s + b),
    }


def fit(pairs: list[tuple[tuple[float, float], tuple[float, float]]]) -> tuple[np.ndarray, np.ndarray]:
    """(metres to image, image to metres) from (metres, image) pairs: a normalised linear fit, then Gauss-Newton on the image error."""
    if len(pairs) < 4:
        raise ValueError("a homography takes four points or more")
    world, image = (np.array([p[i] for p in pairs], float) for i in (0, 1))

    def normal(x):
        c, s = x.mean(0), np.sqrt(2) / max(1e-12, np.linalg.norm(x - x.mean(0), axis=1).mean())
        return np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])

    a, b = normal(world), normal(image)
    p, q = world @ a[:2, :2].T + a[:2, 2], image @ b[:2, :2].T + b[:2, 2]
    rows = []
    for (x, y), (u, v) in zip(p, q):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
    _, s, vt = np.linalg.svd(np.array(rows))
    if s[7] < 1e-9 * s[0]:
        raise ValueError("the points don't fix a homography")
    h = np.linalg.inv(b) @ vt[-1].reshape(3, 3) @ a
    h = (h / h[2, 2]).ravel()[:8]
    x, y = world.T
    damp = 1e-3
    error = lambda g: (np.stack([(g[0] * x + g[1] * y + g[2]), (g[3] * x + g[4] * y + g[5])], 1) / (g[6] * x + g[7] * y + 1)[:, None] - image).ravel()
    for _ in range(200):
        w = h[6] * x + h[7] * y + 1
        u, v = (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w
        o = np.zeros_like(x)
        jac = np.empty((2 * len(x), 8))
        jac[::2] = np.stack([x / w, y / w, 1 / w, o, o, o, -u * x / w, -u * y / w], 1)
        jac[1::2] = np.stack([o, o, o, x / w, y / w, 1 / w, -v * x / w, -v * y / w], 1)
        r = error(h)
        n = jac.T @ jac
        step = np.linalg.solve(n + damp * np.diag(np.diag(n)), jac.T @ r)
        if (error(h - step) ** 2).sum() <= (r**2).sum():
            h, damp = h - step, max(damp / 10, 1e-12)
            if np.abs(step).max() < 1e-13:
                break
        else:
            damp *= 10
            if damp > 1e12:
                break
    to_image = np.append(h, 1).reshape(3, 3)
    return to_image, np.linalg.inv(to_image)


def applied(matrix, x, y) -> tuple:
    """Columns of the projected point; NaN where it lies at infinity."""
    m = [[float(v) for v in row] for row in matrix]
    on = [F.lit(r[0]) * x + F.lit(r[1]) * y + F.lit(r[2]) for r in m]
    return tuple(F.when(F.abs(on[2]) < 1e-12, F.lit(float("nan"))).otherwise(on[i] / on[2]) for i in (0, 1))


def residuals(points: DataFrame, matrix) -> DataFrame:
    """points (name, image_x, image_y, court_x, court_y) with residual_cm, how far the projection of each misses it."""
    x, y = applied(matrix, F.col("image_x"), F.col("image_y"))
    return points.withColumn("residual_cm", 100 * F.sqrt(F.pow(x - F.col("court_x"), 2) + F.pow(y - F.col("court_y"), 2)))


def inside(x, y, court: CourtSpec = COURT, margin: float = 0.5):
    return x.between(-margin, court.width + margin) & y.between(-margin, court.length + margin)


def project(foot: DataFrame, matrix, court: CourtSpec = COURT) -> DataFrame:
    """foot (… fx, fy, coasted) with x, y in metres and off, a measured point off the court; coasted and off points have no position."""
    x, y = applied(matrix, F.col("fx"), F.col("fy"))
    out = foot.withColumn("px", F.when(~F.col("coasted"), x)).withColumn("py", F.when(~F.col("coasted"), y))
    bad = F.isnan("px") | F.isnan("py") | ~inside(F.col("px"), F.col("py"), court)
    out = out.withColumn("off", F.coalesce(F.col("px").isNotNull() & bad, F.lit(False)))
    return out.withColumn("x", F.when(~F.col("off"), F.col("px"))).withColumn("y", F.when(~F.col("off"), F.col("py"))).drop("px", "py")


def service_box(x, y, court: CourtSpec = COURT, margin: float = RallyRule.box_margin):
    """'L', 'R' or null."""
    deep = y.between(court.short_line - margin, court.short_line + court.box + margin)
    return F.when(deep & (x <= court.box + margin), "L").when(deep & (x >= court.width - court.box - margin), "R")


def _serves(server: str, receiver: str, court: CourtSpec, margin: float):
    box = service_box(F.col(f"x{server}"), F.col(f"y{server}"), court, margin)
    stands = (F.col(f"y{receiver}") >= court.short_line) & ((box == "L") != (F.col(f"x{receiver}") < court.half))
    return F.coalesce(box.isNotNull() & stands, F.lit(False))


def serve_ready(samples: DataFrame, court: CourtSpec = COURT, margin: float = RallyRule.box_margin) -> DataFrame:
    """samples with server, the player in a box whose opponent waits behind the other half (the first if both), and ready."""
    both = F.col("x0").isNotNull() & F.col("x1").isNotNull()
    server = F.when(both & _serves("0", "1", court, margin), 0).when(both & _serves("1", "0", court, margin), 1)
    return samples.withColumn("server", server).withColumn("ready", server.isNotNull())


def visible_depth(to_image, court: CourtSpec = COURT) -> float:
    """How deep the floor is seen: forty halvings for where the lowest of three points leaves the frame."""
    h = np.asarray(to_image, float)

    def low(y: float) -> float:
        at = [h @ (x, y, 1.0) for x in (0.0, court.half, court.width)]
        return max(p[1] / p[2] for p in at)

    a, b = 0.0, court.length
    for _ in range(40):
        mid = (a + b) / 2
        a, b = (mid, b) if low(mid) <= 1.0 else (a, mid)
    return a


def plan_point(x, y, scale: float = 46.0, margin: float = 26.0) -> tuple:
    """Whole pixels on the plan of the court."""
    return F.bround(margin + x * scale).cast("int"), F.bround(margin + y * scale).cast("int")


def lines(court: CourtSpec = COURT) -> list[tuple[str, float, float, float, float]]:
    """(part, x0, y0, x1, y1): the floor's lines in metres, by walls, the short and half-court lines, and the boxes' sides."""
    w, n, s, b, m = court.width, court.length, court.short_line, court.box, court.half
    out = [("wall", 0.0, 0.0, w, 0.0), ("wall", 0.0, 0.0, 0.0, n), ("wall", w, 0.0, w, n), ("wall", 0.0, n, w, n), ("line", 0.0, s, w, s), ("line", m, s, m, n)]
    for x in (0.0, w - b):
        out += [("box", *p) for p in ((x, s, x + b, s), (x, s + b, x + b, s + b), (x, s, x, s + b), (x + b, s, x + b, s + b))]
    return out


def drawn_lines(spark, to_image, width: int, height: int, court: CourtSpec = COURT) -> DataFrame:
    """part, x0, y0, x1, y1: the floor's lines in whole pixels of a frame of that size."""
    rows = spark.createDataFrame(lines(court), "part string, x0 double, y0 double, x1 double, y1 double")
    ends = [applied(to_image, F.col(f"x{i}"), F.col(f"y{i}")) for i in (0, 1)]
    at = lambda c, size: F.bround(c * size).cast("int")
    return rows.select("part", *[at(c, size).alias(f"{n}{i}") for i, p in enumerate(ends) for c, n, size in zip(p, "xy", (width, height))])


def lab_to_rgb(lab) -> tuple[int, int, int]:
    """8-bit Lab (128 is zero, 255 is 100) as sRGB under D65."""
    light, a, b = lab[0] * 100 / 255, lab[1] - 128.0, lab[2] - 128.0
    fy = (light + 16) / 116
    cube = lambda f: f**3 if f > 6 / 29 else 3 * (6 / 29) ** 2 * (f - 4 / 29)
    xyz = np.array([0.95047 * cube(fy + a / 500), cube(fy), 1.08883 * cube(fy - b / 200)])
    lin = np.array([[3.2404542, -1.5371385, -0.4985314], [-0.969266, 1.8760108, 0.041556], [0.0556434, -0.2040259, 1.0572252]]) @ xyz
    gamma = np.where(lin <= 0.0031308, 12.92 * lin, 1.055 * np.maximum(lin, 0) ** (1 / 2.4) - 0.055)
    return tuple(int(v) for v in np.clip(np.round(255 * gamma), 0, 255))


def rgb_hex(red, green, blue):
    """`#rrggbb` of three columns of whole numbers."""
    return F.format_string("#%02x%02x%02x", red, green, blue)


def analysed_size(width: int, height: int, to: int = Detector.player_width) -> tuple[int, int]:
    """The size at which frames of that size are looked at."""
    return to, round(height * to / width)


def roi_box(size: tuple[int, int], roi=ROI) -> tuple[int, int, int, int]:
    """The part looked at, in whole pixels of that size."""
    return tuple(round(r * size[i % 2]) for i, r in enumerate(roi))


def foot_fraction(foot_x, foot_y, width: int, height: int) -> tuple:
    """Columns of a foot, given in pixels of the part looked at, as fractions of the frame; null for null, as of a position that was only predicted."""
    size = analysed_size(width, height)
    x0, y0, _, _ = roi_box(size)
    return (foot_x + x0) / F.lit(float(size[0])), (foot_y + y0) / F.lit(float(size[1]))


def roi_point(x, y, width: int, height: int) -> tuple:
    """The other way round: fractions of the frame as pixels of the part looked at."""
    size = analysed_size(width, height)
    x0, y0, _, _ = roi_box(size)
    return x * F.lit(float(size[0])) - x0, y * F.lit(float(size[1])) - y0


def box_in_roi(x0, y0, x1, y1, width: int, height: int) -> tuple:
    """A box in fractions of the frame as fractions of the part looked at, cut off at its edges."""
    left, top, right, bottom = roi_box(analysed_size(width, height))
    wide, high = F.lit(float(right - left)), F.lit(float(bottom - top))
    (a, b), (c, d) = roi_point(x0, y0, width, height), roi_point(x1, y1, width, height)
    return F.greatest(F.lit(0.0), a / wide), F.greatest(F.lit(0.0), b / high), F.least(F.lit(1.0), c / wide), F.least(F.lit(1.0), d / high)
