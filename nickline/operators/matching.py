"""Events against a reference."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair(detected: list[float], reference: list[float], tolerance: float) -> list[tuple]:
    """(detected or None, reference or None): each detection, in order, takes the nearest free reference within the tolerance."""
    free, out = list(reference), []
    for t in detected:
        near = [(abs(r - t), i) for i, r in enumerate(free) if abs(r - t) <= tolerance]
        out.append((t, free.pop(min(near)[1]) if near else None))
    return out + [(None, r) for r in free]


def greedy_match(detected: DataFrame, reference: DataFrame, tolerance: float = 5.0, keys: tuple = ("match_id",)) -> DataFrame:
    """keys, detected_s, reference_s: one-to-one pairs, false alarms (no reference) and missed ones (no detection).

    The greedy walk is serial within a group, such as a match, and detections come in order of time.
    """
    keys = list(keys)
    both = detected.select(*keys, F.col("time_s"), F.lit(0).alias("side")).unionByName(reference.select(*keys, F.col("time_s"), F.lit(1).alias("side")))
    kinds = ", ".join(f"`{k}` {t}" for k, t in detected.select(*keys).dtypes)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time_s", kind="stable")
        rows = pair(pdf[pdf.side == 0].time_s.tolist(), pdf[pdf.side == 1].time_s.tolist(), tolerance)
        return pd.DataFrame([(*key, *r) for r in rows], columns=[*keys, "detected_s", "reference_s"]).astype({"detected_s": "float64", "reference_s": "float64"})

    return both.groupBy(*keys).applyInPandas(run, f"{kinds}, detected_s double, reference_s double")


def scores(pairs: DataFrame, keys: tuple = ("match_id",)) -> DataFrame:
    """keys, tp, fp, fn, precision, recall, f1 of greedy_match()'s rows; a quotient without events is 0."""
    d, r = F.col("detected_s").isNotNull() & ~F.isnan("detected_s"), F.col("reference_s").isNotNull() & ~F.isnan("reference_s")
    count = lambda c, n: F.sum(F.when(c, 1).otherwise(0)).cast("bigint").alias(n)
    out = pairs.groupBy(*keys).agg(count(d & r, "tp"), count(d & ~r, "fp"), count(~d & r, "fn"))
    return rates(out)


def rates(counts: DataFrame) -> DataFrame:
    """counts (tp, fp, fn) with precision, recall and f1."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumn("precision", share(tp, tp + fp)).withColumn("recall", share(tp, tp + fn)).withColumn("f1", F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0))
