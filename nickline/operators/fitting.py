"""Fitting of the rally detector and of the volley classifier, always beside held-out scores."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import COURT, DT, CourtSpec, RallyRule, VolleyRule
from . import geometry, matching, segments, tracks

# The grid of the rally detector, searched in this order.
GRID = {"quiet_speed": (0.5, 0.7, 0.9, 1.1, 1.3), "min_break": (1.5, 2.5, 4.0), "serve_bonus": (1.0, 1.6, 2.4)}
RALLY = ["match_id", "rally_index"]


def grid(spark, values: dict = GRID) -> DataFrame:
    """param, and a column for each setting, in the order of itertools' product."""
    rows = [(i, *map(float, v)) for i, v in enumerate(itertools.product(*values.values()))]
    return spark.createDataFrame(rows, "param int, " + ", ".join(f"{k} double" for k in values))


def grid_scores(track: DataFrame, reference: DataFrame, keys: tuple = ("match_id",), piece: tuple = (), values: dict = GRID, tolerance: float = 5.0, dt: float = DT, rule: RallyRule = RallyRule(), court: CourtSpec = COURT) -> DataFrame:
    """keys, param, the settings, tp, fp, fn, precision, recall, f1 of every setting, in one job.

    Activity and the serve formation are computed once; each sample then stands once for each setting.  piece: further keys of
    contiguous parts, whose rally ends are pooled before they are matched.  All settings, a fixed few, are broadcast.
    """
    spark = track.sparkSession
    whole = (*keys, *piece)
    act = tracks.activity(track, dt, rule.activity_s, whole)
    seat = lambda n, c: F.max(F.when(F.col("slot") == n, F.col(c))).alias(f"{c}{n}")
    ready = geometry.serve_ready(track.groupBy(*whole, "k").agg(seat(0, "x"), seat(0, "y"), seat(1, "x"), seat(1, "y")), court, rule.box_margin).select(*whole, "k", "ready")
    rows = act.join(ready, [*whole, "k"]).crossJoin(F.broadcast(grid(spark, values)))
    least = F.when(F.col("ready") & (F.col("serve_bonus") != 1.0), F.col("quiet_speed") * F.col("serve_bonus")).otherwise(F.col("quiet_speed"))
    own = (*whole, "param", "min_break")
    rest = rows.select(*own, "k", "time_s", (F.col("activity").isNull() | (F.col("activity") < least)).alias("resting"))
    found = segments.rallies(rest, rule, own, F.col("min_break"))
    every = rows.select(*keys, "param").distinct()
    marks = reference.join(every, list(keys))
    pairs = matching.greedy_match(found.select(*keys, "param", F.col("end_s").alias("time_s")), marks.select(*keys, "param", "time_s"), tolerance, (*keys, "param"))
    return matching.scores(pairs, (*keys, "param")).join(F.broadcast(grid(spark, values)), "param")


def grid_search(track: DataFrame, reference: DataFrame, **how) -> DataFrame:
    """The best setting of each match; of equal ones, the first."""
    found = grid_scores(track, reference, **how)
    keys = [k for k in how.get("keys", ("match_id",))]
    best = Window.partitionBy(*keys).orderBy(F.col("f1").desc(), "param")
    return found.withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n")


def time_blocks(track: DataFrame, folds: int = 3) -> DataFrame:
    """match_id, fold, lo, hi: equal parts of each match's time; the last sample falls in none."""
    span = track.groupBy("match_id").agg(F.min("time_s").alias("a"), F.max("time_s").alias("b"))
    edge = lambda i: F.col("a") + (F.col("b") - F.col("a")) * i / folds
    return span.select("match_id", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"), "a", "b").select("match_id", "fold", edge(F.col("fold")).alias("lo"), edge(F.col("fold") + 1).alias("hi"))


def cross_validate(track: DataFrame, reference: DataFrame, folds: int = 3, **how) -> DataFrame:
    """match_id, fold, the settings fitted outside each block and their tp, fp, fn, precision, recall and f1 inside it.

    Blocks without reference inside or outside are left out.
    """
    blocks = time_blocks(track, folds)
    cut = track.join(blocks, "match_id")
    inside = (F.col("time_s") >= F.col("lo")) & (F.col("time_s") < F.col("hi"))
    piece = F.when(F.col("time_s") < F.col("lo"), 0).otherwise(1)
    marks = reference.join(blocks, "match_id").withColumn("test", inside)
    usable = marks.groupBy("match_id", "fold").agg(F.max("test").alias("some"), F.min("test").alias("all")).filter("some and not all").select("match_id", "fold")
    marks = marks.join(usable, ["match_id", "fold"])
    keys = ("match_id", "fold")
    train = grid_search(cut.filter(~inside).withColumn("piece", piece).join(usable, list(keys)), marks.filter("not test").select(*keys, "time_s"), keys=keys, piece=("piece",), **how).select(*keys, "param")
    test = grid_scores(cut.filter(inside).join(usable, list(keys)), marks.filter("test").select(*keys, "time_s"), keys=keys, **how)
    return test.join(train, [*keys, "param"])


def reach(rows: DataFrame, dt: float = DT, rule: VolleyRule = VolleyRule()) -> DataFrame:
    """rows (match_id, rally_index, slot, k, radial) with radial_v and out_reach of the last second within the rally."""
    span = max(1, int(round(rule.reach_s / dt)))
    back = Window.partitionBy(*RALLY, "slot").orderBy("k").rowsBetween(-span, 0)
    first, last = F.first("radial", True).over(back), F.last("radial", True).over(back)
    enough = F.count("radial").over(back) >= 2
    return rows.withColumn("radial_v", F.when(enough, (last - first) / rule.reach_s)).withColumn("out_reach", F.when(enough, last - F.min("radial").over(back)))


#: What volley_features gives of each shot.
FEATURES = ["depth_short", "interval_norm", "radial_v", "out_reach"]


def volley_features(shots: DataFrame, rows: DataFrame, dt: float = DT, rule: VolleyRule = VolleyRule(), court: CourtSpec = COURT) -> DataFrame:
    """match_id, rally_index, time_s, player, depth_short, interval_norm, radial_v, out_reach of each shot in a rally of two or more.

    The serve, and shots without enough history, have no features.
    """
    order = Window.partitionBy(*RALLY).orderBy("time_s")
    whole = Window.partitionBy(*RALLY)
    gaps = shots.withColumn("gap", F.col("time_s") - F.lag("time_s").over(order)).withColumn("n", F.count("*").over(whole)).filter("n >= 2")
    gaps = gaps.withColumn("middle", F.percentile("gap", 0.5).over(whole)).withColumn("ms", F.round(F.col("time_s") * 1000).cast("bigint"))
    near = reach(rows, dt, rule).select(*RALLY, F.col("slot").alias("player"), F.round(F.col("time_s") * 1000).cast("bigint").alias("ms"), "radial_v", "out_reach")
    out = gaps.join(near, [*RALLY, "player", "ms"], "left")
    ok = F.col("gap").isNotNull() & (F.col("middle") > 1e-6) & F.col("radial_v").isNotNull()
    return out.select(*RALLY, "time_s", "player", *[F.when(ok, c).alias(n) for n, c in (("depth_short", F.col("position_y_m") - court.short_line), ("interval_norm", F.col("gap") / F.col("middle")), ("radial_v", F.col("radial_v")), ("out_reach", F.col("out_reach")))])


def volley_labels(shots: DataFrame, marks: DataFrame, tolerance: float = VolleyRule.tolerance_s) -> DataFrame:
    """shots with y: 1 if a volley mark is near and no other mark nearer, 0 if only another mark is near, else null.  A mark may label several shots.

    Time is cut into buckets of the tolerance; the marks that reach into one travel as one array, so shots are read once.
    """
    bucket = lambda c: F.floor(F.col(c) / tolerance).cast("bigint")
    spread = marks.select("match_id", F.col("time_s").alias("mark_s"), (F.col("kind") == "volley").alias("volley"), F.explode(F.array(bucket("time_s") - 1, bucket("time_s"), bucket("time_s") + 1)).alias("b"))
    listed = spread.groupBy("match_id", "b").agg(F.collect_list(F.struct("mark_s", "volley")).alias("marks"))
    far = lambda m: F.abs(F.col("time_s") - m["mark_s"])
    nearest = lambda own: F.array_min(F.transform(F.filter("marks", lambda m: own(m["volley"]) & (far(m) <= tolerance)), far))
    near = shots.withColumn("b", bucket("time_s")).join(listed, ["match_id", "b"], "left").withColumns({"v": nearest(lambda v: v), "o": nearest(lambda v: ~v)})
    y = F.when(F.col("v").isNotNull() & (F.col("o").isNull() | (F.col("v") <= F.col("o"))), 1).when(F.col("o").isNotNull(), 0)
    return near.select(*shots.columns, y.alias("y"))


def standardised(rows: DataFrame, features: list[str], keys: tuple = ()) -> DataFrame:
    """keys, and mean_ and std_ of each feature over the population; a constant one has std 1."""
    sd = lambda c: F.when(F.stddev_pop(c) < 1e-9, 1.0).otherwise(F.stddev_pop(c))
    return rows.groupBy(*keys).agg(*[a for c in features for a in (F.avg(c).alias(f"mean_{c}"), sd(c).alias(f"std_{c}"))])


def logistic(rows: DataFrame, features: list[str], y: str = "y", rule: VolleyRule = VolleyRule()) -> dict:
    """Ridge logistic regression by Newton steps: one aggregation of the normal equations a step, solved on the driver."""
    stats = standardised(rows, features).first()
    mean, std = np.array([stats[f"mean_{c}"] for c in features]), np.array([stats[f"std_{c}"] for c in features])
    x = [F.lit(1.0), *[(F.col(c) - float(m)) / float(s) for c, m, s in zip(features, mean, std)]]
    n = len(x)
    beta, ridge = np.zeros(n), np.diag([0.0] + [rule.l2] * (n - 1))
    for _ in range(rule.iterations):
        z = sum(float(b) * c for b, c in zip(beta, x))
        p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
        w = F.greatest(p * (1 - p), F.lit(1e-6))
        sums = rows.agg(*[F.sum(c * (p - F.col(y))).alias(f"g{i}") for i, c in enumerate(x)], *[F.sum(x[i] * x[j] * w).alias(f"h{i}_{j}") for i in range(n) for j in range(i, n)]).first()
        hess = np.array([[sums[f"h{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]) + ridge
        step = np.linalg.solve(hess, np.array([sums[f"g{i}"] for i in range(n)]) + ridge @ beta)
        beta = beta - step
        if np.abs(step).max() < 1e-8:
            break
    return {"weights": beta, "mean": mean, "std": std}


def predicted(rows: DataFrame, model: dict, features: list[str]) -> DataFrame:
    """rows with score."""
    z = F.lit(float(model["weights"][0]))
    for c, b, m, s in zip(features, model["weights"][1:], model["mean"], model["std"]):
        z = z + float(b) * (F.col(c) - float(m)) / float(s)
    return rows.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0)))))


def folds(rows: DataFrame, group: str, n: int = VolleyRule.folds) -> DataFrame:
    """rows with fold: the group's rank modulo n.  Only distinct groups are ranked."""
    ranked = rows.select(group).distinct().select(group, ((F.row_number().over(Window.orderBy(group)) - 1) % n).cast("int").alias("fold"))
    return rows.join(ranked, group)


def cross_validated(rows: DataFrame, group: str, features: list[str], y: str = "y", rule: VolleyRule = VolleyRule()) -> DataFrame:
    """rows with fold and score, each from the model fitted on the other folds, pooled.  Folds that leave one class to fit on are left out."""
    split, out = folds(rows, group, rule.folds), None
    for f in range(rule.folds):
        fit, test = split.filter(F.col("fold") != f), split.filter(F.col("fold") == f)
        if fit.agg(F.countDistinct(y)).first()[0] < 2:
            continue
        part = predicted(test, logistic(fit, features, y, rule), features)
        out = part if out is None else out.unionByName(part)
    return split.withColumn("score", F.lit(None).cast("double")).limit(0) if out is None else out


def average_precision(rows: DataFrame, keys: tuple, score: str, y: str, order: str) -> DataFrame:
    """keys, ap: mean precision at each positive's rank; equal scores rank by order; 0 without positives."""
    by = Window.partitionBy(*keys).orderBy(F.col(score).desc(), order)
    ranked = rows.withColumn("_rank", F.row_number().over(by)).withColumn("_hits", F.sum(y).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.groupBy(*keys).agg(F.when(F.sum(y) > 0, F.sum(F.col(y) * F.col("_hits") / F.col("_rank")) / F.sum(y)).otherwise(0.0).alias("ap"))


def precision_at(rows: DataFrame, keys: tuple, score: str, y: str, order: str, at: tuple = VolleyRule.at) -> DataFrame:
    """keys, k, precision among the k best (all, if fewer)."""
    by = Window.partitionBy(*keys).orderBy(F.col(score).desc(), order)
    best = rows.withColumn("_rank", F.row_number().over(by)).filter(F.col("_rank") <= max(at))
    each = best.withColumn("k", F.explode(F.array(*[F.lit(k) for k in at]))).filter(F.col("_rank") <= F.col("k"))
    return each.groupBy(*keys, "k").agg(F.avg(y).alias("precision"))


def precision_recall(rows: DataFrame, score: str = "score", y: str = "y", keys: tuple = (), cut: float = 0.5) -> DataFrame:
    """keys, tp, fp, fn, precision, recall, f1 at a threshold."""
    count = lambda c, n: F.sum(F.when(c, 1).otherwise(0)).cast("bigint").alias(n)
    hit, true = F.col(score) >= cut, F.col(y) == 1
    return matching.rates(rows.groupBy(*keys).agg(count(hit & true, "tp"), count(hit & ~true, "fp"), count(~hit & true, "fn")))


def fit_volleys(rows: DataFrame, group: str, features: list[str], order: str, rule: VolleyRule = VolleyRule()) -> dict:
    """The final model with its scores on its own rows and on pooled held-out ones.  Fewer than eight labels or one class is an error."""
    size = rows.agg(F.count("*").alias("n"), F.sum("y").alias("positive")).first()
    if size["n"] < rule.least_labels or size["positive"] in (0, size["n"], None):
        raise ValueError("too few labels, or of one class only")
    model = logistic(rows, features, rule=rule)
    own, held = predicted(rows, model, features), cross_validated(rows, group, features, rule=rule)
    one = F.lit(0).alias("_all")
    ap = lambda df: (r["ap"] if (r := average_precision(df.withColumn("_all", one), ("_all",), "score", "y", order).first()) else 0.0)
    rates = lambda df: precision_recall(df).first().asDict()
    return {**{k: v.tolist() for k, v in model.items()}, "train": rates(own), "train_ap": ap(own), "heldout": rates(held), "heldout_ap": ap(held),
            "heldout_at": {r["k"]: r["precision"] for r in precision_at(held.withColumn("_all", one), ("_all",), "score", "y", order, rule.at).collect()}, "labelled": size["n"], "positive": size["positive"]}
