"""Points matched to rallies, and what ended each rally."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import OutcomeRule

RALLY = ["match_id", "rally_index"]


def nearest(left: DataFrame, right: DataFrame, at: str, to: str, within_s: float, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """left with the columns of the row of right nearest in time, at most within_s away; ties go to the first by order.

    Time is cut into buckets of that width and right stands in three of them, so this is an equi-join with a filter; left's key names its rows.
    """
    bucket = lambda c: F.floor(F.col(c) / within_s).cast("bigint")
    near = right.select(F.col("match_id"), F.col(to).alias("_to"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*columns).alias("_row"), F.explode(F.array(bucket(to) - 1, bucket(to), bucket(to) + 1)).alias("_b"))
    keys = ["match_id", *key.split(",")]
    joined = left.withColumn("_b", bucket(at)).join(near, ["match_id", "_b"]).withColumn("_d", F.abs(F.col(at) - F.col("_to"))).filter(F.col("_d") <= within_s)
    best = joined.groupBy(*keys).agg(F.min_by("_row", F.struct("_d", *[f"_o{i}" for i in range(len(order))])).alias("_row"))
    return left.join(best, keys, "left").select(*left.columns, *[F.col(f"_row.{c}").alias(c) for c in columns])


def rally_points(rallies: DataFrame, points: DataFrame, rule: OutcomeRule = OutcomeRule()) -> DataFrame:
    """rallies with point_s, row, game of the point nearest their end.  A point may close two rallies."""
    return nearest(rallies, points.withColumn("point_s", F.col("time_s")), "end_s", "point_s", rule.window_s, "rally_index", ["point_s", "row"], ["point_s", "row", "game"])


def hitters(shots: DataFrame) -> DataFrame:
    """match_id, rally_index, server, last_hitter."""
    return shots.groupBy(*RALLY).agg(F.min_by("player", "time_s").alias("server"), F.max_by("player", "time_s").alias("last_hitter"))


def _played(rallies: DataFrame, shots: DataFrame, points: DataFrame, rule: OutcomeRule) -> DataFrame:
    """Each rally with its point, its hitters and next, who serves the rally after it; each input is read once."""
    after = Window.partitionBy("match_id").orderBy("rally_index")
    follows = F.lead("rally_index").over(after) == F.col("rally_index") + 1
    return rally_points(rallies, points, rule).join(hitters(shots), RALLY, "left").withColumn("next", F.when(follows, F.lead("server").over(after)))


def _votes() -> tuple:
    """(votes for rows as players' numbers, votes for the other way round), to be summed over a match."""
    return tuple(F.sum(F.when(c, 1).otherwise(0)) for c in (F.col("row") == F.col("next"), F.col("row") != F.col("next")))


def row_votes(rallies: DataFrame, shots: DataFrame, points: DataFrame, rule: OutcomeRule = OutcomeRule()) -> DataFrame:
    """match_id, crossed, agreement, votes: whether the scoreboard's rows are the players' numbers or the other way round.

    Who scores a rally serves the next one.
    """
    straight, cross = _votes()
    tally = _played(rallies, shots, points, rule).groupBy("match_id").agg(straight.alias("straight"), cross.alias("cross"))
    votes = F.col("straight") + F.col("cross")
    return tally.select("match_id", (F.col("straight") < F.col("cross")).alias("crossed"), F.when(votes > 0, F.greatest("straight", "cross") / votes).otherwise(0.0).alias("agreement"), votes.cast("bigint").alias("votes"))


def outcomes(rallies: DataFrame, shots: DataFrame, points: DataFrame, rule: OutcomeRule = OutcomeRule()) -> DataFrame:
    """match_id, rally_index, end_s, kind, scorer, game: winner, error or let.

    A rally without a point is a let in the highest game so far; a point in a rally without shots makes a let with a scorer.
    """
    straight, cross = (v.over(Window.partitionBy("match_id")) for v in _votes())
    rows = _played(rallies, shots, points, rule).withColumn("crossed", straight < cross)
    scorer = F.when(F.col("crossed"), 1 - F.col("row")).otherwise(F.col("row"))
    so_far = F.coalesce(F.max("game").over(Window.partitionBy("match_id").orderBy("rally_index")), F.lit(0))
    kind = F.when(F.col("row").isNull() | F.col("last_hitter").isNull(), "let").when(F.col("last_hitter") == scorer, "winner").otherwise("error")
    return rows.select(*RALLY, "end_s", kind.alias("kind"), scorer.cast("int").alias("scorer"), F.when(F.col("row").isNull(), so_far).otherwise(F.col("game")).cast("int").alias("game"))


def game_tally(found: DataFrame) -> DataFrame:
    """match_id, game, winners, errors, lets and each player's points."""
    count = lambda c, n: F.sum(F.when(c, 1).otherwise(0)).cast("bigint").alias(n)
    kind, who = F.col("kind"), F.col("scorer")
    return found.groupBy("match_id", "game").agg(count(kind == "winner", "winners"), count(kind == "error", "errors"), count(kind == "let", "lets"), count((kind != "let") & (who == 0), "points_0"), count((kind != "let") & (who == 1), "points_1"))


def reconciled(tally: DataFrame, board: DataFrame, crossed: DataFrame) -> DataFrame:
    """tally with what the board shows for each player (match_id, row, game, value) and whether they agree."""
    seat = F.when(F.coalesce("crossed", F.lit(False)), 1 - F.col("row")).otherwise(F.col("row"))
    seen = board.join(crossed, "match_id", "left").groupBy("match_id", "game").agg(*[F.max(F.when(seat == p, F.col("value"))).alias(f"board_{p}") for p in (0, 1)])
    return tally.join(seen, ["match_id", "game"], "left").withColumn("agrees", (F.col("points_0") == F.col("board_0")) & (F.col("points_1") == F.col("board_1")))
