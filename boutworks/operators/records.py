"""Order-free aggregates of bouts: records, pairs, points and Pythagorean ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutworks.functions.outcomes import unit_score

PYTHAGOREAN_EXPONENT, PYTHAGOREAN_PRIOR = 2.37, 1.0


def sides(bouts: DataFrame) -> DataFrame:
    """Two rows per played bout: league, who, other, score (1, 0.5, 0), pts_for, pts_against."""
    a = unit_score(F.col("score_a"), F.col("score_b"), F.col("outcome"))
    b = unit_score(F.col("score_b"), F.col("score_a"), 1 - F.col("outcome"))
    side = lambda who, other, score, mine, theirs: F.struct(F.col(who).alias("who"), F.col(other).alias("other"), score.alias("score"), mine.alias("pts_for"), theirs.alias("pts_against"))
    both = F.array(side("a", "b", F.col("outcome"), a, b), side("b", "a", 1 - F.col("outcome"), b, a))
    return bouts.where("a <> b and outcome is not null").select("league", F.explode(both).alias("s")).select("league", "s.*")


def records(bouts: DataFrame) -> DataFrame:
    """Wins, losses, ties and games per competitor."""
    won = lambda value: F.sum(F.when(F.col("score") == value, 1).otherwise(0)).cast("long")
    return sides(bouts).groupBy("league", F.col("who").alias("competitor")).agg(won(1.0).alias("wins"), won(0.0).alias("losses"), won(0.5).alias("ties"), F.count("*").alias("games"))


def pairs(bouts: DataFrame) -> DataFrame:
    """Per ordered pair: games, wins (ties half), margin and points."""
    return sides(bouts).groupBy("league", F.col("who").alias("u"), F.col("other").alias("v")).agg(
        F.count("*").alias("games"),
        F.sum("score").alias("wins"),
        F.sum(F.col("pts_for") - F.col("pts_against")).alias("margin"),
        F.sum("pts_for").alias("points"),
    )


def points(bouts: DataFrame) -> DataFrame:
    return sides(bouts).groupBy("league", F.col("who").alias("competitor")).agg(F.sum("pts_for").alias("pts_for"), F.sum("pts_against").alias("pts_against"), F.sum(F.col("pts_for") - F.col("pts_against")).alias("margin"))


def pythagorean(bouts: DataFrame, exponent: float = PYTHAGOREAN_EXPONENT, prior: float = PYTHAGOREAN_PRIOR) -> DataFrame:
    share = 1 / (1 + F.pow((F.col("pts_against") + prior) / (F.col("pts_for") + prior), F.lit(exponent)))
    return points(bouts).select("league", "competitor", share.alias("rating"))


def unit_scores(bouts: DataFrame) -> DataFrame:
    """The bouts without scores, so that a win counts 1-0."""
    return bouts.withColumns({"score_a": F.lit(None).cast("double"), "score_b": F.lit(None).cast("double")})
