"""Outcome labels, predictions and score checks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings of an outcome.
A_WORDS = ["win", "won", "1", "a", "true", "t", "yes", "y"]
B_WORDS = ["loss", "lost", "0", "b", "false", "f", "no", "n"]
DRAW_WORDS = ["draw", "tie", "tied", "0.5", "d", "equal", "eq"]


def label_of_text(outcome: Column) -> Column:
    """a, b, draw, or null for anything else."""
    low = F.lower(outcome)
    return F.when(low.isin(A_WORDS), "a").when(low.isin(B_WORDS), "b").when(low.isin(DRAW_WORDS), "draw")


def label_of_number(outcome: Column) -> Column:
    return F.when(outcome == 1.0, "a").when(outcome == 0.0, "b").when(outcome == 0.5, "draw")


def actual_winner(label: Column) -> Column:
    return F.when(label.isin("a", "b"), label)


def predicted_label(p: Column, lower: float, upper: float) -> Column:
    """a above ``upper``, b below ``lower``, else draw; null for null."""
    return F.when(p > upper, "a").when(p < lower, "b").when(p.isNotNull(), "draw")


def predicted_winner(p: Column, a: Column, b: Column, lower: float, upper: float) -> Column:
    return F.when(p > upper, F.lower(a)).when(p < lower, F.lower(b))


def predicted_loser(p: Column, a: Column, b: Column, lower: float, upper: float) -> Column:
    return F.when(p > upper, F.lower(b)).when(p < lower, F.lower(a))


def scores_agree(a: Column, b: Column, outcome: Column) -> Column:
    """Whether two scores are finite, non-negative and fit the outcome; a pair without scores fits."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf"))
    fits = F.signum(a - b) == F.signum(outcome - 0.5)
    return (a.isNull() & b.isNull()) | F.coalesce(finite(a) & finite(b) & fits, F.lit(False))


def unit_score(score: Column, other: Column, outcome: Column) -> Column:
    """The score, or 1-0, 0.5-0.5, 0-1 where there is none."""
    return F.when(score.isNotNull() & other.isNotNull(), score).otherwise(outcome)


def outcome_of(won: Column) -> Column:
    """The outcome of a user's comparison: true is a win of a, false of b, null a draw."""
    return F.when(won, 1.0).when(~won, 0.0).otherwise(0.5)


def is_outcome(outcome: Column) -> Column:
    """Whether it is a win, a loss, a draw, or not known."""
    return outcome.isNull() | outcome.isin(1.0, 0.5, 0.0)


def strict_outcome(outcome: Column) -> Column:
    """The outcome; anything but 1, 0.5, 0 or null ends the query with an error."""
    said = F.concat(F.lit("an outcome must be 1, 0.5 or 0, not "), outcome.cast("string"))
    return F.when(is_outcome(outcome), outcome).otherwise(F.raise_error(said).cast("double"))


def scores_of(attributes: Column, key_a: str, key_b: str) -> tuple[Column, Column]:
    """The scores that a map or struct of numbers holds under two keys: both, or none where one is missing or not finite.

    Values that aren't numbers, as text and booleans, count as missing.
    """

    def number(key: str) -> Column:
        x = attributes.getItem(key)
        number_type = F.typeof(x).rlike("^(tinyint|smallint|int|bigint|float|double|decimal.*)$")
        v = F.when(number_type, x.try_cast("double"))
        return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)

    a, b = number(key_a), number(key_b)
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, a), F.when(both, b)
