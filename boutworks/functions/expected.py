"""Win probabilities of every rating system as column expressions.

All take columns and give P(a beats b), a draw counting half. The forms keep
E(a, b) + E(b, a) = 1 and don't overflow.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from boutworks.functions.special import normal_cdf

GLICKO_Q = 0.0057565


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def elo(a: Column, b: Column, base: float = 400.0) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / base))


dwz = elo


def ecf(a: Column, b: Column) -> Column:
    """Grades are converted to the Elo scale first."""
    return elo(a * 7.5 + 700, b * 7.5 + 700)


def glicko_g(rd: Column, q: float = GLICKO_Q) -> Column:
    return 1 / F.sqrt(1 + 3 * q**2 * rd * rd / math.pi**2)


def glicko(a: Column, b: Column, rd_b: Column, q: float = GLICKO_Q) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -glicko_g(rd_b, q) * (a - b) / 400))


def glicko2(mu_a: Column, mu_b: Column, phi_b: Column) -> Column:
    return logistic((mu_a - mu_b) / F.sqrt(1 + 3 * phi_b * phi_b / math.pi**2))


def trueskill_margin(beta: float = 4.166, draw_probability: float = 0.10) -> float:
    return math.sqrt(2) * beta * NormalDist().inv_cdf((draw_probability + 1) / 2)


def trueskill(mu_a: Column, sigma_a: Column, mu_b: Column, sigma_b: Column, beta: float = 4.166, draw_probability: float = 0.10) -> Column:
    """P(win) plus half of P(draw)."""
    spread = F.sqrt(2 * beta**2 + sigma_a * sigma_a + sigma_b * sigma_b)
    margin = trueskill_margin(beta, draw_probability)
    win, not_loss = normal_cdf((mu_a - mu_b - margin) / spread), normal_cdf((mu_a - mu_b + margin) / spread)
    return win + (not_loss - win) / 2


def trueskill_quality(mu_a: Column, sigma_a: Column, mu_b: Column, sigma_b: Column, beta: float = 4.166) -> Column:
    total = 2 * beta**2 + sigma_a * sigma_a + sigma_b * sigma_b
    return F.sqrt(2 * beta**2 / total) * F.exp(-((mu_a - mu_b) * (mu_a - mu_b)) / (2 * total))


def log5(a: Column, b: Column) -> Column:
    """Of two winning shares; the larger side is computed and the other is its complement."""
    high, low = F.greatest(a, b), F.least(a, b)
    top = high * (1 - low) / (high * (1 - low) + low * (1 - high))
    return F.when(a >= b, top).otherwise(1 - top)


def colley(a: Column, b: Column) -> Column:
    return logistic(4 * (a - b))


def massey(a: Column, b: Column, scale: Column) -> Column:
    return 0.5 * (1 + F.tanh((a - b) / scale))


def keener(a: Column, b: Column) -> Column:
    """The share of a, in log form with a floor."""
    low = F.lit(1e-300)
    return 0.5 * (1 + F.tanh(0.5 * (F.log(F.greatest(a, low)) - F.log(F.greatest(b, low)))))


def bradley_terry(a: Column, b: Column) -> Column:
    return logistic(a - b)


def whole_history(a: Column, b: Column) -> Column:
    return logistic((a - b) * (math.log(10) / 400))
