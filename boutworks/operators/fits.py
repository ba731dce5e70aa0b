"""Global fits per connected group: Colley, Massey, Keener, Bradley-Terry and whole history.

Bouts are reduced to pairs first; the pair table is a durable state that later
bouts are added to (``add_pairs``) and any fit starts from (``fit_pairs``). Groups
of up to ``DENSE`` competitors are solved in one task each, from at most DENSE
squared pairs; larger groups run the same fit as iterations of joins and sums over
the pair table (``spread_fit``), Bradley-Terry and curves by ``blocks``. All go on until no rating moves by ``TOLERANCE``
(curves: by ``WHR_PRECISION``) and raise ``NotSettled`` otherwise; unfinished ratings
are never returned, at any size.
"""

from __future__ import annotations

import math
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutworks.operators import blocks
from boutworks.operators.components import connected_components
from boutworks.operators.records import pairs
from boutworks.operators.sequence import carried_forward, with_sequence
from boutworks.runtime import discard, staged, work_path

DENSE = 2000
MASSEY_DIGITS, COLLEY_DIGITS, KEENER_DIGITS = 13, 15, 10
KEENER_EPS, KEENER_PRIOR, KEENER_FLOOR = 1e-4, 2.0, 1e-300
BT_REG = 0.1
#: Steps of any fit, and the largest move of a rating at which it has settled (relative to the mean for Keener's).
STEPS, TOLERANCE = 10_000, 1e-10
WHR_W2, WHR_INITIAL, WHR_STEPS, WHR_PRECISION = 300.0, 1500.0, 200, 1e-4
#: Pairs, days and results of a group whose curves one task fits.
WHR_ROWS = 1_000_000
FITTED = "league string, component string, competitor string, rating double, scale double"


class NotSettled(RuntimeError):
    """A fit still moved when its steps were used up."""

    def __init__(self, steps: int) -> None:
        super().__init__(f"the fit did not settle in {steps} steps")


PAIR_SUMS = ["games", "wins", "margin", "points"]


def add_pairs(table: DataFrame, bouts: DataFrame) -> DataFrame:
    """A stored pair table (``records.pairs``) with more bouts added."""
    keys = ["league", "u", "v"]
    both = table.select(*keys, *PAIR_SUMS).unionByName(pairs(bouts).select(*keys, *PAIR_SUMS))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in PAIR_SUMS])


def grouped_pairs(table: DataFrame) -> DataFrame:
    """The pair table with each pair's connected group and the group's size."""
    table = staged(table, "pairs")
    name = lambda c: F.concat_ws("\u0001", "league", c)
    parts = connected_components(table.where("u < v").select(name("u").alias("u"), name("v").alias("v")))
    sizes = parts.groupBy("component").agg(F.count("*").alias("members"))
    return staged(table.withColumn("node", name("u")).join(parts, "node").join(sizes, "component").drop("node"), "grouped-pairs")


def _colley(n: np.ndarray, w: np.ndarray, games: np.ndarray) -> tuple[np.ndarray, float]:
    total = games.sum(axis=1)
    matrix = np.diag(2 + total) - games
    try:
        r = np.linalg.solve(matrix, 1 + (2 * w.sum(axis=1) - total) / 2)
    except np.linalg.LinAlgError:
        r = w.sum(axis=1) / np.maximum(total, 1)
    r = np.round(r, COLLEY_DIGITS)
    size = len(r)
    return (r * (size / 2) / r.sum() if abs(r.sum() - size / 2) > 1e-10 else r), 1.0


def _massey(margin: np.ndarray, w: np.ndarray, games: np.ndarray) -> tuple[np.ndarray, float]:
    size = len(games)
    matrix, p = np.diag(games.sum(axis=1)) - games, margin.sum(axis=1)
    matrix[-1, :], p[-1] = 1.0, 0.0
    try:
        r = np.linalg.solve(matrix, p)
    except np.linalg.LinAlgError:
        r = margin.sum(axis=1) / np.maximum(games.sum(axis=1), 1)
        r = r - r.mean()
    r = np.round(r, MASSEY_DIGITS)
    return r, max(round(math.sqrt(2) * float(np.std(r)), MASSEY_DIGITS), 1e-9) if size else 1e-9


def keener_matrix(points: np.ndarray, games: np.ndarray) -> np.ndarray:
    centered = 2 * (points + 1) / (points + points.T + 2) - 1
    liked = np.where(games > 0, 0.5 + 0.5 * np.sign(centered) * np.sqrt(np.abs(centered)), 0.0)
    np.fill_diagonal(liked, 0.0)
    return liked / (games.sum(axis=1) + KEENER_PRIOR)[:, None] + KEENER_EPS


def _keener(points: np.ndarray, w: np.ndarray, games: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    x = keener_vector(keener_matrix(points, games), np.ones(len(games)), steps)
    return np.round(x * (len(x) / x.sum()), KEENER_DIGITS), 1.0


def keener_vector(matrix: np.ndarray, x: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """The first vector of a positive matrix, to which its powers lead; half steps settle alternating sides too."""
    for _ in range(steps):
        once = matrix @ x
        once /= once.mean()
        twice = matrix @ once
        twice /= twice.mean()
        moved, x = np.max(np.abs(twice - once)), (once + twice) / 2
        if moved < TOLERANCE * 1e-3:
            return np.maximum(x, KEENER_FLOOR)
    raise NotSettled(steps)


def bradley_terry_fit(w: np.ndarray, games: np.ndarray, reg: float = BT_REG, steps: int = STEPS, tol: float = TOLERANCE, start: np.ndarray | None = None) -> np.ndarray:
    """Log-strengths with mean zero: ``w + reg = c e`` with the expected wins e and one c for all.

    Newton steps from ``start``; the system has its constant direction taken out, and a step is cut to two units.
    """
    if reg <= 0 or tol <= 0:
        raise ValueError("reg and tol must be positive")
    n = len(games)
    wins, x = w.sum(axis=1) + reg, np.zeros(n) if start is None else start - start.mean()
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(x[None, :] - x[:, None], -700, 700)))
        own = 1 / (1 + np.exp(-x))
        e = (games * p).sum(axis=1) + 2 * reg * own
        a = games * p * (1 - p)
        slope = np.diag(a.sum(axis=1) + 2 * reg * own * (1 - own)) - a
        c = wins.sum() / e.sum()
        solved = np.linalg.solve(slope, np.stack([wins / c - e, e], axis=1))
        move = solved[:, 0] - solved[:, 0].sum() / solved[:, 1].sum() * solved[:, 1]
        longest = float(np.max(np.abs(move))) if n else 0.0
        x = x + move * min(1.0, 2.0 / longest if longest else 1.0)
        x -= x.mean() if n else 0.0
        if longest < tol:
            return x
    raise NotSettled(steps)


_DENSE_FITS = {
    "colley": lambda t, steps=STEPS: _colley(t["games"], t["wins"], t["games"]),
    "massey": lambda t, steps=STEPS: _massey(t["margin"], t["wins"], t["games"]),
    "keener": lambda t, steps=STEPS: _keener(t["points"], t["wins"], t["games"], steps),
    "bradley_terry": lambda t, steps=STEPS: (bradley_terry_fit(t["wins"], t["games"], steps=steps), 1.0),
}


def fit(bouts: DataFrame, system: str, dense: int = DENSE, steps: int = STEPS) -> DataFrame:
    """(league, component, competitor, rating, scale) of every competitor that played."""
    return fit_pairs(pairs(bouts), system, dense, steps)


def fit_pairs(table: DataFrame, system: str, dense: int = DENSE, steps: int = STEPS) -> DataFrame:
    """The fit of a pair table."""
    return fit_systems(table, [system], dense, steps).drop("system")


def fit_systems(table: DataFrame, systems: list[str], dense: int = DENSE, steps: int = STEPS) -> DataFrame:
    """(system, league, component, competitor, rating, scale): fits of one pair table, each group's in one pass."""
    for system in systems:
        if system not in _DENSE_FITS:
            raise ValueError(f"unknown fit {system}; there are {', '.join(sorted(_DENSE_FITS))}")
    if dense < 1 or steps < 1:
        raise ValueError("dense and steps must be positive")
    table = grouped_pairs(table)

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(group["u"]))
        at = {n: i for i, n in enumerate(names)}
        i, j = group["u"].map(at).to_numpy(), group["v"].map(at).to_numpy()
        grids = {}
        for c in ("games", "wins", "margin", "points"):
            grids[c] = np.zeros((len(names), len(names)))
            grids[c][i, j] = group[c].to_numpy(dtype=float)
        out = []
        for system in systems:
            rating, scale = _DENSE_FITS[system](grids, steps)
            out.append(pd.DataFrame({"system": system, "league": group["league"].iloc[0], "component": group["component"].iloc[0], "competitor": names, "rating": rating, "scale": scale}))
        return pd.concat(out)

    made = table.where(F.col("members") <= dense).groupBy("component").applyInPandas(solve, "system string, " + FITTED)
    large = table.where(F.col("members") > dense)
    if large.isEmpty():
        return made
    for system in systems:
        made = made.unionByName(spread_fit(large, system, steps).withColumn("system", F.lit(system)))
    return made


def spread_fit(table: DataFrame, system: str, steps: int = STEPS) -> DataFrame:
    """The fit of large groups: every step joins the pairs with the current ratings and sums per competitor.

    Colley and Massey are solved by conjugate gradients, Bradley-Terry by Newton
    steps of such solves over blocks, Keener by powers.
    """
    table = table.withColumn("id", F.struct("league", "u")).withColumn("other", F.struct("league", "v"))
    if system == "keener":
        back = table.select(F.col("other").alias("id"), F.col("id").alias("other"), F.col("points").alias("conceded"))
        c = 2 * (F.col("points") + 1) / (F.col("points") + F.col("conceded") + 2) - 1
        table = table.join(back, ["id", "other"]).withColumn("liked", 0.5 + 0.5 * F.signum(c) * F.sqrt(F.abs(c)))
    table = staged(table, "fit-pairs")
    nodes = staged(
        table.groupBy("id", "component", "members").agg(F.sum("games").alias("n"), F.sum("wins").alias("w"), F.sum("margin").alias("m")), "fit-nodes"
    )
    if system == "bradley_terry":
        now = _newton(table, nodes, steps)
    elif system == "keener":
        now = _powers(table, nodes, steps)
    else:
        right = 1 + (2 * F.col("w") - F.col("n")) / 2 if system == "colley" else F.col("m").cast("double")
        system_of = nodes.select("id", "component", (F.col("n") + (2.0 if system == "colley" else 0.0)).alias("d"), right.alias("b"))
        now = _conjugate(table.select("id", "other", F.col("games").cast("double").alias("a")), system_of, ["b"], steps).withColumnRenamed("b", "x")
        if system == "massey":
            now = now.join(now.groupBy("component").agg(F.avg("x").alias("mean")), "component").withColumn("x", F.col("x") - F.col("mean"))
    out = now.select(F.col("id.league").alias("league"), "component", F.col("id.u").alias("competitor"), F.col("x").alias("rating"))
    spread = out.groupBy("component").agg(F.greatest(F.lit(math.sqrt(2)) * F.stddev_pop("rating"), F.lit(1e-9)).alias("scale"))
    return out.join(spread, "component").select("league", "component", "competitor", "rating", (F.col("scale") if system == "massey" else F.lit(1.0)).alias("scale"))


class _Steps:
    """The state of an iteration: written after each step, and the state before it deleted."""

    def __init__(self) -> None:
        self.path: str | None = None

    def put(self, df: DataFrame) -> DataFrame:
        spark, before = df.sparkSession, self.path
        self.path = work_path(spark, "fit-step")
        df.write.parquet(self.path)
        if before:
            discard(spark, before)
        return spark.read.schema(df.schema).parquet(self.path)


def _conjugate(pairs_: DataFrame, nodes: DataFrame, rights: list[str], steps: int, tol: float = 1e-12) -> DataFrame:
    """``nodes`` (id, component, d and the right sides) with each right side replaced by its solution.

    The matrix has ``d`` on the diagonal and ``-a`` of ``pairs_`` (id, other, a)
    beside it, and is symmetric and semidefinite. Each component has steps of its own.
    """
    made = _Steps()
    state = nodes.select("id", "component", "d", *[c for k in rights for c in (F.lit(0.0).alias(f"x_{k}"), F.col(k).alias(f"r_{k}"), (F.col(k) / F.col("d")).alias(f"p_{k}"))])
    for _ in range(steps + 1):
        seen = pairs_.join(state.select(F.col("id").alias("other"), *[f"p_{k}" for k in rights]), "other")
        seen = seen.groupBy("id").agg(*[F.sum(F.col("a") * F.col(f"p_{k}")).alias(f"s_{k}") for k in rights])
        step = state.join(seen, "id").withColumns({f"q_{k}": F.col("d") * F.col(f"p_{k}") - F.col(f"s_{k}") for k in rights}).drop(*[f"s_{k}" for k in rights])
        step = made.put(step)
        left = step.agg(F.max(F.greatest(*[F.abs(F.col(f"r_{k}") / F.col("d")) for k in rights], F.lit(0.0)))).first()[0]
        if left is None or left < tol:
            return step.select("id", "component", "d", *[F.col(f"x_{k}").alias(k) for k in rights])
        if not math.isfinite(left):
            break
        sums, moves = [], {}
        for k in rights:
            r, q, p, d = F.col(f"r_{k}"), F.col(f"q_{k}"), F.col(f"p_{k}"), F.col("d")
            sums += [F.sum(r * r / d).alias(f"rr_{k}"), F.sum(r * q / d).alias(f"rq_{k}"), F.sum(q * q / d).alias(f"qq_{k}"), F.sum(p * q).alias(f"pq_{k}")]
            rr, pq = F.col(f"rr_{k}"), F.col(f"pq_{k}")
            far = F.when(pq > 0, rr / pq).otherwise(0.0)
            after = F.greatest(rr - 2 * far * F.col(f"rq_{k}") + far * far * F.col(f"qq_{k}"), F.lit(0.0))
            moves |= {f"x_{k}": F.col(f"x_{k}") + far * p, f"r_{k}": r - far * q, f"p_{k}": (r - far * q) / d + F.when(rr > 0, after / rr).otherwise(0.0) * p}
        state = step.join(step.groupBy("component").agg(*sums), "component").select("id", "component", "d", *[c.alias(n) for n, c in moves.items()])
    raise NotSettled(steps)


def _newton(table: DataFrame, nodes: DataFrame, steps: int) -> DataFrame:
    """Bradley-Terry log strengths: ``(w + reg) = c e`` with the expected wins e, mean zero and one c for each component; by blocks."""
    numbered = staged(with_sequence(nodes.select("component", "id", "w"), ["component", "id"], "_n"), "fit-numbers")
    number = lambda c, to: numbered.select(F.col("id").alias(c), F.col("_n").alias(to))
    once = table.where("u < v").select("id", "other", "games").join(number("id", "_x"), "id").join(number("other", "_y"), "other")
    links = staged(once.select(F.col("_x").alias("id"), F.col("_y").alias("other"), F.col("games").alias("n"), F.lit(0.0).alias("score")), "fit-links")
    made = blocks.settle(blocks.Strengths(BT_REG), numbered.select(F.col("_n").alias("id"), F.col("component").alias("grp"), F.col("_n").alias("chain"), F.col("w").alias("value")), links, links.count(), TOLERANCE, steps)
    if made is None:
        raise NotSettled(steps)
    now = staged(numbered.join(made.withColumnRenamed("id", "_n"), "_n").select("id", "component", "x"), "fit-strengths")
    means = now.groupBy("component").agg(F.avg("x").alias("mean"))
    return now.join(means, "component").select("id", "component", (F.col("x") - F.col("mean")).alias("x"))


def _powers(table: DataFrame, nodes: DataFrame, steps: int, tol: float = TOLERANCE) -> DataFrame:
    """Keener's vector. A step multiplies twice, the second time in half, so that ratings of two alternating sides settle too."""
    made = _Steps()
    pairs_ = table.select("id", "other", "liked")
    now = nodes.select("id", "component", "members", "n", F.lit(1.0).alias("x"))

    def times(now: DataFrame) -> DataFrame:
        seen = pairs_.join(now.select(F.col("id").alias("other"), F.col("x").alias("y")), "other").groupBy("id").agg(F.sum(F.col("liked") * F.col("y")).alias("s"))
        step = now.join(seen, "id").withColumn("z", F.col("s") / (F.col("n") + KEENER_PRIOR))
        total = step.groupBy("component").agg(F.avg("z").alias("mean"), F.avg("x").alias("x_mean"))
        eps = KEENER_EPS * F.col("x_mean") * F.col("members")  # the perturbation adds the same to all
        return step.join(total, "component").select("id", "component", "members", "n", "x", ((F.col("z") + eps) / (F.col("mean") + eps)).alias("new"))

    for _ in range(steps):
        whole = made.put(times(now)).select("id", "component", "members", "n", F.col("new").alias("x"))
        half = made.put(times(whole))
        moved = half.agg(F.max(F.abs(F.col("new") - F.col("x")))).first()[0]
        now = half.select("id", "component", "members", "n", ((F.col("x") + F.col("new")) / 2).alias("x"))
        if moved is None or moved < tol:
            return now.select("id", "component", "x")
    raise NotSettled(steps)


CURVE = "league string, competitor string, day date, rating double"


def _tridiagonal(diag: np.ndarray, off: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solve a symmetric tridiagonal system in one pass down and one up."""
    n = len(diag)
    d, y = diag.copy(), right.copy()
    for i in range(1, n):
        f = off[i - 1] / d[i - 1]
        d[i] -= f * off[i - 1]
        y[i] -= f * y[i - 1]
    for i in range(n - 1, -1, -1):
        y[i] = (y[i] - (off[i] * y[i + 1] if i + 1 < n else 0.0)) / d[i]
    return y


WHR_SCALE = 400 / math.log(10)
#: Newton steps of a group that is fitted by blocks.
WHR_ROUNDS = 200


class _Curves:
    """The posterior of a group's curves: a rating for each competitor and day, tied to the days beside it and to who was met."""

    def __init__(self, who: np.ndarray, day: np.ndarray, i: np.ndarray, j: np.ndarray, score: np.ndarray, n: np.ndarray, w2: float, initial: float) -> None:
        self.i, self.j, self.score, self.n, self.size = i, j, score, n, len(who)
        self.first = np.concatenate([[True], who[1:] != who[:-1]]) if len(who) else np.zeros(0, bool)
        self.weight = np.where(~self.first[1:], 1 / (w2 * np.maximum(np.diff(day), 1)), 0.0)
        self.anchor, self.initial = self.first / w2, initial

    def _sum(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(at, values, self.size)

    def chance(self, r: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip((r[self.j] - r[self.i]) / WHR_SCALE, -700, 700)))

    def gradient(self, r: np.ndarray) -> np.ndarray:
        pull = self.n * (self.score - self.chance(r)) / WHR_SCALE
        out = self._sum(self.i, pull) - self._sum(self.j, pull) + self.anchor * (self.initial - r)
        tie = np.diff(r) * self.weight
        out[:-1] += tie
        out[1:] -= tie
        return out

    def value(self, r: np.ndarray) -> float:
        apart = (r[self.i] - r[self.j]) / WHR_SCALE
        said = self.n * (self.score * apart - np.logaddexp(0, apart))
        return float(said.sum() - 0.5 * (self.anchor * (r - self.initial) ** 2).sum() - 0.5 * (self.weight * np.diff(r) ** 2).sum())

    def newton(self, r: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        """Newton's step by conjugate gradients with the diagonal as preconditioner."""
        p = self.chance(r)
        met = self.n * p * (1 - p) / WHR_SCALE**2
        diagonal = self._sum(self.i, met) + self._sum(self.j, met) + self.anchor
        diagonal[:-1] += self.weight
        diagonal[1:] += self.weight

        def times(x: np.ndarray) -> np.ndarray:
            out = diagonal * x - self._sum(self.i, met * x[self.j]) - self._sum(self.j, met * x[self.i])
            out[:-1] -= self.weight * x[1:]
            out[1:] -= self.weight * x[:-1]
            return out

        x, left = np.zeros(self.size), gradient.copy()
        way = left / diagonal
        size = float(left @ way)
        least = size * 1e-20
        for _ in range(20 * self.size + 100):
            if size <= least:
                break
            turned = times(way)
            far = size / float(way @ turned)
            x += far * way
            left -= far * turned
            scaled = left / diagonal
            size, before = float(left @ scaled), size
            way = scaled + size / before * way
        return x


def whole_history_fit(games: list[tuple[str, str, date, float, int]], w2: float = WHR_W2, initial: float = WHR_INITIAL, steps: int = WHR_STEPS, precision: float = WHR_PRECISION) -> dict[str, tuple[list[date], np.ndarray]]:
    """Rating per competitor and day, the maximum of the posterior. The last number is how often a result occurred.

    Newton steps on all curves at once, halved while the posterior falls; settled when a whole step moves no rating by ``precision``.
    """
    spots = sorted({(who, day) for a, b, day, _, _ in games for who in (a, b)})
    at = {spot: k for k, spot in enumerate(spots)}
    names = {who: k for k, who in enumerate(dict.fromkeys(who for who, _ in spots))}
    column = lambda f, kind: np.array([f(g) for g in games], dtype=kind)
    curves = _Curves(
        np.array([names[who] for who, _ in spots], dtype=np.int64), np.array([day.toordinal() for _, day in spots], dtype=np.int64),
        column(lambda g: at[g[0], g[2]], np.int64), column(lambda g: at[g[1], g[2]], np.int64), column(lambda g: g[3], float), column(lambda g: g[4], float), w2, initial,
    )
    r = np.full(len(spots), initial)
    value = curves.value(r)
    for _ in range(steps):
        move = curves.newton(r, curves.gradient(r))
        longest, part = float(np.max(np.abs(move), initial=0.0)), 1.0
        while (then := curves.value(r + part * move)) < value - 1e-9 * abs(value) and part > 1e-6:
            part /= 2
        r, value = r + part * move, then
        if longest < precision:
            break
    else:
        raise NotSettled(steps)
    out: dict[str, tuple[list[date], list[float]]] = {who: ([], []) for who in names}
    for (who, day), x in zip(spots, r.tolist(), strict=True):
        out[who][0].append(day)
        out[who][1].append(x)
    return {who: (own, np.array(x)) for who, (own, x) in out.items()}


def whole_history(bouts: DataFrame, steps: int = WHR_STEPS, precision: float = WHR_PRECISION, dense: int = WHR_ROWS, rounds: int = WHR_ROUNDS, w2: float = WHR_W2, initial: float = WHR_INITIAL) -> DataFrame:
    """(league, competitor, day, rating) curves.

    A connected group of up to ``dense`` rows (pair, day and result) is fitted by Newton steps in one task, a larger one
    by Newton steps over blocks (``spread_history``). Both end when no rating moves by ``precision``, and raise
    when ``steps`` or ``rounds`` don't suffice.
    """
    if w2 <= 0 or precision <= 0 or steps < 1:
        raise ValueError("w2 and precision must be positive, and a step is needed")
    games = played_days(bouts)
    name = lambda c: F.concat_ws("\u0001", "league", c)
    parts = connected_components(games.select(name("a").alias("u"), name("b").alias("v")))
    tagged = games.withColumn("node", name("a")).join(parts, "node").drop("node")
    tagged = staged(tagged, "grouped-games")
    sizes = tagged.groupBy("component").agg(F.count("*").alias("members"))
    tagged = tagged.join(sizes, "component")

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["day", "a", "b", "outcome"])
        fitted = whole_history_fit(list(zip(group["a"], group["b"], group["day"], group["outcome"], group["n"], strict=True)), w2, initial, steps, precision)
        rows_ = [(group["league"].iloc[0], who, day, float(r)) for who, (own, ratings) in fitted.items() for day, r in zip(own, ratings, strict=True)]
        return pd.DataFrame(rows_, columns=["league", "competitor", "day", "rating"])

    small = tagged.where(F.col("members") <= dense).groupBy("component").applyInPandas(solve, CURVE)
    large = tagged.where(F.col("members") > dense)
    return small if large.isEmpty() else small.unionByName(spread_history(large, rounds, precision, w2, initial))


def played_days(bouts: DataFrame) -> DataFrame:
    """(league, a, b, day, outcome, n), stored: one row per pair, day and result, the smaller name first."""
    rows = bouts.where("a <> b and outcome is not null and ts is not null")
    turned = F.col("a") > F.col("b")
    sides = [F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"), F.when(turned, 1 - F.col("outcome")).otherwise(F.col("outcome")).alias("outcome")]
    games = rows.select("league", F.to_date("ts").alias("day"), *sides).groupBy("league", "a", "b", "day", "outcome").agg(F.count("*").alias("n"))
    return staged(games, "games")


def curve_pull(curve: DataFrame, bouts: DataFrame, w2: float = WHR_W2, initial: float = WHR_INITIAL) -> DataFrame:
    """(league, competitor, day, rating, pull): the derivative of the posterior at a curve, zero where the curve is its maximum."""
    ends = [F.struct(F.col(x).alias("competitor"), F.col(y).alias("other"), score.alias("score")) for x, y, score in (("a", "b", F.col("outcome")), ("b", "a", 1 - F.col("outcome")))]
    met = played_days(bouts).select("league", "day", "n", F.explode(F.array(*ends)).alias("s")).select("league", "day", "n", "s.*")
    other = curve.select("league", F.col("competitor").alias("other"), "day", F.col("rating").alias("theirs"))
    both = met.join(curve, ["league", "competitor", "day"]).join(other, ["league", "other", "day"])
    p = 1 / (1 + F.exp(-(F.col("rating") - F.col("theirs")) / WHR_SCALE))
    games = both.groupBy("league", "competitor", "day").agg(F.sum(F.col("n") * (F.col("score") - p) / WHR_SCALE).alias("won"))
    line = Window.partitionBy("league", "competitor").orderBy("day")  # days of one competitor
    beside = lambda f: (f("rating").over(line) - F.col("rating")) / (w2 * F.abs(F.datediff(f("day").over(line), "day")))
    tied = curve.select("*", F.coalesce(beside(F.lead), F.lit(0.0)).alias("up"), F.coalesce(beside(F.lag), (F.lit(initial) - F.col("rating")) / w2).alias("down"))
    return tied.join(games, ["league", "competitor", "day"]).select("league", "competitor", "day", "rating", (F.col("won") + F.col("up") + F.col("down")).alias("pull"))


def spread_history(games: DataFrame, rounds: int = WHR_ROUNDS, precision: float = WHR_PRECISION, w2: float = WHR_W2, initial: float = WHR_INITIAL) -> DataFrame:
    """Curves from (league, a, b, day, outcome, n): Newton steps over all curves, by blocks of competitors."""
    ends = F.explode(F.array(*[F.struct("league", F.col(c).alias("competitor"), "day") for c in ("a", "b")]))
    days = staged(games.select(ends.alias("s")).select("s.*").distinct(), "days")
    chains = with_sequence(days.select("league", "competitor").distinct(), ["league", "competitor"], "chain")
    numbered = staged(with_sequence(days.join(chains, ["league", "competitor"]), ["chain", "day"], "_n"), "numbered-days")
    links = games.select("league", "a", "b", "day", "n", F.col("outcome").alias("score"))
    for c, to in (("a", "id"), ("b", "other")):
        links = links.join(numbered.select("league", F.col("competitor").alias(c), "day", F.col("_n").alias(to)), ["league", c, "day"])
    links = staged(links.select("id", "other", "n", "score"), "history-links")
    nodes = numbered.select(F.col("_n").alias("id"), F.lit("all").alias("grp"), "chain", F.datediff("day", F.lit("1970-01-01").cast("date")).alias("value"))
    made = blocks.settle(blocks.Curves(w2, initial, WHR_SCALE), nodes, links, links.count(), precision, rounds)
    if made is None:
        raise NotSettled(rounds)
    return numbered.join(made.withColumnRenamed("id", "_n"), "_n").select("league", "competitor", "day", F.col("x").alias("rating"))


def rating_at(curve: DataFrame, wanted: DataFrame, initial: float = WHR_INITIAL) -> DataFrame:
    """``wanted`` (league, competitor, day) with the last rating on or before the day.

    Both tables are one sorted stream, in which a rating is carried forward to the rows behind it.
    """
    known = curve.select("league", "competitor", "day", F.lit(0).alias("_asked"), F.col("rating").cast("double").alias("rating"))
    asked = wanted.select("league", "competitor", "day").distinct().select("*", F.lit(1).alias("_asked"), F.lit(None).cast("double").alias("rating"))
    merged = carried_forward(known.unionByName(asked), ["league", "competitor"], ["day", "_asked"], "rating").where("_asked = 1")
    return merged.select("league", "competitor", "day", F.coalesce("rating", F.lit(initial)).alias("rating"))
