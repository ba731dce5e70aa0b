"""Bouts between teams, in order: each player's skill moves by its share of the team's uncertainty.

A bout row has both teams as arrays of competitors, and any number of bouts a team or
player may follow one another. Leagues run side by side; a task holds the skills of one
league's players, never its bouts. With one player a side this is ``replay`` with
``TrueSkill`` to the last bit of its formulas.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from statistics import NormalDist

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutworks.functions.outcomes import strict_outcome
from boutworks.operators.systems import TrueSkill

TEAM_REPLAY = "league string, kind string, seq long, predicted double, outcome double, competitor string, rating double, mu double, sigma double, games long"
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
_NAMES = [f.strip().split()[0] for f in TEAM_REPLAY.split(",")]


def _sums(team: list[list]) -> tuple[float, float]:
    return math.fsum(s[0] for s in team), math.fsum(s[1] ** 2 for s in team)


def expected(system: TrueSkill, a: list[list], b: list[list]) -> float:
    """P(a wins) and half of P(draw), from the states of the players."""
    (ma, va), (mb, vb) = _sums(a), _sums(b)
    spread, margin = math.sqrt((len(a) + len(b)) * system.beta**2 + va + vb), margin_of(system, len(a) + len(b))
    win, not_loss = system._cdf((ma - mb - margin) / spread), system._cdf((ma - mb + margin) / spread)
    return win + (not_loss - win) / 2


def margin_of(system: TrueSkill, players: int) -> float:
    return math.sqrt(players) * system.beta * NormalDist().inv_cdf((system.draw_probability + 1) / 2)


def play(system: TrueSkill, a: list[list], b: list[list], score: float) -> None:
    """Update the players' states [mu, sigma] after one bout."""
    if score == 0.0:
        return play(system, b, a, 1.0)
    grown = [[s[1] ** 2 + system.tau**2 for s in team] for team in (a, b)]
    spread = math.sqrt((len(a) + len(b)) * system.beta**2 + math.fsum(grown[0]) + math.fsum(grown[1]))
    apart, margin = _sums(a)[0] - _sums(b)[0], margin_of(system, len(a) + len(b))
    if score == 1.0:
        t = (apart - margin) / spread
        below = system._cdf(t)
        shift = system._pdf(t) / below if below > 0 else 0.0
        shrink = shift * (shift + t)
    else:
        t, e = apart / spread, margin / spread
        width = system._cdf(t + e) - system._cdf(t - e)
        low, high = system._pdf(t - e), system._pdf(t + e)
        v = (low - high) / width if width > 0 else 0.0
        shrink = v * v + ((e - t) * low + (e + t) * high) / width if width > 0 else 0.0
        shift = -v if width > 0 else 0.0
    for team, own, sign in ((a, grown[0], 1), (b, grown[1], -1)):
        for s, v in zip(team, own, strict=True):
            s[0] += sign * v / spread * shift
            s[1] = math.sqrt(v * (1 - v / spread**2 * shrink))


def replay_teams(bouts: DataFrame, system: TrueSkill) -> DataFrame:
    """Rows of kind ``bout`` (prediction and outcome) and ``state`` (each player's last skill) from (league, seq, team_a, team_b, outcome).

    Bouts without an outcome, with an empty team, or with a player on both sides or twice in a team are left out.
    """
    both = F.concat("team_a", "team_b")
    fair = (F.size("team_a") > 0) & (F.size("team_b") > 0) & (F.size(F.array_distinct(both)) == F.size(both)) & ~F.exists(both, lambda x: x.isNull())
    rows = bouts.where(fair & F.col("outcome").isNotNull()).select("league", F.col("seq").cast("long").alias("seq"), "team_a", "team_b", strict_outcome(F.col("outcome").cast("double")).alias("outcome"))

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)], names=_NAMES)

    def final(league: str, known: dict) -> Iterator[pa.RecordBatch]:
        out = [(league, "state", None, None, None, who, system.rating(s), s[0], s[1], n) for who, (s, n) in known.items()]
        for i in range(0, len(out), 10_000):
            yield batch_of(out[i : i + 10_000])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        for batch in batches:
            out = []
            for league, seq, team_a, team_b, outcome in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if league != now:
                    if out:
                        yield batch_of(out)
                        out = []
                    if known:
                        yield from final(now, known)
                    now, known = league, {}
                entries = [[known.setdefault(who, [system.new(), 0]) for who in team] for team in (team_a, team_b)]
                a, b = ([x[0] for x in team] for team in entries)
                out.append((league, "bout", seq, expected(system, a, b), outcome, None, None, None, None, None))
                play(system, a, b, outcome)
                for x in (*entries[0], *entries[1]):
                    x[1] += 1
            if out:
                yield batch_of(out)
        if known:
            yield from final(now, known)

    return rows.repartition("league").sortWithinPartitions("league", "seq").mapInArrow(run, TEAM_REPLAY)
