"""Glicko and Glicko-2 over rating periods: all bouts of a period count against the ratings before it.

Inside a period nothing depends on order, so a period is a join of its bouts with both
sides' ratings and sums per competitor, in column expressions only; the volatility's
root is a fixed number of steps of such an expression. Only the periods come one after
another. Ratings go from period to period as stored tables of those who ever played.

Deviations grow with the periods since the last one played. A competitor never meets
itself; rows without outcome or time are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutworks.functions.outcomes import strict_outcome
from boutworks.operators.systems import Glicko, Glicko2
from boutworks.runtime import discard, work_path

#: Steps of the bracket and of the root of the volatility.
BRACKET_STEPS, ROOT_STEPS = 200, 40
MOST_DEVIATION = 350.0


def period_of(ts: Column, days: float) -> Column:
    """The number of the tumbling window of ``days`` days, counted from 1970."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(8.64e10 * days)).cast("long")


def _state_columns(system: Glicko | Glicko2) -> dict[str, float]:
    """The state's columns and a newcomer's values: rating and deviation, on the system's own scale, and volatility."""
    if isinstance(system, Glicko2):
        mu, phi, sigma, _ = system.new()
        return {"r": mu, "d": phi, "v": sigma}
    return {"r": system.initial, "d": system.rd}


def _waited(system: Glicko | Glicko2) -> Column:
    """The deviation at the beginning of the period; Glicko-2 adds the period's own growth when it is played."""
    idle = F.col("period") - F.col("last")
    if isinstance(system, Glicko2):
        grown = F.least(F.lit(MOST_DEVIATION / system.scale), F.sqrt(F.col("d") * F.col("d") + (idle - 1) * F.col("v") * F.col("v")))
    else:
        grown = F.least(F.lit(MOST_DEVIATION), F.sqrt(F.col("d") * F.col("d") + system.c**2 * idle))
    return F.when(F.col("last").isNull(), F.col("d")).otherwise(grown)


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _volatility(system: Glicko2) -> Column:
    """The new volatility from d (deviation), v (volatility), var and delta: the Illinois method on Glickman's function."""

    def solved(g: Column) -> Column:
        start = g["a"]

        def f(x: Column) -> Column:
            e = F.exp(x)
            total = g["p2"] + g["var"] + e
            return e * (g["d2"] - total) / (2 * total * total) - (x - start) / system.tau**2

        # the first step down at which f isn't negative any more
        low = F.aggregate(F.sequence(F.lit(1), F.lit(BRACKET_STEPS)), F.lit(0).cast("int"), lambda k, n: F.when((k == 0) & ((f(start - n * system.tau) >= 0) | (n == BRACKET_STEPS)), n).otherwise(k))
        end = F.when(g["d2"] > g["p2"] + g["var"], F.log(g["d2"] - g["p2"] - g["var"])).otherwise(start - low * system.tau)
        state = lambda lo, hi, fl, fh: F.struct(lo.alias("lo"), hi.alias("hi"), fl.alias("fl"), fh.alias("fh"))

        def step(z: Column, _: Column) -> Column:
            def moved(m: Column) -> Column:
                turned = m["f"] * z["fh"] <= 0  # a step that hits the root ends the search too
                return state(F.when(turned, z["hi"]).otherwise(z["lo"]), m["x"], F.when(turned, z["fh"]).otherwise(z["fl"] / 2), m["f"])

            mid = z["lo"] + (z["lo"] - z["hi"]) * z["fl"] / (z["fh"] - z["fl"])
            near = _bound(mid, lambda x: F.struct(x.alias("x"), f(x).alias("f")))
            return F.when(F.abs(z["hi"] - z["lo"]) <= system.epsilon, z).otherwise(_bound(near, moved))

        first = _bound(end, lambda x: state(start, x, f(start), f(x)))
        return F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(ROOT_STEPS)), first, step, lambda z: z["lo"]) / 2)

    known = F.struct(F.log(F.col("v") * F.col("v")).alias("a"), (F.col("d") * F.col("d")).alias("p2"), F.col("var").alias("var"), (F.col("var") * F.col("gain") * F.col("var") * F.col("gain")).alias("d2"))
    return _bound(known, solved)


def _played(system: Glicko | Glicko2, sums: DataFrame) -> DataFrame:
    """The new states from r, d (and v) before the period, info = sum of g^2 E (1 - E) and gain = sum of g (score - E)."""
    if isinstance(system, Glicko):
        total = 1 / (F.col("d") * F.col("d")) + system.q**2 * F.col("info")
        return sums.withColumns({"r": F.greatest(F.lit(system.floor), F.col("r") + system.q / total * F.col("gain")), "d": F.sqrt(1 / total)})
    out = sums.withColumn("var", 1 / F.col("info")).withColumn("v", _volatility(system))
    total = 1 / (F.col("d") * F.col("d") + F.col("v") * F.col("v")) + F.col("info")
    return out.withColumns({"r": F.col("r") + F.col("gain") / total, "d": F.sqrt(1 / total)})


def play_period(states: DataFrame, results: DataFrame, system: Glicko | Glicko2) -> DataFrame:
    """The states (league, competitor, r, d, v, last, games) after ``results`` (league, a, b, n, score, period), all of one period.

    A row holds n bouts of the two and the points of a. The period is a column, so that all periods share the code that
    Spark makes of the expressions.
    """
    new = _state_columns(system)
    ends = [F.struct(F.col(x).alias("competitor"), F.col(y).alias("other"), "n", score.alias("score")) for x, y, score in (("a", "b", F.col("score")), ("b", "a", F.col("n") - F.col("score")))]
    sides = results.select("league", "period", F.explode(F.array(*ends)).alias("s")).select("league", "period", "s.*")
    # results of the same two are one row with counts
    met = sides.groupBy("league", "competitor", "other").agg(F.sum("n").alias("n"), F.sum("score").alias("score"))
    here = sides.groupBy("league", "competitor").agg(F.max("period").alias("period")).join(states, ["league", "competitor"], "left")
    here = here.withColumns({c: F.coalesce(c, F.lit(x)) for c, x in new.items()} | {"games": F.coalesce("games", F.lit(0).cast("long"))}).withColumn("d", _waited(system))
    other = here.select("league", F.col("competitor").alias("other"), F.col("r").alias("_r"), F.col("d").alias("_d"))
    both = met.join(here, ["league", "competitor"]).join(other, ["league", "other"])
    k = system.q if isinstance(system, Glicko) else 1.0
    both = both.withColumn("_g", 1 / F.sqrt(1 + 3 * k**2 * F.col("_d") * F.col("_d") / math.pi**2))
    slope = math.log(10) / 400 if isinstance(system, Glicko) else 1.0
    both = both.withColumn("_e", 1 / (1 + F.exp(-F.col("_g") * (F.col("r") - F.col("_r")) * slope)))
    own = [c for c in here.columns if c not in ("league", "competitor", "games", "last")]
    sums = both.groupBy("league", "competitor", "games", *own).agg(F.sum(F.col("n") * F.col("_g") * F.col("_g") * F.col("_e") * (1 - F.col("_e"))).alias("info"), F.sum(F.col("_g") * (F.col("score") - F.col("n") * F.col("_e"))).alias("gain"), F.sum("n").alias("_played"))
    after = _played(system, sums).select("league", "competitor", *new, F.col("period").alias("last"), (F.col("games") + F.col("_played")).alias("games"))
    return states.join(after.select("league", "competitor"), ["league", "competitor"], "left_anti").unionByName(after)


def empty_states(spark, system: Glicko | Glicko2) -> DataFrame:
    numbers = ", ".join(f"{c} double" for c in _state_columns(system))
    return spark.createDataFrame([], f"league string, competitor string, {numbers}, last long, games long")


def results_of(bouts: DataFrame) -> DataFrame:
    """The bouts that count: league, a, b, n (1), score (of a) and ts."""
    score = strict_outcome(F.col("outcome").cast("double")).alias("score")
    return bouts.where("a <> b and outcome is not null and ts is not null").select("league", "a", "b", F.lit(1).cast("long").alias("n"), score, F.col("ts").cast("timestamp").alias("ts"))


def rate_results(results: DataFrame, system: Glicko | Glicko2, states: DataFrame | None = None, into: str | None = None) -> tuple[DataFrame, list[int]]:
    """The states after all periods of ``results`` (as ``play_period`` takes them), and the periods' numbers.

    ``states`` are those of earlier periods; a result of a period that a competitor has gone beyond is an error. The
    states are written to ``into``, if any period was rated, or to the working folder.
    """
    spark = results.sparkSession
    path = work_path(spark, "periods")
    results.write.partitionBy("period").parquet(path)
    stored = spark.read.schema(results.schema).parquet(path)
    numbers = sorted(r["period"] for r in stored.select("period").distinct().collect())
    now, before = states if states is not None else empty_states(spark, system), None
    if states is not None and numbers:
        late = states.where(F.col("last") >= numbers[0])
        if not late.isEmpty():
            raise ValueError("a period has been rated before")
    for k in numbers:
        after = into if into and k == numbers[-1] else work_path(spark, "rated")
        made = play_period(now, stored.where(F.col("period") == k), system)
        made.write.mode("overwrite").parquet(after)
        now = spark.read.schema(made.schema).parquet(after)
        if before:
            discard(spark, before)
        before = after
    discard(spark, path)
    return now, numbers


def rate_periods(bouts: DataFrame, system: Glicko | Glicko2, days: float = 1.0, states: DataFrame | None = None) -> DataFrame:
    """(league, competitor, rating, spread, games, last) after all periods, and the state's own columns.

    ``states``, as ``play_period`` gives them, are those of earlier periods. A bout of a period that a competitor has gone beyond is an error.
    """
    if days <= 0:
        raise ValueError("a period must be positive")
    rows = results_of(bouts).withColumn("period", period_of(F.col("ts"), days)).drop("ts")
    return displayed(rate_results(rows, system, states)[0], system)


def displayed(states: DataFrame, system: Glicko | Glicko2) -> DataFrame:
    if isinstance(system, Glicko2):
        rating, spread = F.greatest(F.lit(system.floor), F.col("r") * system.scale + 1500), F.least(F.lit(MOST_DEVIATION), F.col("d") * system.scale)
    else:
        rating, spread = F.col("r"), F.col("d")
    return states.select("league", "competitor", rating.alias("rating"), spread.alias("spread"), "games", "last", *_state_columns(system))
