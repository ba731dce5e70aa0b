"""Pairing queries over ratings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutworks.operators.sequence import with_sequence
from boutworks.runtime import staged


def _ranked(ratings: DataFrame) -> DataFrame:
    return with_sequence(ratings, ["league", "rating", "competitor"])


def _by_rating(ratings: DataFrame) -> DataFrame:
    """(league, rating, _first, _second): the ratings that occur, with the first two names that have each."""
    first = ratings.groupBy("league", "rating").agg(F.min("competitor").alias("_first"))
    second = ratings.join(first, ["league", "rating"]).where("competitor <> _first").groupBy("league", "rating").agg(F.min("competitor").alias("_second"))
    return first.join(second, ["league", "rating"], "left")


def _equal() -> Column:
    """The first other name of a competitor's own rating."""
    return F.when(F.col("competitor") == F.col("_first"), F.col("_second")).otherwise(F.col("_first"))


def nearest(ratings: DataFrame, within: float = 100.0) -> DataFrame:
    """Each competitor's closest opponent by rating, at most ``within`` away; of equally close ones the first name.

    The closest one has the same rating or one beside it in the order of those that occur, so no pairs are formed.
    """
    ratings = staged(ratings.select("league", "competitor", "rating").where("rating is not null"), "rated")
    levels = staged(with_sequence(_by_rating(ratings), ["league", "rating"], "_at"), "levels")
    beside = levels.select("league", F.explode(F.array(F.col("_at") - 1, F.col("_at") + 1)).alias("_at"), F.col("rating").alias("_other"), F.col("_first").alias("_name"))
    diff = F.abs(F.col("rating") - F.col("_other"))
    met = levels.join(beside, ["league", "_at"]).withColumn("_diff", diff).where(F.col("_diff") <= within)
    near = met.groupBy("league", "rating").agg(F.min(F.struct(F.col("_diff").alias("diff"), F.col("_name").alias("opponent"))).alias("_near"))
    both = ratings.join(levels.join(near, ["league", "rating"], "left"), ["league", "rating"])
    own = F.abs(F.col("rating") - F.col("rating"))  # no number where the rating is none
    equal = F.when(F.col("_second").isNotNull() & (own <= within), F.struct(own.alias("diff"), _equal().alias("opponent")))
    best = both.select("league", "competitor", F.coalesce(equal, "_near").alias("b")).where("b is not null")
    return best.select("league", "competitor", F.col("b.opponent").alias("opponent"), F.col("b.diff").alias("diff"))


#: Neighbours in the order of ratings that one round of the search looks at, on either side.
SEARCH_STEP = 8


def deviation_quality(ratings: DataFrame, within: float = 100.0, step: int = SEARCH_STEP) -> DataFrame:
    """The opponent of one's league with the least difference after weighing by both rating deviations, at most ``within`` away.

    The search goes outwards in the order of ratings, ``step`` neighbours on either side a round. A competitor is done
    when even the largest deviation of the league couldn't make a farther opponent better, so pairs are not all formed.
    """
    ranked = staged(_ranked(ratings).select("league", "seq", "competitor", "rating", "spread"), "ranked")
    widest = staged(ranked.groupBy("league").agg(F.max("spread").alias("widest")), "widest")
    # of equal ratings the first other name is best, however many there are
    equals = staged(_by_rating(ranked).where("_second is not null"), "equals")
    todo = ranked.join(widest, "league").join(equals, ["league", "rating"], "left").withColumn("opponent", _equal())
    todo = todo.withColumn("quality", F.when(F.col("opponent").isNotNull(), 0.0)).drop("_first", "_second")
    done, reach = None, 0
    weigh = lambda mine, theirs: 1 + F.sqrt(mine * mine + theirs * theirs) / 100
    while True:
        offsets = F.array(*[F.lit(k) for d in range(reach + 1, reach + step + 1) for k in (-d, d)])
        other = ranked.select("league", F.col("seq").alias("_seq"), F.col("competitor").alias("_name"), F.col("rating").alias("_rating"), F.col("spread").alias("_spread"))
        asked = todo.withColumn("_offset", F.explode(offsets)).withColumn("_seq", F.col("seq") + F.col("_offset"))
        met = asked.join(other, ["league", "_seq"], "left")
        diff = F.abs(F.col("rating") - F.col("_rating"))
        score = F.when(diff <= within, F.struct((diff / weigh(F.col("spread"), F.col("_spread"))).alias("q"), F.col("_name").alias("o")))
        # no opponent on a side beyond this round is nearer than the farthest one met there; where a side ends it has none
        side = lambda sign: F.when(F.max(F.when((F.col("_offset") == sign * (reach + step)) & F.col("_rating").isNotNull(), 1)).isNotNull(), F.max(F.when(F.signum("_offset") == sign, diff)))
        keys = ["league", "seq", "competitor", "rating", "spread", "widest", "quality", "opponent"]
        seen = met.groupBy(*keys).agg(F.min(score).alias("b"), F.least(side(-1), side(1)).alias("beyond"))
        better = F.col("b").isNotNull() & (F.col("quality").isNull() | (F.col("b.q") < F.col("quality")) | ((F.col("b.q") == F.col("quality")) & (F.col("b.o") < F.col("opponent"))))
        seen = seen.withColumns({"quality": F.when(better, F.col("b.q")).otherwise(F.col("quality")), "opponent": F.when(better, F.col("b.o")).otherwise(F.col("opponent"))})
        bound = F.col("beyond") / weigh(F.col("spread"), F.col("widest"))
        over = F.col("beyond").isNull() | (F.col("beyond") > within) | F.coalesce((F.col("quality") == 0) | (bound > F.col("quality")), F.lit(False))
        seen = staged(seen.withColumn("over", over), "search")
        out = seen.where("over and opponent is not null").select("league", "competitor", "opponent", "quality")
        done = out if done is None else done.unionByName(out)
        todo = seen.where("not over").select(*keys)
        if todo.isEmpty():
            return done
        reach += step


def closest_pair(ratings: DataFrame) -> DataFrame:
    """The two competitors whose ratings are closest: the next comparison to make."""
    ranked = _ranked(ratings).select("league", "seq", "competitor", "rating")
    after = ranked.select("league", (F.col("seq") - 1).alias("seq"), F.col("competitor").alias("b"), F.col("rating").alias("other"))
    gaps = ranked.join(after, ["league", "seq"]).select("league", F.col("competitor").alias("a"), "b", (F.col("other") - F.col("rating")).alias("gap"))
    best = gaps.groupBy("league").agg(F.min(F.struct("gap", "a", "b")).alias("x"))
    return best.select("league", "x.a", "x.b", "x.gap")


def least_compared(ratings: DataFrame, games: str = "games") -> DataFrame:
    return ratings.orderBy(games, "competitor").limit(2)


def match_teams(teams: DataFrame) -> DataFrame:
    """Teams paired with the next one in the order of their ``mu``, best first, as (a, b, gap); an odd last one stays alone."""
    ranked = with_sequence(teams, [F.desc("mu"), F.col("team")], "_at").select("team", "mu", F.expr("_at div 2").alias("_pair"), (F.col("_at") % 2).alias("_side"))
    pick = lambda c, side: F.max(F.when(F.col("_side") == side, F.col(c)))
    both = ranked.groupBy("_pair").agg(pick("team", 0).alias("a"), pick("team", 1).alias("b"), (pick("mu", 0) - pick("mu", 1)).alias("gap"))
    return both.where("b is not null").select("a", "b", "gap")


def team_strength(ratings: DataFrame, teams: DataFrame) -> DataFrame:
    """Sum of the means and root of the summed variances of (team, competitor) members."""
    rows = teams.join(ratings, "competitor")
    return rows.groupBy("team").agg(F.sum("mu").alias("mu"), F.sqrt(F.sum(F.col("sigma") * F.col("sigma"))).alias("sigma"), F.avg("mu").alias("mean"))


def team_bouts(members: DataFrame, bouts: DataFrame, beta: float = 4.166, tau: float = 0.083) -> DataFrame:
    """(team, competitor, mu, sigma) after each team played at most one decided bout of (winner, loser).

    Skills and uncertainties of a team's members add up; each member moves by its own share of the uncertainty. A team
    in several bouts is an error; teams without a bout keep their values.
    """
    from boutworks.functions.special import normal_cdf

    grown = members.withColumn("v", F.col("sigma") * F.col("sigma") + tau**2)
    sums = grown.groupBy("team").agg(F.sum("mu").alias("m"), F.sum("v").alias("s"), F.count("*").alias("n"))
    side = lambda c, p: sums.select(F.col("team").alias(c), F.col("m").alias(f"m{p}"), F.col("s").alias(f"s{p}"), F.col("n").alias(f"n{p}"))
    met = bouts.select("winner", "loser").join(side("winner", 1), "winner").join(side("loser", 2), "loser")
    c = F.sqrt(beta**2 * (F.col("n1") + F.col("n2")) + F.col("s1") + F.col("s2"))
    met = met.withColumn("c", c).withColumn("t", (F.col("m1") - F.col("m2")) / F.col("c"))
    density = F.exp(-F.col("t") * F.col("t") / 2) / math.sqrt(2 * math.pi)
    met = met.withColumn("shift", density / F.greatest(normal_cdf(F.col("t")), F.lit(1e-300))).withColumn("shrink", F.col("shift") * (F.col("shift") + F.col("t")))
    moves = met.select(F.explode(F.array(F.struct(F.col("winner").alias("team"), F.lit(1.0).alias("sign")), F.struct(F.col("loser").alias("team"), F.lit(-1.0).alias("sign")))).alias("x"), "c", "shift", "shrink").select("x.*", "c", "shift", "shrink")
    once = moves.groupBy("team").agg(F.count("*").alias("k"), *[F.first(x).alias(x) for x in ("sign", "c", "shift", "shrink")])
    twice = F.raise_error(F.concat(F.lit("a team is in several bouts: "), F.col("team").cast("string"))).cast("double")
    out = grown.join(once, "team", "left").withColumn("_ok", F.when(F.col("k") > 1, twice).otherwise(0.0))
    moved = F.col("mu") + F.col("sign") * F.col("v") / F.col("c") * F.col("shift") + F.col("_ok")
    left = F.sqrt(F.col("v") * F.greatest(1 - F.col("v") / (F.col("c") * F.col("c")) * F.col("shrink"), F.lit(0.0)))
    played = F.col("k").isNotNull()
    return out.select("team", "competitor", F.when(played, moved).otherwise(F.col("mu")).alias("mu"), F.when(played, left).otherwise(F.col("sigma")).alias("sigma"))
