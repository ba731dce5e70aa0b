"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boutworks.functions import expected as E
from boutworks.functions import outcomes
from boutworks.operators import evaluation, fits, levels, matchmaking, models, periods, prequential, records, reports, splits, state, systems, teams
from boutworks.operators.fold import leaderboard, history_of, predict, quarantine, ratings_of, replay, replay_blocks, split_groups
from boutworks.operators.sequence import segmented_sums, with_sequence
from boutworks.plans import oracle
from boutworks.runtime import read_table, staged, work_path
from boutworks.sources import kept, pgn, schedule, synthetic
from boutworks.sources.fixtures import bouts_events, bouts_supplier, bouts_teams
from boutworks.streaming import queries as streams

Query = Callable[[SparkSession, str], DataFrame]


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _board(system, timed: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rated = ratings_of(replay(bouts_events(spark, sf_dir), system, timed=timed))
        return leaderboard(rated.select("competitor", F.round("rating", 6).alias("rating")))

    return run


def elo_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(history_of(replay(bouts_events(spark, sf_dir), systems.Elo())), 9, "predicted").drop("league")


def elo_by_league(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five leagues replayed side by side."""
    bouts = with_sequence(bouts_supplier(spark, sf_dir), ["ts", "order_key", "a", "b"])
    return _rounded(ratings_of(replay(bouts, systems.Elo())), 6, "rating").select("league", "competitor", "rating", "games")


def elo_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected groups replayed side by side give the same ratings."""
    rated = ratings_of(replay(split_groups(bouts_events(spark, sf_dir)), systems.Elo()))
    return rated.select("competitor", F.round("rating", 6).alias("rating"))


def elo_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One league replayed in blocks of time, the groups of a block side by side."""
    bouts = bouts_events(spark, sf_dir)
    n = max(1, bouts.count())
    rated = ratings_of(replay_blocks(bouts, systems.Elo(), -(-n // 4)))
    return rated.select("competitor", F.round("rating", 6).alias("rating"))


def elo_by_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bouts that wait for nobody played side by side, as long as a fifth of the competitors have one."""
    bouts = staged(bouts_events(spark, sf_dir), "bouts")
    competitors = bouts.select(F.explode(F.array("a", "b")).alias("who")).distinct().count()
    _, rated = levels.replay_levels(bouts, systems.Elo(), max(1, bouts.count()), max(1, competitors // 5))
    return rated.select("competitor", F.round("rating", 6).alias("rating"))


def _periods(system) -> Query:
    """Periods of five days, in which a competitor has some twenty bouts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rated = periods.rate_periods(bouts_events(spark, sf_dir), system, 5.0)
        return _rounded(rated.select("competitor", "rating", "spread", "games", "last"), 6, "rating", "spread")

    return run


def pair_state_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored pair table with the later bouts added gives the fit of all bouts."""
    bouts = staged(records.unit_scores(bouts_events(spark, sf_dir)), "bouts")
    half = bouts.agg((F.max("seq") / 2).cast("long")).first()[0] or 0
    stored = staged(records.pairs(bouts.where(F.col("seq") < half)), "pair-state")
    fitted = fits.fit_pairs(fits.add_pairs(stored, bouts.where(F.col("seq") >= half)), "colley")
    return fitted.select("competitor", F.round("rating", 9).alias("rating"))


def scores_from_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores taken from a map of attributes: both, or none where one is missing or not finite."""
    held = F.map_filter(
        F.create_map(
            F.lit("home"), F.when(F.col("seq") % 11 == 0, float("nan")).otherwise(F.when(F.col("seq") % 5 != 0, F.col("score_a"))),
            F.lit("away"), F.when(F.col("seq") % 7 == 0, float("inf")).otherwise(F.col("score_b")),
        ),
        lambda k, v: v.isNotNull(),
    )
    a, b = outcomes.scores_of(F.col("attributes"), "home", "away")
    return bouts_events(spark, sf_dir).select("seq", held.alias("attributes")).select("seq", F.round(a, 6).alias("score_a"), F.round(b, 6).alias("score_b"))


def outcome_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes besides 1, 0.5, 0 and null are parted off."""
    k = F.col("seq") % 9
    odd = F.when(k == 0, 0.7).when(k == 1, None).when(k == 2, -1.0).otherwise(F.col("outcome"))
    kept, others = quarantine(bouts_events(spark, sf_dir).select("seq", odd.alias("outcome")))
    return kept.select("seq", F.lit(True).alias("kept")).unionByName(others.select("seq", F.lit(False).alias("kept")))


def outcome_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes by a user's comparison: half as much again wins, less is a draw."""
    won = F.when(F.col("score_a") > F.col("score_b") * 1.5, True).when(F.col("score_b") > F.col("score_a") * 1.5, False)
    return bouts_events(spark, sf_dir).select("seq", "a", "b", outcomes.outcome_of(won).alias("outcome"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history whose predictions are the same doubles in every engine."""
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    p = (F.pmod(a * 37 + b * 91 + F.col("seq") * 13, F.lit(1000)) + 0.5) / 1000.0
    return bouts_events(spark, sf_dir).select("seq", "a", "b", p.alias("predicted"), outcomes.label_of_number(F.col("outcome")).alias("label"))


def _of_history(f: Callable[[DataFrame], DataFrame], digits: int = 9) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f(_history(spark, sf_dir))
        return out.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])

    return run


def records_wlt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.records(bouts_events(spark, sf_dir))


def supplier_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.records(bouts_supplier(spark, sf_dir))


def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(records.pairs(bouts_events(spark, sf_dir)), 4, "margin", "points").drop("league")


def points_for_against(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(records.points(bouts_events(spark, sf_dir)), 4, "pts_for", "pts_against", "margin").drop("league")


def unit_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.points(records.unit_scores(bouts_events(spark, sf_dir))).select("competitor", "margin")


def pythagorean_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(records.pythagorean(bouts_events(spark, sf_dir)), 9, "rating").drop("league")


def pythagorean_log5(spark: SparkSession, sf_dir: str) -> DataFrame:
    bouts = bouts_events(spark, sf_dir)
    out = predict(bouts, records.pythagorean(bouts), E.log5, 0.5)
    return out.select("seq", F.round("predicted", 9).alias("expected"))


def _fit(system: str, digits: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fitted = fits.fit(records.unit_scores(bouts_events(spark, sf_dir)), system)
        return fitted.select("competitor", F.round("rating", digits).alias("rating"))

    return run


def _fit_history(model, digits: int = 7) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(prequential.fit_history(bouts_events(spark, sf_dir), model), digits, "predicted").drop("league")

    return run


def pythagorean_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(prequential.pythagorean_history(bouts_events(spark, sf_dir)), 9, "predicted").drop("league")


def whr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fits.whole_history(bouts_events(spark, sf_dir)), 6, "rating")


def whr_optimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of each competitor's curve, and whether the posterior has its maximum there."""
    bouts = bouts_events(spark, sf_dir)
    pulls = fits.curve_pull(staged(fits.whole_history(bouts), "curve"), bouts)
    return pulls.groupBy("competitor").agg(F.count("*").alias("days"), (F.max(F.abs("pull")) < 1e-7).alias("settled"))


def whr_rating_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted curves read off at the day before and the day of each bout of the first side."""
    bouts = staged(bouts_events(spark, sf_dir), "bouts")
    wanted = bouts.select("league", F.col("a").alias("competitor"), F.explode(F.array(F.date_sub(F.to_date("ts"), 1), F.to_date("ts"))).alias("day"))
    return _rounded(fits.rating_at(fits.whole_history(bouts), wanted), 6, "rating").drop("league")


def benchmark_whole_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(["system", *_COUNTS, *_SHARES, "accuracy_opt"], models.WholeHistory())(spark, sf_dir)


def _rated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bouts, and ratings that are the same doubles in every engine."""
    bouts = staged(bouts_events(spark, sf_dir), "bouts")
    games = records.records(bouts).select("competitor", "games")
    rated = records.pythagorean(bouts).join(games, "competitor")
    return bouts, rated.select("league", "competitor", F.round(F.col("rating") * 1000, 3).alias("rating"), (30.0 + F.col("games")).alias("spread"), "games")


def _grid(f: Callable[[Column, Column, Column, Column], dict[str, Column]]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bouts, rated = _rated(spark, sf_dir)
        side = lambda c: rated.select(F.col("competitor").alias(c), F.col("rating").alias(f"r{c}"), F.col("spread").alias(f"d{c}"))
        rows = bouts.select("seq", "a", "b").join(side("a"), "a").join(side("b"), "b")
        made = f(F.col("ra"), F.col("rb"), F.col("da"), F.col("db"))
        return rows.select("seq", *[F.round(v, 6 if k == "rating_sum" else 9).alias(k) for k, v in made.items()])

    return run


def _all_expected(ra: Column, rb: Column, da: Column, db: Column) -> dict[str, Column]:
    a, b = ra / 10, rb / 10
    return {
        "elo": E.elo(a, b), "ecf": E.ecf(a, b), "glicko": E.glicko(a, b, db), "glicko2": E.glicko2(a / 100, b / 100, db / 100),
        "colley": E.colley(a / 100, b / 100), "massey": E.massey(a, b, F.lit(25.0)), "keener": E.keener(a, b),
        "bradley_terry": E.bradley_terry(a / 100, b / 100), "whole_history": E.whole_history(a, b),
    }


def _two_members(ra: Column, rb: Column, da: Column, db: Column) -> dict[str, Column]:
    mean = (E.elo(ra, rb) + E.colley(ra / 1000, rb / 1000)) / 2
    return {"expected": mean, "rating_sum": ra + ra / 1000 + rb + rb / 1000}


def trueskill_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c, k, low: (low + F.col(c).cast("long") % k).cast("double")
    args = [part("a", 11, 20), part("a", 5, 4), part("b", 11, 20), part("b", 5, 4)]
    return bouts_events(spark, sf_dir).select("seq", F.round(E.trueskill(*args), 9).alias("expected"), F.round(E.trueskill_quality(*args), 9).alias("quality"))


def matchmaking_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matchmaking.nearest(_rated(spark, sf_dir)[1]), 6, "diff").drop("league")


def matchmaking_rd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matchmaking.deviation_quality(_rated(spark, sf_dir)[1]), 6, "quality").drop("league")


def least_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matchmaking.least_compared(_rated(spark, sf_dir)[1]).select("competitor", "games")


def team_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = _rated(spark, sf_dir)[1]
    sides = rated.groupBy((F.col("competitor").cast("long") % 10).alias("team")).agg(F.round(F.sum("rating"), 4).alias("mu"))
    return _rounded(matchmaking.match_teams(sides), 4, "gap")


def team_bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teams of even number beat the next ones."""
    who = bouts_events(spark, sf_dir).select(F.explode(F.array("a", "b")).alias("competitor")).distinct()
    k = F.col("competitor").cast("long")
    members = who.select("competitor", (k % 10).alias("team"), (20 + k % 11).cast("double").alias("mu"), (4 + k % 5).cast("double").alias("sigma"))
    bouts = spark.range(0, 10, 2).select(F.col("id").alias("winner"), (F.col("id") + 1).alias("loser"))
    return _rounded(matchmaking.team_bouts(members, bouts), 6, "mu", "sigma")


def team_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers of an order at odd and at even places as two teams, order after order."""
    played = teams.replay_teams(with_sequence(bouts_teams(spark, sf_dir), ["ts", "order_key"]), systems.TrueSkill())
    return _rounded(played.where("kind = 'state'").select("league", "competitor", "mu", "sigma", "games"), 6, "mu", "sigma")


def closest_pair_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matchmaking.closest_pair(_rated(spark, sf_dir)[1]), 6, "gap").drop("league")


def team_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = _rated(spark, sf_dir)[1].select("competitor", F.col("rating").alias("mu"), F.col("spread").alias("sigma"))
    members = rated.select("competitor", (F.col("competitor").cast("long") % 10).alias("team"))
    return _rounded(matchmaking.team_strength(rated, members), 4, "mu", "sigma", "mean")


def leaderboard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = leaderboard(_rated(spark, sf_dir)[1], 10)
    return with_sequence(top.select("competitor", "rating"), [F.desc("rating"), F.col("competitor")], "at").select("competitor", "rating", (F.col("at") + 1).alias("place"))


def min_games_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = _rated(spark, sf_dir)[1]
    return rated.crossJoin(F.broadcast(rated.agg(F.avg("games").alias("mean")))).where("games >= mean").select("competitor", "rating", "games")


def rating_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    bouts, rated = _rated(spark, sf_dir)
    both = bouts.select("league", F.to_date("ts").alias("day"), F.explode(F.array(F.struct(F.col("a").alias("who"), F.col("score_a").alias("s")), F.struct(F.col("b").alias("who"), F.col("score_b").alias("s")))).alias("x"))
    curve = both.groupBy("league", F.col("x.who").alias("competitor"), "day").agg(F.max(F.round("x.s", 3)).alias("rating"))
    wanted = rated.select("league", "competitor", F.explode(F.array(F.lit("2024-01-10").cast("date"), F.lit("2023-12-31").cast("date"))).alias("day"))
    return fits.rating_at(curve, wanted).drop("league")


def bout_counts_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bouts_events(spark, sf_dir).select("seq", F.explode(F.array("a", "b")).alias("who"), F.lit(1).cast("long").alias("earlier"))
    return segmented_sums(both, ["who"], ["seq"], ["earlier"], current=False)


def time_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.time_split(bouts_events(spark, sf_dir), 0.3).groupBy("split").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))


def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.random_split(bouts_events(spark, sf_dir), 0.3, 7).select("seq", "split")


def competitor_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.competitor_split(bouts_events(spark, sf_dir), 0.2, 7).select("seq", "split")


def outcome_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array(*[F.lit(x) for x in ("WIN", "Loss", "tie", "yes", "No", "0.5", "1", "0", "unknown", "T", "f", "eq", "draw")])
    return read_table(spark, sf_dir, "events").select("event_id", outcomes.label_of_text(F.element_at(said, (F.col("event_id") % 13 + 1).cast("int"))).alias("label"))


def scores_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bouts_events(spark, sf_dir).select("seq", outcomes.scores_agree(F.col("score_a"), F.col("score_b"), F.col("outcome")).alias("ok"))


def _evaluated(columns: list[str], *chosen) -> Query:
    """Systems trained on the earlier bouts and judged on the later ones, best first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = evaluation.evaluate(bouts_events(spark, sf_dir), chosen).metrics
        digits = [c for c in ("accuracy", "precision", "recall", "f1", "accuracy_opt", "optimized_accuracy") if c in columns]
        return _rounded(out, 9, *digits).orderBy(F.desc("accuracy"), "system").select(*columns)

    return run


def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five and the cohorts of one evaluation."""
    one = evaluation.evaluate(bouts_events(spark, sf_dir), systems.Elo())
    none = F.lit(0).cast("long")
    best = one.top.select(F.lit("top").alias("kind"), F.col("place").cast("long").alias("at"), "competitor", none.alias("correct"), none.alias("total"))
    return best.unionByName(one.cohorts.select(F.lit("cohort").alias("kind"), F.col("bin").alias("at"), F.lit("").alias("competitor"), "correct", "total"))


def state_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half replayed, exported, imported and continued equals one replay."""
    bouts = staged(bouts_events(spark, sf_dir), "bouts")
    half = bouts.agg((F.max("seq") / 2).cast("long")).first()[0]
    system = systems.Elo()
    first = ratings_of(replay(bouts.where(F.col("seq") < half), system))
    seeds = state.import_state(staged(state.export_state(first, system), "state"), system)
    return ratings_of(replay(bouts.where(F.col("seq") >= half), system, seeds=seeds)).select("competitor", F.round("rating", 6).alias("rating"))


def state_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported states, two thirds of them damaged in one way or another, parted into those that can be used and the others."""
    system = systems.Elo()
    stored = state.export_state(ratings_of(replay(bouts_events(spark, sf_dir), system)), system)
    k, doc = F.col("competitor").cast("long") % 6, F.col("document")
    damaged = F.when(k == 1, F.regexp_replace(doc, '"elo"', '"glicko"')).when(k == 2, F.regexp_replace(doc, '"version": 1', '"version": 9')).when(k == 3, F.regexp_replace(doc, r"\[.*\]", "[]")).when(k == 4, F.substring(doc, 2, 20)).otherwise(doc)
    good, bad = state.part_states(staged(stored.withColumn("document", damaged), "states"), system)
    none = lambda kind: F.lit(None).cast(kind)
    return good.select("competitor", F.round("rating", 6).alias("rating"), none("string").alias("reason")).unionByName(bad.select("competitor", none("double").alias("rating"), "reason"))


def older_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat documents of an earlier version, made of suppliers, read as the states of both sides of their bouts."""
    system, key = systems.Glicko(), F.col("s_suppkey")
    suppliers = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    rating = F.lit(1500.0) + F.floor(F.col("s_acctbal") / 100)
    fields = F.struct(F.when(key % 3 > 0, rating).alias("current_rating"), F.when(key % 4 > 0, rating + 50).alias("initial_rating"), F.when(key % 5 > 0, 60.0 + key % 7).alias("current_rd"))
    documents = suppliers.select(F.lit("all").alias("league"), key.cast("string").alias("competitor"), F.to_json(fields).alias("document"))
    seeds = state.import_state(documents, system)
    bouts = bouts_supplier(spark, sf_dir).withColumn("league", F.lit("all"))
    fixtures = bouts.select("league", "order_key", "a", "b")
    of = lambda side: seeds.select("league", F.col("competitor").alias(side), F.from_json("state", "array<double>").alias(f"_{side}"))
    both = fixtures.join(of("a"), ["league", "a"]).join(of("b"), ["league", "b"])
    number = lambda side, i: F.get(f"_{side}", F.lit(i))
    return both.select("order_key", "a", "b", number("a", 0).alias("rating_a"), number("a", 1).alias("rd_a"), number("b", 0).alias("rating_b"), number("b", 1).alias("rd_b"))


def strict_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = _history(spark, sf_dir)
    outcome = F.when(F.col("label") == "a", 1.0).when(F.col("label") == "b", 0.0).otherwise(0.5)
    said = history.withColumns({"outcome": outcome, "predicted": F.col("predicted").cast("string")})
    return reports.strict_flags(reports.text_predictions(said))


def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.round_robin(records.records(bouts_events(spark, sf_dir)).select("league", "competitor")).select("a", "b")


def skipped_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the later bouts those with a side that the earlier ones don't know."""
    split = staged(splits.time_split(bouts_events(spark, sf_dir), 0.3), "split")
    rated = ratings_of(replay(split.where("split = 'train'"), systems.Elo()))
    return reports.skipped_fixtures(split.where("split = 'test'"), rated).select("seq")


def weighted_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.element_at(F.array(*[F.lit(w) for w in (2.0, 1.5, 1.0, 1.0, 0.8)]), (F.col("seq") % 5 + 1).cast("int"))
    return reports.weighted_votes(bouts_events(spark, sf_dir).select("seq", "a"), weight, 3)


def multi_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = records.sides(bouts_events(spark, sf_dir)).groupBy(F.col("who").alias("competitor")).agg(F.round(F.avg("pts_for"), 6).alias("points"), F.round(F.avg("score"), 6).alias("wins"), F.lit(1.0).alias("other"))
    long = sides.unpivot(["competitor"], ["points", "wins", "other"], "criterion", "rating")
    return _rounded(reports.multi_criteria(long, {"points": 0.25, "wins": 3.0}), 4, "rating")


def explore_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = staged(_rated(spark, sf_dir)[1], "rated")
    return reports.explore(rated, matchmaking.nearest(rated), 100.0, 0.2, 5).drop("league")


def _second(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def pgn_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bouts written as game texts, in files of both line ends, and parsed back."""
    k, header = F.col("seq"), lambda name, value: F.concat(F.lit(f'[{name} "'), value, F.lit('"]\n'))
    result = F.when(k % 10 == 0, "*").when(F.col("outcome") == 1, "1-0").when(F.col("outcome") == 0, "0-1").otherwise("1/2-1/2")
    date = F.when(k % 11 == 0, "????.??.??").when(k % 7 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy.MM.dd"))
    elo = F.when(k % 3 == 0, "").otherwise(header("WhiteElo", (1400 + k % 300).cast("string")))
    text = F.concat(
        header("Event", F.lit("Rated game")), header("Site", F.concat(F.lit("https://games.example/"), k.cast("string"))), header("White", F.concat(F.lit("p"), "a")), header("Black", F.concat(F.lit("p"), "b")),
        header("Result", result), header("UTCDate", date), header("UTCTime", F.date_format("ts", "HH:mm:ss")), elo, F.lit("\n1. e4 { [%clk 0:05] } e5 "), result, F.lit("\n"),
    )
    path = work_path(spark, "pgn")
    games_ = bouts_events(spark, sf_dir).select("seq", text.alias("value"))
    games_.where(k % 2 == 0).select("value").write.text(path)
    games_.where(k % 2 == 1).select(F.regexp_replace("value", "\n", "\r\n").alias("value")).write.mode("append").option("lineSep", "\r\n").text(path)
    parsed = pgn.games(pgn.read_pgn(spark, path))
    return parsed.select("a", "b", "outcome", _second("ts"), F.col("attributes")["game_id"].alias("game_id"), F.col("attributes")["white_elo"].alias("white_elo"))


def schedule_bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bouts written as two seasons of a schedule, whose columns differ, and read back."""
    rows = bouts_events(spark, sf_dir)
    columns = [
        F.date_format("ts", "yyyy-MM-dd").alias("date"), F.concat(F.lit("t"), "a").alias("home_name"), F.concat(F.lit("t"), "b").alias("away_name"),
        F.floor("score_a").cast("long").alias("home_score"), F.floor("score_b").cast("long").alias("away_score"), F.when(F.col("seq") % 9 == 0, "false").otherwise("true").alias("status_type_completed"),
    ]
    more = [F.concat(F.lit("Team "), "a").alias("home_display_name"), F.concat(F.lit("Hall "), (F.col("seq") % 5).cast("string")).alias("venue")]
    paths = {2023: work_path(spark, "season"), 2024: work_path(spark, "season")}
    rows.where("seq % 2 = 0").select(*columns, *more).write.option("header", True).csv(paths[2023])
    rows.where("seq % 2 = 1").select(*columns).write.option("header", True).csv(paths[2024])
    games_, _ = schedule.read_seasons(spark, paths)
    read = schedule.bouts(games_)
    return read.select("a", "b", "outcome", _second("ts"), "score_a", "score_b", F.col("attributes")["venue"].alias("venue"))


def kept_bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bouts that are made once, kept, and read from where they are kept."""
    root, made = work_path(spark, "kept"), [bouts_events(spark, sf_dir)]
    for _ in range(2):  # there is nothing to make the second time
        table = kept.kept(spark, root, "bouts", ("events", 1), made.pop)
    return table.select("seq", "a", "b", "outcome", _second("ts"))


def unseen_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later bouts, some of them against newcomers, predicted by ratings of the earlier ones."""
    split = staged(splits.time_split(bouts_events(spark, sf_dir), 0.3), "split")
    rated = ratings_of(replay(split.where("split = 'train'"), systems.Elo()))
    fixtures = split.where("split = 'test'").withColumn("b", F.when(F.col("seq") % 10 == 0, F.concat(F.lit("new "), "b")).otherwise(F.col("b")))
    return _rounded(predict(fixtures, rated, E.elo, systems.Elo().initial).select("seq", "a", "b", "predicted"), 9, "predicted")


def elo_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of a stream in four runs, each from the checkpoint of the one before, and the bouts that came too late."""
    bouts = staged(bouts_events(spark, sf_dir), "bouts")
    n = (bouts.agg(F.max("seq")).first()[0] or 0) + 1
    block = F.least(F.lit(3), F.expr(f"seq * 4 div {n}"))
    block = F.when((F.col("seq") % 97 == 0) & (block < 3), block + 1).otherwise(block)
    played = streams.played_in_blocks(bouts, systems.Elo(), [block == k for k in range(4)])
    late = played.where("kind = 'late'").select(F.lit("late").alias("kind"), F.col("seq").cast("string").alias("name"), F.lit(None).cast("double").alias("rating"))
    rated = streams.last_ratings(played).select(F.lit("rating").alias("kind"), F.col("competitor").alias("name"), F.round("rating", 6).alias("rating"))
    return rated.unionByName(late)


def points_by_day_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rounded(streams.points_stream(bouts_events(spark, sf_dir)), 4, "pts_for", "pts_against")
    return rows.select("competitor", _second("window_start"), "pts_for", "pts_against")


def _period_stream(system) -> Query:
    """Periods of five days of a stream in three runs; those count that the watermark has closed."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bouts = staged(bouts_events(spark, sf_dir), "bouts")
        n = (bouts.agg(F.max("seq")).first()[0] or 0) + 1
        rated = streams.periods_in_blocks(bouts, system, 5.0, "1 day", [F.expr(f"seq * 3 div {n}") == k for k in range(3)])
        return _rounded(rated.select("competitor", "rating", "spread", "games", "last"), 6, "rating", "spread")

    return run


def synthetic_bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.bouts(spark, 2000, 50).select("seq", "a", "b", "outcome", F.round("skill_diff", 6).alias("skill_diff"))


_EVERY = (systems.Elo(), systems.Glicko(), systems.Glicko2(), systems.TrueSkill(), systems.Ecf(), systems.Dwz(), systems.Ensemble())
_FITTED = (models.Pythagorean(), models.Colley(), models.Massey(), models.Keener(), models.BradleyTerry())
_COUNTS, _SHARES = ["n", "tp", "fp", "tn", "fn"], ["accuracy", "precision", "recall", "f1"]

_TABLE: dict[str, tuple[Query, str | None]] = {
    "elo_leaderboard": (_board(systems.Elo()), oracle.ELO),
    "elo_history": (elo_history, oracle.ELO_HISTORY),
    "elo_by_group": (elo_by_group, oracle.ELO),
    "elo_by_league": (elo_by_league, oracle.ELO_BY_LEAGUE),
    "elo_in_blocks": (elo_in_blocks, oracle.ELO),
    "elo_by_levels": (elo_by_levels, oracle.ELO),
    "pair_state_fit": (pair_state_fit, oracle.COLLEY),
    "scores_from_attributes": (scores_from_attributes, oracle.SCORES_FROM),
    "outcome_quarantine": (outcome_quarantine, oracle.QUARANTINE),
    "outcome_comparison": (outcome_comparison, oracle.COMPARED),
    "least_compared": (least_compared, oracle.LEAST_COMPARED),
    "team_matches": (team_matches, oracle.TEAM_MATCHES),
    "team_bouts": (team_bouts, oracle.TEAM_BOUTS),
    "evaluation_report": (evaluation_report, oracle.EVALUATION_REPORT),
    "state_round_trip": (state_round_trip, oracle.ELO),
    "state_quarantine": (state_quarantine, oracle.STATE_QUARANTINE),
    "older_states": (older_states, oracle.OLDER_STATES),
    "glicko_leaderboard": (_board(systems.Glicko(), timed=True), oracle.GLICKO),
    "glicko2_leaderboard": (_board(systems.Glicko2(), timed=True), oracle.GLICKO2),
    "trueskill_leaderboard": (_board(systems.TrueSkill()), oracle.TRUESKILL),
    "ecf_leaderboard": (_board(systems.Ecf()), oracle.ECF),
    "dwz_leaderboard": (_board(systems.Dwz()), oracle.DWZ),
    "ensemble_leaderboard": (_board(systems.Ensemble()), oracle.ENSEMBLE),
    "pythagorean_history": (pythagorean_history, oracle.PYTHAGOREAN_HISTORY),
    "colley_history": (_fit_history(models.Colley()), oracle.COLLEY_HISTORY),
    "massey_history": (_fit_history(models.Massey()), None),
    "keener_history": (_fit_history(models.Keener(), 6), None),
    "bradley_terry_history": (_fit_history(models.BradleyTerry()), None),
    "glicko_periods": (_periods(systems.Glicko()), oracle.GLICKO_PERIODS),
    "glicko2_periods": (_periods(systems.Glicko2()), oracle.GLICKO2_PERIODS),
    "colley_ratings": (_fit("colley", 9), oracle.COLLEY),
    "massey_ratings": (_fit("massey", 9), oracle.MASSEY),
    "keener_ratings": (_fit("keener", 6), oracle.KEENER),
    "bradley_terry_ratings": (_fit("bradley_terry", 7), oracle.BRADLEY_TERRY),
    "whr_curve": (whr_curve, None),
    "whr_optimum": (whr_optimum, oracle.WHR_OPTIMUM),
    "whr_rating_at": (whr_rating_at, None),
    "benchmark_whole_history": (benchmark_whole_history, None),
    "records_wlt": (records_wlt, f"WITH {oracle.BOUTS}, {oracle.SIDES} {oracle.RECORDS}"),
    "supplier_records": (supplier_records, f"WITH {oracle.SUPPLIER}, {oracle.SIDES} {oracle.RECORDS}"),
    "head_to_head": (head_to_head, f"WITH {oracle.BOUTS}, {oracle.SIDES} {oracle.HEAD_TO_HEAD}"),
    "points_for_against": (points_for_against, f"WITH {oracle.BOUTS}, {oracle.SIDES} {oracle.POINTS}"),
    "unit_margins": (unit_margins, f"WITH {oracle.BOUTS}, {oracle.SIDES} SELECT who AS competitor, sum(pf - pa) AS margin FROM unit GROUP BY who"),
    "pythagorean_ratings": (pythagorean_ratings, f"WITH {oracle.BOUTS}, {oracle.SIDES}, {oracle.PYTHAGOREAN_CTE} SELECT competitor, round(rating, 9) AS rating FROM r"),
    "pythagorean_log5": (pythagorean_log5, oracle.LOG5),
    "expected_grid": (_grid(_all_expected), oracle.EXPECTED_GRID),
    "ensemble_mean": (_grid(_two_members), oracle.ENSEMBLE_MEAN),
    "trueskill_expected": (trueskill_expected, oracle.trueskill(E.trueskill_margin())),
    "confusion_matrix": (_of_history(evaluation.confusion), oracle.confusion(0.45, 0.55)),
    "metrics_default": (_of_history(evaluation.metrics), oracle.METRICS),
    "metrics_with_draws": (_of_history(evaluation.metrics_with_draws), oracle.METRICS_DRAWS),
    "report_results": (_of_history(lambda h: evaluation.report(h, 0.4, 0.6), 6), oracle.REPORT),
    "calibration_bins": (_of_history(evaluation.calibration_bins, 6), oracle.CALIBRATION),
    "prediction_density": (_of_history(evaluation.density), oracle.DENSITY),
    "log_loss_brier": (_of_history(evaluation.losses), oracle.LOSSES),
    "prediction_summary": (_of_history(evaluation.summary), oracle.SUMMARY),
    "cohort_accuracy": (_of_history(evaluation.cohorts), oracle.COHORTS),
    "threshold_sweep": (_of_history(lambda h: evaluation.best_cuts(h).drop("near")), oracle.SWEEP),
    "random_search": (_of_history(evaluation.random_search), oracle.RANDOM_SEARCH),
    "evaluate_elo": (_evaluated(_COUNTS + _SHARES, systems.Elo()), oracle.EVALUATE),
    "benchmark_systems": (_evaluated(["system", *_COUNTS, *_SHARES, "accuracy_opt"], *_EVERY, *_FITTED), oracle.BENCHMARK),
    "time_split_counts": (time_split_counts, oracle.TIME_SPLIT),
    "random_split": (random_split, oracle.RANDOM_SPLIT),
    "competitor_split": (competitor_split, oracle.COMPETITOR_SPLIT),
    "outcome_labels": (outcome_labels, oracle.LABELS),
    "scores_valid": (scores_valid, oracle.SCORES_OK),
    "bout_counts_running": (bout_counts_running, oracle.RUNNING),
    "leaderboard_topk": (leaderboard_topk, oracle.TOP),
    "min_games_ranking": (min_games_ranking, oracle.MIN_GAMES),
    "matchmaking_nearest": (matchmaking_nearest, oracle.NEAREST),
    "matchmaking_rd_quality": (matchmaking_rd_quality, oracle.DEVIATION),
    "team_sequence": (team_sequence, oracle.TEAM_SEQUENCE),
    "closest_pair_next": (closest_pair_next, oracle.CLOSEST),
    "team_strength": (team_strength, oracle.TEAMS),
    "rating_asof": (rating_asof, oracle.ASOF),
    "synthetic_bouts": (synthetic_bouts, oracle.SYNTHETIC),
    "pgn_games": (pgn_games, oracle.PGN),
    "schedule_bouts": (schedule_bouts, oracle.SCHEDULE),
    "kept_bouts": (kept_bouts, oracle.KEPT),
    "unseen_predictions": (unseen_predictions, oracle.UNSEEN),
    "elo_stream": (elo_stream, oracle.STREAM),
    "points_by_day_stream": (points_by_day_stream, oracle.STREAM_POINTS),
    "glicko_periods_stream": (_period_stream(systems.Glicko()), oracle.GLICKO_PERIODS_STREAM),
    "glicko2_periods_stream": (_period_stream(systems.Glicko2()), oracle.GLICKO2_PERIODS_STREAM),
    "strict_flags": (strict_flags, oracle.STRICT),
    "prior_bouts_line": (_of_history(lambda h: reports.prior_bouts_line(evaluation.cohorts(h))), oracle.PRIOR_LINE),
    "round_robin": (round_robin, oracle.ROUND_ROBIN),
    "skipped_fixtures": (skipped_fixtures, oracle.SKIPPED),
    "weighted_votes": (weighted_votes, oracle.VOTES),
    "multi_criteria": (multi_criteria, oracle.CRITERIA),
    "explore_matches": (explore_matches, oracle.EXPLORE),
    "comparison_table": (_evaluated(["system", *_SHARES, "accuracy_opt", "optimized_accuracy"], systems.Elo(), systems.Dwz()), oracle.COMPARISON),
}


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in _TABLE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _TABLE.items() if sql}
