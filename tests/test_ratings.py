"""Known values and invariants of the rating systems."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutworks.functions import expected as E
from boutworks.functions import outcomes
from boutworks.operators import blocks, evaluation, fits, matchmaking, models, records, registry, reports, splits, state, systems
from boutworks.operators.components import connected_components
from boutworks.operators.fold import history_of, quarantine, ratings_of, replay, replay_blocks, split_groups
from boutworks.operators.sequence import with_sequence
from boutworks.operators.systems import Dwz, Ecf, Elo, Ensemble, Glicko, Glicko2, LateBout, TrueSkill

BOUTS = "seq long, league string, a string, b string, outcome double, ts timestamp, score_a double, score_b double"
DAY = dt.datetime(2024, 9, 1)


def bouts_of(spark, rows):
    """rows: (a, b, outcome[, score_a, score_b])"""
    full = [(i, "x", r[0], r[1], r[2], DAY + dt.timedelta(days=i), *(r[3:5] if len(r) > 3 else (None, None))) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, BOUTS)


def test_glicko2_known_values():
    g = Glicko2(rd=200)
    a, b = g.new(), g.new()
    a[3] = b[3] = 0.0
    g.play(a, b, 1.0, 10.0)
    assert (g.rating(a), g.spread(a), a[2]) == pytest.approx((1580.327992, 182.167363, 0.059999626), abs=1e-6)
    assert g.rating(b) == pytest.approx(1419.672008, abs=1e-6)


def test_trueskill_known_values():
    t = TrueSkill()
    a, b = t.new(), t.new()
    t.play(a, b, 1.0, None)
    assert (a[0], a[1], b[0]) == pytest.approx((29.395741, 7.171128, 20.604259), abs=1e-5)
    a, b = [30.0, 5.0], [20.0, 5.0]
    assert t.expected(a, b) == pytest.approx(0.860595, abs=1e-5)
    t.play(a, b, 0.5, None)
    assert (a[0], a[1], b[0]) == pytest.approx((27.054816, 4.200224, 22.945184), abs=1e-5)
    a, b, c, d = t.new(), t.new(), t.new(), t.new()
    t.play(a, b, 0.0, None)
    t.play(d, c, 1.0, None)
    assert a == c and b == d


@pytest.mark.parametrize(("first", "second", "score", "want"), [(100, 100, 1.0, (150, 50)), (100, 100, 0.5, (100, 100)), (100, 200, 1.0, (200, 100)), (100, 200, 0.5, (150, 150))])
def test_ecf_performances(first, second, score, want):
    e = Ecf(periods=1)
    a, b = [float(first)], [float(second)]
    e.play(a, b, score, None)
    assert (a[-1], b[-1]) == want


def test_elo_is_zero_sum_and_floored():
    e = Elo()
    a, b = [500.0], [450.0]
    e.play(a, b, 0.5, None)
    assert sum(map(sum, (a, b))) == pytest.approx(950)
    low, high = [100.0], [100.0]
    e.play(low, high, 0.0, None)
    assert low == [100.0] and high == [116.0]
    with pytest.raises(ValueError):
        Elo(initial=50)


def test_glicko_inflates_once_and_refuses_late_bouts():
    g = Glicko()
    a, b = g.new(), g.new()
    g.play(a, b, 1.0, 0.0)
    early = a[1]
    g.play(a, b, 1.0, 100.0)
    assert a[2] == 100.0 and a[1] < 350 and early < 350
    with pytest.raises(LateBout):
        g.play(a, b, 1.0, 50.0)


def test_dwz_uses_age_of_the_first_side_only():
    d = Dwz()
    young, old = d.new(), d.new()
    other, rival = d.new(), d.new()
    d.play(young, other, 1.0, None, 15)
    d.play(old, rival, 1.0, None)
    assert other == rival and young[1] == 1


@pytest.mark.parametrize("system", [Elo(), Glicko(), Glicko2(), TrueSkill(), Ecf(), Dwz(), Ensemble()])
def test_probabilities_are_bounded(system):
    rng = random.Random(4)
    who = [system.new() for _ in range(6)]
    for day in range(200):
        i, j = rng.sample(range(6), 2)
        p = system.expected(who[i], who[j])
        assert 0 <= p <= 1
        system.play(who[i], who[j], rng.choice([0.0, 0.5, 1.0]), float(day))
    assert all(math.isfinite(system.rating(s)) for s in who)


def test_massey_known_values(spark):
    season = [("north", "south", 1.0, 31.0, 17.0), ("south", "east", 0.0, 3.0, 45.0), ("north", "east", 0.0, 10.0, 24.0), ("east", "west", 1.0, 28.0, 7.0), ("west", "north", 0.5, 20.0, 20.0)]
    rows = bouts_of(spark, season)
    got = {r.competitor: r.rating for r in fits.fit(rows, "massey").collect()}
    assert got == pytest.approx({"east": 19.25, "north": 0.0, "west": -0.875, "south": -18.375})
    unit = {r.competitor: r.rating for r in fits.fit(records.unit_scores(rows), "massey").collect()}
    assert unit == pytest.approx({"east": 0.75, "north": 0.0, "west": -0.125, "south": -0.625})
    keener = {r.competitor: r.rating for r in fits.fit(rows, "keener").collect()}
    assert keener == pytest.approx({"east": 1.7971469679, "north": 0.9883138165, "west": 0.8486487294, "south": 0.3658904862}, abs=1e-9)


@pytest.mark.parametrize("system", ["colley", "massey", "keener", "bradley_terry"])
def test_large_groups_get_the_same_fit(spark, system):
    rng = random.Random(7)
    names = "abcdefgh"
    rows = bouts_of(spark, [(*rng.sample(names[:5], 2), rng.choice([0.0, 0.5, 1.0])) for _ in range(40)] + [("y", "z", 1.0)])
    dense = {r.competitor: r.rating for r in fits.fit(rows, system).collect()}
    spread = {r.competitor: r.rating for r in fits.fit(rows, system, dense=2).collect()}
    assert set(dense) == set("abcde") | {"y", "z"}
    assert spread == pytest.approx(dense, abs=1e-9)


def chain_pairs(spark, n, games):
    """A chain of n competitors as a pair table, and its grids."""
    rng = np.random.default_rng(3)
    grids = {c: np.zeros((n, n)) for c in ("games", "wins", "margin", "points")}
    for i in range(n - 1):
        won, lead = int(rng.binomial(games, 0.6)), int(rng.integers(-90, 90))
        for x, y, w, m in ((i, i + 1, won, lead), (i + 1, i, games - won, -lead)):
            grids["games"][x, y], grids["wins"][x, y], grids["margin"][x, y], grids["points"][x, y] = games, w, m, w
    rows = [("x", "c", n, f"c{i:02d}", f"c{j:02d}", *(float(g[i, j]) for g in grids.values())) for i, j in zip(*np.nonzero(grids["games"]), strict=True)]
    return spark.createDataFrame(rows, "league string, component string, members long, u string, v string, games double, wins double, margin double, points double"), grids


@pytest.mark.parametrize("system", ["colley", "massey", "keener", "bradley_terry"])
def test_large_sparse_groups_settle(spark, system):
    table, grids = chain_pairs(spark, 12, 200)
    got = {r.competitor: (r.rating, r.scale) for r in fits.spread_fit(table, system).collect()}
    rating, scale = fits._DENSE_FITS[system](grids)
    assert [got[f"c{i:02d}"] for i in range(12)] == [pytest.approx((x, scale), abs=1e-7) for x in rating]


@pytest.mark.parametrize("system", ["colley", "massey", "keener", "bradley_terry"])
def test_unsettled_fits_raise(spark, system):
    with pytest.raises(RuntimeError, match="did not settle"):
        fits.spread_fit(chain_pairs(spark, 12, 200)[0], system, steps=1)


def test_whole_history_moves_with_results_and_looks_back(spark):
    rows = bouts_of(spark, [("a", "b", 1.0), ("a", "b", 1.0), ("b", "a", 0.0)])
    curve = fits.whole_history(rows, steps=100, precision=1e-10)
    got = {(r.competitor, r.day): r.rating for r in curve.collect()}
    assert len(got) == 6
    days = sorted({d for _, d in got})
    assert got["a", days[0]] > 1500 > got["b", days[0]]
    wanted = spark.createDataFrame([("x", "a", days[1]), ("x", "a", dt.date(2000, 1, 1)), ("x", "nobody", days[0])], "league string, competitor string, day date")
    at = {(r.competitor, r.day): r.rating for r in fits.rating_at(curve, wanted).collect()}
    assert at["a", days[1]] == pytest.approx(got["a", days[1]])
    assert at["a", dt.date(2000, 1, 1)] == 1500 == at["nobody", days[0]]


def test_tridiagonal_solves():
    rng = np.random.default_rng(1)
    d, o, y = rng.uniform(4, 5, 6), rng.uniform(-1, 1, 5), rng.normal(size=6)
    full = np.diag(d) + np.diag(o, 1) + np.diag(o, -1)
    assert fits._tridiagonal(d, o, y) == pytest.approx(np.linalg.solve(full, y))


def test_groups_replayed_apart_equal_one_replay(spark):
    rng = random.Random(5)
    rows = bouts_of(spark, [(*rng.sample("abc", 2), rng.choice([0.0, 1.0])) if i % 2 else (*rng.sample("xyz", 2), 0.5) for i in range(60)])
    whole = {r.competitor: r.rating for r in ratings_of(replay(rows, Elo())).collect()}
    apart = {r.competitor: r.rating for r in ratings_of(replay(split_groups(rows), Elo())).collect()}
    assert whole == apart and len(whole) == 6


def test_replay_skips_self_bouts_and_unknown_outcomes(spark):
    rows = bouts_of(spark, [("a", "a", 1.0), ("a", "b", None), ("a", "b", 1.0)])
    out = replay(rows, Elo())
    assert [(r.seq, r.predicted) for r in history_of(out).collect()] == [(2, 0.5)]
    assert {r.competitor: r.games for r in ratings_of(out).collect()} == {"a": 1, "b": 1}


def test_empty_inputs(spark):
    none = bouts_of(spark, []).limit(0)
    assert replay(none, Elo()).count() == 0
    assert fits.fit(none, "colley").count() == 0
    assert records.records(none).count() == 0
    assert evaluation.optimize_thresholds(none.select("seq", "a", "b", "outcome", outcomes.label_of_number(none.outcome).alias("label"), none.outcome.alias("predicted"))) == (0.0, (0.5, 0.5))


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 11), (20, 3), (5, 5)] + [(100, i) for i in range(101, 160)] + [(i, i + 1) for i in range(200, 260)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {**dict.fromkeys([1, 2, 3, 20], 1), 10: 10, 11: 10, **dict.fromkeys(range(100, 160), 100), **dict.fromkeys(range(200, 261), 200)}
    assert got == want


def test_sequence_is_gap_free(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1000 as x").repartition(7)
    assert [(r.x, r.seq) for r in with_sequence(df, ["x"]).orderBy("x").collect()] == [(i, i) for i in range(1000)]


def brute_best(pairs):
    values = sorted({p for p, _ in pairs})
    best = (-1, 0, 0)
    for i in range(len(values) + 1):
        for j in range(i, len(values) + 1):
            guess = lambda p: "b" if values.index(p) < i else "a" if values.index(p) >= j else "draw"  # noqa: B023, E731
            n = sum(guess(p) == y for p, y in pairs)
            if n > best[0]:
                best = (n, i, j)
    return best


def test_threshold_sweep_equals_brute_force(spark):
    rng = random.Random(8)
    for n in (1, 2, 14, 40):
        pairs = [(rng.randrange(8) / 8, rng.choice(["a", "b", "draw"])) for _ in range(n)]
        history = spark.createDataFrame([(i, "x", "y", p, y) for i, (p, y) in enumerate(pairs)], "seq long, a string, b string, predicted double, label string")
        r = evaluation.best_cuts(history).first()
        assert (r.correct, r.below_lower, r.below_upper) == brute_best(pairs)
        accuracy, (low, high) = evaluation.optimize_thresholds(history)
        got = sum(("a" if p > high else "b" if p < low else "draw") == y for p, y in pairs) / n
        assert got == pytest.approx(accuracy) == pytest.approx(brute_best(pairs)[0] / n)


def test_history_metrics_known_counts(spark):
    rows = [(0.9, "a"), (0.2, "b"), (0.5, "draw"), (0.7, "b"), (0.3, "a"), (0.5, "a"), (None, "a"), (0.8, None), (0.9, "draw")]
    history = spark.createDataFrame([(i, "P", "Q", p, y) for i, (p, y) in enumerate(rows)], "seq long, a string, b string, predicted double, label string")
    r = evaluation.confusion(history).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (2, 2, 1, 2)
    assert evaluation.metrics(history.limit(0)).first().accuracy == 0.0
    assert math.isnan(evaluation.metrics(history.limit(0)).first().precision)
    assert evaluation.metrics_with_draws(history.limit(0)).first().f1 == 0.0
    told = {r.seq: (r.predicted_winner, r.correct) for r in evaluation.report(history, 0.4, 0.6).collect()}
    assert told[0] == ("p", True) and told[2] == (None, True) and told[3] == ("p", False)


def test_splits(spark):
    rows = bouts_of(spark, [("a", "b", 1.0)] * 9 + [("c", "d", 1.0)])
    untimed = rows.withColumn("ts", outcomes.F.when(rows.seq > 1, rows.ts))
    got = {r.seq: r.split for r in splits.time_split(untimed, 0.25).collect()}
    assert [s for s, v in got.items() if v == "test"] and got[0] == got[1] == "train"
    assert sum(v == "test" for v in got.values()) == 8 - int(8 * 0.75)
    held = splits.competitor_split(rows, 0.5, 3)
    train = {x for r in held.where("split = 'train'").collect() for x in (r.a, r.b)}
    assert len(train) <= 2
    with pytest.raises(ValueError):
        splits.time_split(rows, 1.5)


def test_state_documents(spark):
    rows = bouts_of(spark, [("a", "b", 1.0), ("b", "a", 0.5)])
    for system in (Elo(), Glicko(), TrueSkill(), Ecf(), Ensemble()):
        rated = ratings_of(replay(rows, system, timed=False))
        back = state.import_state(state.export_state(rated, system), system)
        assert {r.competitor: json.loads(r.state) for r in back.collect()} == {r.competitor: json.loads(r.state) for r in rated.collect()}
    with pytest.raises(Exception, match="not a elo state"):
        state.import_state(state.export_state(rated, Ensemble()), Elo()).collect()
    with pytest.raises(ValueError):
        registry.system_named("nothing")
    said = json.loads(state.export_state(rated, Ensemble()).first().document)
    assert {"id", "created_at", "type", "version", "parameters", "games", "rating", "state"} == set(said)


def test_states_are_checked_and_older_ones_read(spark):
    def read(system, *documents):
        rows = [("x", f"c{i}", d if d is None else json.dumps(d)) for i, d in enumerate(documents)]
        return [json.loads(r.state) for r in state.import_state(spark.createDataFrame(rows, "league string, competitor string, document string"), system).orderBy("competitor").collect()]

    assert read(Elo(), {"initial_rating": 500, "current_rating": 512.5}, {"initial_rating": 450}) == [[512.5], [450.0]]
    assert read(Glicko(), {"current_rating": 1600, "current_rd": 80}) == [[1600.0, 80.0, None]]
    assert read(Glicko2(), {"current_mu": 0.5, "current_phi": 1.0, "current_volatility": 0.05})[0] == [0.5, 1.0, 0.05, None]
    assert read(TrueSkill(), {"current_mu": 27.0, "current_sigma": 6.0}) == [[27.0, 6.0]]
    assert read(Dwz(), {"current_rating": 900, "count": 4}) == [[900.0, 4]]
    assert read(Ecf(), {"scores": [100.0, 150.0]}, {"initial_rating": 90}) == [[100.0, 150.0], [90.0]]
    typed = lambda name, s: {"type": name, "version": 1, "state": s}
    for system, wrong in ((Elo(), typed("elo", [])), (Elo(), typed("elo", [None])), (Elo(), typed("elo", [1.0, 2.0])), (Glicko(), typed("glicko", [1500.0, None, None])), (Ecf(periods=2), typed("ecf", [1.0, 2.0, 3.0])), (Ensemble(), typed("ensemble", [[400.0]])), (Elo(), None)):
        with pytest.raises(Exception, match="state of version"):
            read(system, wrong)
    assert read(Ensemble(), typed("ensemble", [[400.0], [1500.0, 350.0, None]])) == [[[400.0], [1500.0, 350.0, None]]]


def test_expected_columns_match_the_systems(spark):
    F = outcomes.F
    row = spark.range(1).select(F.lit(620.0).alias("a"), F.lit(480.0).alias("b"))
    e = lambda c: row.select(c.alias("x")).first().x
    assert e(E.elo(F.col("a"), F.col("b"))) == pytest.approx(Elo().expected([620.0], [480.0]))
    t = TrueSkill()
    assert e(E.trueskill(F.lit(30.0), F.lit(5.0), F.lit(20.0), F.lit(5.0))) == pytest.approx(t.expected([30.0, 5.0], [20.0, 5.0]))
    assert e(E.log5(F.lit(0.826699207003455), F.lit(0.5))) == pytest.approx(0.826699207003455)


def test_scores_must_agree(spark):
    F = outcomes.F
    cases = [(3.0, 1.0, 1.0, True), (1.0, 3.0, 1.0, False), (None, None, 1.0, True), (2.0, None, 1.0, False), (-1.0, -2.0, 1.0, False), (float("inf"), 1.0, 1.0, False), (float("nan"), 1.0, 1.0, False), (2.0, 2.0, 0.5, True)]
    df = spark.createDataFrame(cases, "a double, b double, o double, want boolean")
    assert df.where(outcomes.scores_agree(F.col("a"), F.col("b"), F.col("o")) != F.col("want")).count() == 0


def test_registry_covers_all_systems():
    assert set(systems.SYSTEMS) == {"elo", "glicko", "glicko2", "trueskill", "ecf", "dwz", "ensemble"}


def leagues(spark, n=240):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        league = rng.choice(["x", "y"])
        a, b = rng.sample([f"{league}{k}" for k in range(9)], 2)
        rows.append((i, league, a, b, rng.choice([0.0, 0.5, 1.0, None]) if i % 17 == 0 else rng.choice([0.0, 0.5, 1.0]), DAY + dt.timedelta(hours=i), None, None))
    return spark.createDataFrame(rows, BOUTS)


@pytest.mark.parametrize("system", [Elo(), Glicko(), Dwz()])
def test_blocks_replayed_one_by_one_equal_one_replay(spark, system):
    """To the last bit, for blocks of any size."""
    rows = leagues(spark)
    whole = replay(rows, system)
    key = lambda df: sorted(map(str, df.collect()))
    for block in (37, 1000):
        parts = replay_blocks(rows, system, block)
        assert key(ratings_of(parts)) == key(ratings_of(whole))
        assert key(history_of(parts)) == key(history_of(whole))
    assert replay_blocks(rows.limit(0), system, 5).count() == 0


def test_outcomes_are_checked(spark):
    rows = bouts_of(spark, [("a", "b", 1.0), ("a", "b", 0.7), ("b", "a", None), ("a", "b", -1.0), ("a", "b", float("nan"))])
    kept, others = quarantine(rows)
    assert {r.seq for r in kept.collect()} == {0, 2} and {r.seq for r in others.collect()} == {1, 3, 4}
    with pytest.raises(Exception, match="an outcome must be"):
        replay(rows, Elo()).collect()
    assert replay(kept, Elo()).count() == 3


def test_outcomes_by_comparison_and_scores_from_attributes(spark):
    F = outcomes.F
    rows = spark.createDataFrame([(1, True), (2, False), (3, None)], "k int, w boolean")
    assert {r.k: r.o for r in rows.select("k", outcomes.outcome_of(F.col("w")).alias("o")).collect()} == {1: 1.0, 2: 0.0, 3: 0.5}
    held = [(1, {"h": 3.0, "g": 2.0}), (2, {"h": 3.0}), (3, None), (4, {}), (5, {"h": float("nan"), "g": 1.0}), (6, {"h": float("inf"), "g": 1.0}), (7, {"h": -1.0, "g": 0.0})]
    a, b = outcomes.scores_of(F.col("m"), "h", "g")
    got = {r.k: (r.a, r.b) for r in spark.createDataFrame(held, "k int, m map<string,double>").select("k", a.alias("a"), b.alias("b")).collect()}
    assert got == {1: (3.0, 2.0), 7: (-1.0, 0.0), **dict.fromkeys((2, 3, 4, 5, 6), (None, None))}
    text = spark.createDataFrame([({"h": "3", "g": "2"},)], "m map<string,string>").select(a.alias("a"), b.alias("b")).first()
    assert (text.a, text.b) == (None, None)
    mixed = spark.createDataFrame([((3, 2.5),), ((None, 1.0),)], "m struct<h:int,g:double>").select(a.alias("a"), b.alias("b")).collect()
    assert [(r.a, r.b) for r in mixed] == [(3.0, 2.5), (None, None)]
    flags = spark.createDataFrame([((True, 2.5),)], "m struct<h:boolean,g:double>").select(a.alias("a"), b.alias("b")).first()
    assert (flags.a, flags.b) == (None, None)


@pytest.mark.parametrize("make", [
    lambda: Elo(k=-1), lambda: Glicko(rd=0), lambda: Glicko(c=-1), lambda: Glicko2(tau=0), lambda: Glicko2(volatility=-1), lambda: TrueSkill(sigma=0), lambda: TrueSkill(draw_probability=1),
    lambda: Ecf(periods=0), lambda: Ecf(delta=0), lambda: Dwz(initial=5), lambda: Ensemble(members=()),
])
def test_parameters_are_checked(make):
    with pytest.raises(ValueError):
        make()


def test_fits_check_their_parameters(spark):
    rows = bouts_of(spark, [("a", "b", 1.0)])
    for wrong in (lambda: fits.fit(rows, "nothing"), lambda: fits.fit(rows, "colley", dense=0), lambda: fits.whole_history(rows, w2=0), lambda: fits.bradley_terry_fit(np.ones((2, 2)), np.ones((2, 2)), reg=0)):
        with pytest.raises(ValueError):
            wrong()


def test_pair_tables_go_on(spark):
    rows = leagues(spark)
    grown = fits.add_pairs(records.pairs(rows.where("seq < 100")), rows.where("seq >= 100"))
    assert sorted(map(str, grown.select("league", "u", "v", *fits.PAIR_SUMS).collect())) == sorted(map(str, records.pairs(rows).select("league", "u", "v", *fits.PAIR_SUMS).collect()))


def test_whole_history_is_a_maximum(spark):
    """The gradient of the posterior, written out anew, vanishes; the distributed rounds give the same curves."""
    rng = random.Random(2)
    played = [(*rng.sample("abcde", 2), rng.choice([0.0, 0.5, 1.0]), rng.randrange(6)) for _ in range(60)] * 2
    rows = spark.createDataFrame([(i, "x", a, b, o, DAY + dt.timedelta(days=3 * d), None, None) for i, (a, b, o, d) in enumerate(played)], BOUTS)
    curve = {(r.competitor, r.day): r.rating for r in fits.whole_history(rows, steps=500, precision=1e-11).collect()}
    day = lambda d: (DAY + dt.timedelta(days=3 * d)).date()
    for (who, at), r in curve.items():
        pull = 0.0
        for a, b, o, d in played:
            for me, other, score in ((a, b, o), (b, a, 1 - o)):
                if me == who and day(d) == at:
                    pull += (score - 1 / (1 + 10 ** ((curve[other, at] - r) / 400))) * math.log(10) / 400
        days = sorted(d for w, d in curve if w == who)
        k = days.index(at)
        for near in days[max(0, k - 1) : k] + days[k + 1 : k + 2]:
            pull += (curve[who, near] - r) / (fits.WHR_W2 * abs((near - at).days))
        if k == 0:
            pull += (fits.WHR_INITIAL - r) / fits.WHR_W2
        assert abs(pull) < 1e-9
    spread = {(r.competitor, r.day): r.rating for r in fits.whole_history(rows, precision=1e-4, dense=2).collect()}
    assert spread == pytest.approx(curve, abs=0.01)
    with pytest.raises(RuntimeError, match="did not settle"):
        fits.whole_history(rows, precision=1e-4, dense=2, rounds=2)


def some_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "LINKS", 40)


def test_curves_by_several_blocks_are_the_maximum(spark, monkeypatch):
    some_blocks(monkeypatch)
    rng = random.Random(5)
    played = [(*rng.sample("abcdefgh", 2), rng.choice([0.0, 0.5, 1.0]), rng.randrange(9)) for _ in range(150)] + [("y", "z", 1.0, 3)]
    rows = spark.createDataFrame([(i, "x", a, b, o, DAY + dt.timedelta(days=2 * d), None, None) for i, (a, b, o, d) in enumerate(played)], BOUTS)
    curve = {(r.competitor, r.day): r.rating for r in fits.whole_history(rows, precision=1e-9).collect()}
    spread = fits.whole_history(rows, dense=0)
    assert {(r.competitor, r.day): r.rating for r in spread.collect()} == pytest.approx(curve, abs=1e-4)
    assert max(abs(r.pull) for r in fits.curve_pull(spread, rows).collect()) < 1e-7


def league_of_days(spark):
    rng = random.Random(12)
    played = [(*rng.sample("abcdefgh", 2), rng.choice([0.0, 0.5, 1.0]), rng.randrange(9)) for _ in range(120)]
    return spark.createDataFrame([(i, "x", a, b, o, DAY + dt.timedelta(days=3 * d), None, None) for i, (a, b, o, d) in enumerate(played)], BOUTS)


def test_ratings_are_read_off_curves_by_blocks(spark, monkeypatch):
    some_blocks(monkeypatch)
    rows = league_of_days(spark)
    wanted = rows.select("league", F.col("a").alias("competitor"), F.date_add(F.to_date("ts"), 1).alias("day"))
    read = lambda **how: {(r.competitor, r.day): r.rating for r in fits.rating_at(fits.whole_history(rows, **how), wanted).collect()}
    assert read(dense=0) == pytest.approx(read(), abs=1e-4)


def test_last_ratings_of_curves_by_blocks(spark, monkeypatch):
    some_blocks(monkeypatch)
    rows = league_of_days(spark)
    want = {r.competitor: r.rating for r in models.WholeHistory().fit(rows).collect()}
    monkeypatch.setattr(fits.whole_history, "__defaults__", tuple(0 if v == fits.WHR_ROWS else v for v in fits.whole_history.__defaults__))
    assert {r.competitor: r.rating for r in models.WholeHistory().fit(rows).collect()} == pytest.approx(want, abs=1e-4)


def test_strengths_by_several_blocks_and_groups_equal_the_dense_fit(spark, monkeypatch):
    some_blocks(monkeypatch)
    rng = random.Random(6)
    rows = bouts_of(spark, [(*rng.sample(names, 2), rng.choice([0.0, 0.5, 1.0])) for names in ("abcdefghij", "klmnopqrst") for _ in range(60)] + [("y", "z", 1.0)])
    dense = {r.competitor: r.rating for r in fits.fit(rows, "bradley_terry").collect()}
    assert {r.competitor: r.rating for r in fits.fit(rows, "bradley_terry", dense=1).collect()} == pytest.approx(dense, abs=1e-9)


def test_components_of_text_with_loops_and_nulls(spark):
    edges = [("b", "a"), ("c", "b"), ("c", "b"), ("d", None), (None, "e"), ("x", "x"), ("z", "y")]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u string, v string").repartition(3)).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "y": "y", "z": "y"}
    assert connected_components(spark.createDataFrame([], "u string, v string")).count() == 0


def rated(spark, n=60):
    rng = random.Random(3)
    rows = [(rng.choice("xy"), f"c{i:02d}", float(rng.choice([500, 500, 510, rng.randrange(400, 900)])), float(rng.randrange(30, 200)), rng.randrange(9)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "league string, competitor string, rating double, spread double, games long")


@pytest.mark.parametrize("within", [5.0, 60.0])
def test_opponents_equal_brute_force_by_league(spark, within):
    rows, table = rated(spark)
    near, quality = {}, {}
    for league, who, r, s, _ in rows:
        own = [(abs(r - r2), o, abs(r - r2) / (1 + math.sqrt(s * s + s2 * s2) / 100)) for l2, o, r2, s2, _ in rows if l2 == league and o != who and abs(r - r2) <= within]
        if own:
            near[who] = min(d for d, _, _ in own)
            quality[who] = min((q, o) for _, o, q in own)
    assert {r.competitor: r["diff"] for r in matchmaking.nearest(table, within).collect()} == pytest.approx(near)
    for step in (1, 8):
        got = {r.competitor: (r.quality, r.opponent) for r in matchmaking.deviation_quality(table, within, step).collect()}
        assert set(got) == set(quality)
        for who, (q, o) in quality.items():
            assert got[who] == (pytest.approx(q), o)


def test_equally_close_opponents_go_by_name(spark):
    ratings = {"a": 500.0, "b": 501.0, "c": 501.0, "d": 501.0, "e": 502.0, "f": 503.0, "g": 503.0, "h": 504.0, "i": 900.0}
    table = spark.createDataFrame([("x", who, r) for who, r in ratings.items()], "league string, competitor string, rating double")
    want = {who: min((abs(r - r2), o) for o, r2 in ratings.items() if o != who) for who, r in ratings.items()}
    got = {r.competitor: (r["diff"], r.opponent) for r in matchmaking.nearest(table).collect()}
    assert got == {who: best for who, best in want.items() if best[0] <= 100.0}


def test_those_that_do_not_explore_meet_the_first_of_equally_close_ones(spark):
    table = spark.createDataFrame([("x", "a", 500.0), ("x", "b", 500.0), ("x", "c", 500.0), ("x", "d", 501.0)], "league string, competitor string, rating double")
    got = {r.competitor: r.opponent for r in reports.explore(table, matchmaking.nearest(table), 100.0, 0.0).collect()}
    assert got == {"a": "b", "b": "a", "c": "a", "d": "a"}


def test_a_round_robin_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(reports, "ROBIN_BLOCK", 8)
    table = spark.createDataFrame([("x", f"c{k:02d}") for k in range(60)] + [("y", "d"), ("y", "e")], "league string, competitor string")
    rows = reports.round_robin(table).select("league", "a", "b", F.spark_partition_id().alias("task")).collect()
    both = reports.round_robin(table, ordered=True).count()
    names = sorted(f"c{k:02d}" for k in range(60))
    assert sorted((r.league, r.a, r.b) for r in rows) == [("x", a, b) for i, a in enumerate(names) for b in names[i + 1 :]] + [("y", "d", "e")]
    assert both == 60 * 59 + 2 and len({r.task for r in rows if r.league == "x"}) > 1


def test_exploring_stays_in_the_league(spark):
    rows, table = rated(spark)
    league = {who: x for x, who, *_ in rows}
    got = reports.explore(table, matchmaking.nearest(table, 60.0), 60.0, 0.5).collect()
    assert len(got) == len({r.competitor for r in got}) and all(league[r.competitor] == league[r.opponent] == r.league for r in got)


def test_random_search_equals_brute_force(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(8) / 8, rng.choice(["a", "b", "draw"])) for _ in range(50)]
    history = spark.createDataFrame([(i, "x", "y", p, y) for i, (p, y) in enumerate(pairs)], "seq long, a string, b string, predicted double, label string")
    r = evaluation.random_search(history, trials=50, seed=4).first()
    count = lambda low, high: sum(("a" if p > high else "b" if p < low else "draw") == y for p, y in pairs)
    assert r.correct == count(r.lower, r.upper)
    assert 0 <= r.lower <= r.upper <= 7 / 8


def test_evaluation_equals_a_loop(spark):
    rows = leagues(spark).where("league = 'x'")
    for system in (Elo(), Glicko(), TrueSkill(), Ensemble()):
        made = evaluation.evaluate(rows, system, 0.3)
        got = made.metrics.first()
        bouts = sorted(rows.collect(), key=lambda r: (r.ts, r.seq))
        cut = int(len(bouts) * 0.7)
        known: dict = {}
        for r in bouts[:cut]:
            a, b = known.setdefault(r.a, system.new()), known.setdefault(r.b, system.new())
            if r.outcome is not None:
                system.play(a, b, r.outcome, r.ts.timestamp() / 86400)
        right = total = 0
        for r in bouts[cut:]:
            if r.a in known and r.b in known and r.outcome is not None:
                p = system.expected(known[r.a], known[r.b])
                total += 1
                right += ("a" if p > 0.5 else "b" if p < 0.5 else "draw") == {1.0: "a", 0.0: "b", 0.5: "draw"}[r.outcome]
        assert (got.n, round(got.accuracy * got.n)) == (total, right)
        assert got.accuracy <= got.accuracy_opt == got.optimized_accuracy and sum(c.total for c in made.cohorts.collect()) == total
        assert [r.competitor for r in made.top.orderBy("place").collect()] == [w for w, _ in sorted(((w, round(system.rating(s), 6)) for w, s in known.items()), key=lambda x: (-x[1], x[0]))[:5]]


def test_team_bouts(spark):
    """A team of one moves as its only member; in a team, the less certain member moves more."""
    rows = [(1, "a", 25.0, 8.333), (2, "b", 25.0, 8.333), (3, "c", 30.0, 2.0), (3, "d", 20.0, 6.0), (4, "e", 22.0, 4.0), (4, "f", 28.0, 4.0), (5, "g", 9.0, 1.0)]
    members = spark.createDataFrame(rows, "team int, competitor string, mu double, sigma double")
    bouts = spark.createDataFrame([(1, 2), (4, 3)], "winner int, loser int")
    got = {r.competitor: (r.mu, r.sigma) for r in matchmaking.team_bouts(members, bouts).collect()}
    t = TrueSkill(draw_probability=0.0)
    a, b = t.new(), t.new()
    t.play(a, b, 1.0, None)
    assert got["a"] == pytest.approx(tuple(a)) and got["b"] == pytest.approx(tuple(b)) and got["g"] == (9.0, 1.0)
    assert 30.0 - got["c"][0] < 20.0 - got["d"][0] and got["e"][0] > 22.0 and got["d"][1] < 6.0
    with pytest.raises(Exception, match="several bouts"):
        matchmaking.team_bouts(members, spark.createDataFrame([(1, 2), (1, 3)], "winner int, loser int")).collect()


def test_batches(spark):
    from boutworks.sources.batches import batches

    assert [len(b) for b in batches(spark.range(25), 10)] == [10, 10, 5] and list(batches(spark.range(0), 3)) == []
    for wrong in (0, -1, True, 2.5):
        with pytest.raises(ValueError):
            batches(spark.range(3), wrong)
