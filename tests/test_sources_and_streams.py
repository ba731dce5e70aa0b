import datetime as dt
import os

import pytest

from boutworks.operators import state, systems
from boutworks.operators.fold import history_of, replay
from boutworks.operators.periods import rate_periods
from boutworks.sources import kept, pgn, schedule, synthetic
from boutworks.streaming import ratings
from boutworks.streaming.periods import PeriodRatings

PGN = """[Event "Rated Blitz game"]
[Site "https://example.org/abc1"]
[White "ann"]
[Black "bob"]
[Result "1-0"]
[UTCDate "2024.01.02"]
[UTCTime "03:04:05"]
[WhiteElo "1700"]
[BlackElo "?"]
[ECO "B01"]

1. e4 d5 1-0

[Event "Rated Blitz game"]
[Site "https://example.org/abc2"]
[White "bob"]
[Black "cat"]
[Result "1/2-1/2"]
[UTCDate "bad"]
[UTCTime "date"]

1. e4 e5 1/2-1/2

[Event "Unfinished"]
[White "ann"]
[Black "cat"]
[Result "*"]

*
"""


def test_pgn(spark, tmp_path):
    (tmp_path / "g.pgn").write_text(PGN)
    got = pgn.games(pgn.read_pgn(spark, str(tmp_path / "g.pgn"))).orderBy("a").collect()
    assert [(r.a, r.b, r.outcome) for r in got] == [("ann", "bob", 1.0), ("bob", "cat", 0.5)]
    assert got[0].ts == dt.datetime(2024, 1, 2, 3, 4, 5) and got[1].ts is None
    assert got[0].attributes["white_elo"] == "1700" and got[0].attributes["black_elo"] == "1500" and got[0].attributes["game_id"] == "abc1"


def test_schedule(spark, tmp_path):
    (tmp_path / "s.csv").write_text(
        "date,home_name,home_display_name,away_name,home_score,away_score,status_type_completed,venue\n"
        "2024-09-01,h1,Home One,a1,21,14,true,x\n2024-09-02,h2,Home Two,a2,7,7,True,\n2024-09-03,h3,Home Three,a3,1,2,false,\n2024-09-04,h4,Home Four,a4,,2,true,\n"
    )
    got = schedule.bouts(schedule.normalise(schedule.read_schedule(spark, str(tmp_path / "s.csv")))).orderBy("a").collect()
    assert [(r.a, r.b, r.outcome, r.score_a) for r in got] == [("Home One", "a1", 1.0, 21.0), ("Home Two", "a2", 0.5, 7.0)]
    assert got[0].attributes["venue"] == "x" and "venue" not in got[1].attributes
    with pytest.raises(ValueError, match="home_team"):
        schedule.normalise(spark.range(1).withColumnRenamed("id", "date"))


def test_seasons_fail_as_a_whole(spark, tmp_path):
    head = "start_date,home_team,away_team,home_points,away_points\n"
    files = {2001: head + "2001-09-01,P,Q,3,1\n", 2002: head, 2003: head + "2003-09-01,Q,P,0,0\n", 2004: "start_date,home_team\n2004-09-01,P\n"}
    for year, text in files.items():
        (tmp_path / f"{year}.csv").write_text(text)
    paths = {y: str(tmp_path / f"{y}.csv") for y in files}
    with pytest.raises(RuntimeError, match="2004 .*2005"):
        schedule.read_seasons(spark, {**paths, 2005: str(tmp_path / "none.csv")})
    games, empty = schedule.read_seasons(spark, {y: p for y, p in paths.items() if y < 2004})
    assert empty == [2002] and {(r.season, r.home_team) for r in games.collect()} == {(2001, "P"), (2003, "Q")}
    with pytest.raises(ValueError, match="no games"):
        schedule.read_seasons(spark, {2002: paths[2002]})


def test_synthetic_repeats_and_is_sound(spark):
    one = synthetic.bouts(spark, 500, 10, draw_probability=0.5).orderBy("seq").collect()
    two = synthetic.bouts(spark, 500, 10, draw_probability=0.5).repartition(7).orderBy("seq").collect()
    assert one == two and len(one) == 500
    assert all(r.a != r.b for r in one) and {r.outcome for r in one} == {0.0, 0.5, 1.0}
    better = [r.outcome for r in one if r.skill_diff > 200]
    assert sum(better) / len(better) > 0.7
    for kind in ("uniform", "pareto"):
        assert synthetic.competitors(spark, 20, kind=kind).count() == 20
    with pytest.raises(ValueError):
        synthetic.competitors(spark, 5, kind="none")


def test_stream_equals_batch(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [(i, "x" if i % 3 else "y", "ab"[i % 2] + ("1" if i % 3 else "2"), "cd"[i // 2 % 2] + ("1" if i % 3 else "2"), (i % 3) / 2, day + dt.timedelta(hours=i), None, None) for i in range(60)]
    schema = "seq long, league string, a string, b string, outcome double, ts timestamp, score_a double, score_b double"
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late = [(99, "x", "a1", "c1", 1.0, day, None, None), (100, "x", "a1", "c1", 1.0, None, None, None)]
    system = systems.Elo()

    def drain(name):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = ratings.rate_stream(stream, system).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert not query.isActive, name
        return spark.read.parquet(str(tmp_path / "out"))

    got = {r.seq: r.predicted for r in drain("first").collect()}
    want = {r.seq: r.predicted for r in history_of(replay(spark.createDataFrame(rows, schema), system)).collect()}
    assert got == pytest.approx(want)
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted((r.seq, r.kind) for r in drain("second").where("seq >= 99").collect()) == [(99, "late"), (100, "late")]
    # the row without a time didn't take the league's latest one away
    spark.createDataFrame([(101, "x", "a1", "c1", 1.0, day, None, None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert [r.kind for r in drain("third").where("seq = 101").collect()] == ["late"]


def test_running_points(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    schema = "seq long, league string, a string, b string, outcome double, ts timestamp, score_a double, score_b double"
    rows = [(i, "x", "a", "b", 1.0, day + dt.timedelta(hours=i), 3.0 if i % 2 else None, 1.0 if i % 2 else None) for i in range(96)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = ratings.running_points(stream).writeStream.format("memory").queryName("points").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.competitor, r.window_start.day): (r.pts_for, r.pts_against) for r in spark.table("points").collect()}
    assert got["a", 1] == (12 * 3 + 12, 12 * 1) and len(got) == 8


def test_kept_tables(spark, tmp_path, monkeypatch):
    root, calls = str(tmp_path), []
    schema = "a string, b string, outcome double, ts timestamp"

    def make():
        calls.append(1)
        return spark.createDataFrame([("x", "y", 1.0, dt.datetime(2024, 1, len(calls)))], schema)

    rows = [kept.kept(spark, root, "bouts", ("football", 2020, 2021), make).collect() for _ in range(2)]
    assert rows[0] == rows[1] and len(calls) == 1
    kept.kept(spark, root, "bouts", ("football", 2020, 2022), make)
    assert len(calls) == 2
    monkeypatch.setitem(kept.KINDS, "bouts", (2, kept.KINDS["bouts"][1]))
    assert kept.kept(spark, root, "bouts", ("football", 2020, 2021), make).first().ts.day == 3
    assert sorted((v, c) for _, _, v, c in kept.kept_tables(spark, root)) == [(1, ["football", "2020", "2021"]), (1, ["football", "2020", "2022"]), (2, ["football", "2020", "2021"])]
    assert len(kept.drop_older(spark, root)) == 2 and [v for _, _, v, _ in kept.kept_tables(spark, root)] == [2]


def test_what_cannot_be_made_is_not_kept(spark, tmp_path):
    root = str(tmp_path)
    bad = lambda: spark.createDataFrame([("x", "y", 1.0, dt.datetime(2024, 1, 1))], "a string, b string, result double, ts timestamp")
    with pytest.raises(ValueError, match=r"outcome \(missing\)"):
        kept.kept(spark, root, "bouts", ("one",), bad)
    good = bad().withColumnRenamed("result", "outcome")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        kept.kept(spark, root, "bouts", ("one",), lambda: good.selectExpr("a", "b", "outcome / (outcome - 1) AS outcome", "ts"))
    assert os.listdir(root) == []
    # columns that a table of this version lacks are found when it is read
    bad().write.parquet(kept.kept_path(root, "bouts", "two"))
    with pytest.raises(ValueError, match="version 1"):
        kept.kept(spark, root, "bouts", ("two",), lambda: good)
    # and a table that was never finished is not taken for one
    os.makedirs(kept.kept_path(root, "bouts", "three"))
    with pytest.raises(RuntimeError, match="not a whole table"):
        kept.kept(spark, root, "bouts", ("three",), lambda: good)
    with pytest.raises(ValueError, match="path"):
        kept.kept_path(root, "bouts", "../x")
    assert sorted(os.listdir(root)) == ["bouts_v1_three", "bouts_v1_two"]


def test_period_stream(spark, tmp_path):
    system, first = systems.Glicko2(), dt.datetime(2024, 1, 1)
    schema = "seq long, league string, a string, b string, outcome double, ts timestamp"
    rows = [(i, "xy"[i % 5 == 0], "abc"[i % 3], "bcd"[i // 3 % 3], i % 3 / 2, first + dt.timedelta(hours=5 * i)) for i in range(36)]
    rows += [(100, "x", "a", "b", None, first), (101, "x", "a", "b", 1.0, None)]
    rated = PeriodRatings(str(tmp_path / "rated"), system, 1.0, "6 hours")

    def drain(*blocks):
        for block in blocks:
            spark.createDataFrame(block, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = rated.start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), availableNow=True)
        query.awaitTermination(120)
        assert not query.isActive and query.exception() is None
        return shown(rated.ratings(spark)), sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)

    def shown(df):
        return {(r.league, r.competitor): (round(r.rating, 9), round(r.spread, 9), r.games, r.last) for r in df.collect()}

    def stored(until):
        bouts = [p for p in rows if p[5] is None or p[5] < until]
        return shown(rate_periods(spark.createDataFrame(bouts, schema), system, 1.0))

    # the last bout of 24 that counts is on the fifth day, at two in the afternoon; minus six hours, four days are over
    assert drain(rows[:15], rows[15:24]) == (stored(first + dt.timedelta(days=4)), 0)
    # one of a closed period is left out, and counted; the last bout is on the eighth day, at seven
    late = [(200, "x", "a", "d", 0.0, first)]
    whole = stored(first + dt.timedelta(days=7))
    assert drain(late, rows[24:]) == (whole, 1)
    # a batch whose end was not noted runs again from the same ratings
    commits = tmp_path / "rated" / "checkpoint" / "commits"
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for name in (str(last), f".{last}.crc"):
        (commits / name).unlink(missing_ok=True)
    assert drain()[0] == whole
    assert len(list((tmp_path / "rated" / "states").iterdir())) <= 2


def test_period_stream_without_closed_periods(spark, tmp_path):
    rated = PeriodRatings(str(tmp_path / "rated"), systems.Glicko(), 1.0)
    spark.createDataFrame([("x", "a", "b", 1.0, dt.datetime(2024, 1, 1))], "league string, a string, b string, outcome double, ts timestamp").write.parquet(str(tmp_path / "in"))
    rated.start(spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))).awaitTermination(60)
    assert rated.ratings(spark).count() == 0
    with pytest.raises(ValueError):
        PeriodRatings(str(tmp_path), systems.Glicko(), 0)


def test_states_are_parted(spark):
    good = '{"type": "elo", "version": 1, "state": [1510.5], "games": 3, "rating": 1510.5}'
    documents = [
        ("a", good), ("b", '{"current_rating": 1420}'), ("c", "{}"), ("d", None), ("e", "no json"), ("f", good.replace("elo", "glicko")), ("g", good.replace('"version": 1', '"version": 2')),
        ("h", good.replace('"version": 1, ', "")), ("i", good.replace("[1510.5]", "[null]")), ("a", good), ("j", ""), ("k", "[1]"),
    ]
    rows = spark.createDataFrame([("x", *d) for d in documents], "league string, competitor string, document string")
    used, others = state.part_states(rows, systems.Elo())
    assert sorted((r.competitor, r.state, r.games) for r in used.collect()) == [("a", "[1510.5]", 3)] * 2 + [("b", "[1420.0]", 0), ("c", "[400.0]", 0)]
    assert {r.competitor: r.reason for r in others.collect()} == {
        "d": "nothing", "e": "not a document", "f": "another type", "g": "another version", "h": "another version", "i": "state", "j": "not a document", "k": "not a document",
    }
    with pytest.raises(Exception, match="not a elo state"):
        state.import_state(rows, systems.Elo()).collect()
    assert [df.count() for df in state.part_states(rows.limit(0), systems.Elo())] == [0, 0]
