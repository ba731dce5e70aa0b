"""Ordered replay of bouts through an incremental system.

Bouts are hashed by league and sorted by sequence; a task streams over its rows
and holds the states of one league's competitors, never its bouts. Competitors
of different leagues, or of different connected groups (``split_groups``), don't
affect each other, so those run in parallel. ``replay_blocks`` does the same in
blocks of time: inside a block the connected groups are small where there are many
competitors, and the states go from block to block, so one league with all bouts
is many tasks and has the same ratings to the last bit.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutworks.functions.outcomes import is_outcome, strict_outcome
from boutworks.operators.components import connected_components
from boutworks.operators.sequence import with_sequence
from boutworks.runtime import staged

REPLAY = "league string, kind string, seq long, a string, b string, predicted double, outcome double, competitor string, rating double, spread double, games long, state string"
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.string()]
_NAMES = [f.strip().split()[0] for f in REPLAY.split(",")]


def split_groups(bouts: DataFrame) -> DataFrame:
    """``bouts`` whose league is the connected group, named by its league and first competitor, for parallel replay."""
    name = lambda c: F.concat_ws("\u0001", "league", c)
    parts = connected_components(bouts.select(name("a").alias("u"), name("b").alias("v")))
    return bouts.withColumn("_n", name("a")).join(parts, F.col("_n") == F.col("node")).withColumn("league", F.col("component")).drop("_n", "node", "component")


def replay(bouts: DataFrame, system, timed: bool = True, seeds: DataFrame | None = None) -> DataFrame:
    """Rows of kind ``bout`` (the prediction before the bout) and ``state`` (each competitor's last state).

    Rows without an outcome make their competitors known but aren't played. Bouts of a competitor with itself are dropped.
    ``seeds`` (league, competitor, state as JSON) are known before the first bout. An outcome besides 1, 0.5, 0 and null ends
    the query with an error; ``quarantine`` parts such rows off beforehand.
    """
    return replay_many(bouts, [system], timed, seeds).drop("system")


def replay_many(bouts: DataFrame, systems: list, timed: bool = True, seeds: DataFrame | None = None) -> DataFrame:
    """What ``replay`` gives, for several systems in one pass: a league is a task for each of them; ``system`` is the name."""
    if len({s.name for s in systems}) != len(systems) or not systems:
        raise ValueError("systems must have different names, and there must be one")
    day = F.unix_micros(F.col("ts").cast("timestamp")) / 8.64e10 if timed and "ts" in bouts.columns else F.lit(None).cast("double")
    age = F.col("age_a") if "age_a" in bouts.columns else F.lit(None).cast("int")
    rows = bouts.where("a <> b").select("league", F.col("seq").cast("long").alias("seq"), "a", "b", strict_outcome(F.col("outcome").cast("double")).alias("outcome"), day.alias("day"), age.cast("int").alias("age"), F.lit(None).cast("string").alias("state"))
    if seeds is not None:
        null = lambda kind: F.lit(None).cast(kind)
        rows = rows.unionByName(seeds.select("league", F.lit(-1).cast("long").alias("seq"), F.col("competitor").alias("a"), null("string").alias("b"), null("double").alias("outcome"), null("double").alias("day"), null("int").alias("age"), "state"))
    rows = rows.withColumn("which", F.explode(F.array(*[F.lit(k) for k in range(len(systems))])))

    def batch_of(name: str, out: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([name] * len(out), pa.string())], names=[*_NAMES, "system"])

    def final(league: str, which: int, known: dict) -> Iterator[pa.RecordBatch]:
        system = systems[which]
        out = [(league, "state", None, None, None, None, None, who, system.rating(s), system.spread(s), n, json.dumps(s)) for who, (s, n) in known.items()]
        for i in range(0, len(out), 10_000):
            yield batch_of(system.name, out[i : i + 10_000])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, system = (None, None), {}, None
        for batch in batches:
            out = []
            for league, seq, a, b, outcome, at, years, state, which in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (league, which) != now:
                    if out:
                        yield batch_of(system.name, out)
                        out = []
                    if known:
                        yield from final(*now, known)
                    now, known, system = (league, which), {}, systems[which]
                if b is None:
                    known[a] = [json.loads(state), 0]
                    continue
                x, y = known.setdefault(a, [system.new(), 0]), known.setdefault(b, [system.new(), 0])
                if outcome is None:
                    continue
                out.append((league, "bout", seq, a, b, system.expected(x[0], y[0]), outcome, None, None, None, None, None))
                system.play(x[0], y[0], outcome, at, years)
                x[1] += 1
                y[1] += 1
            if out:
                yield batch_of(system.name, out)
        if known:
            yield from final(*now, known)

    return rows.repartition("league", "which").sortWithinPartitions("league", "which", "seq").mapInArrow(run, REPLAY + ", system string")


def quarantine(bouts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The bouts whose outcome is 1, 0.5, 0 or null, and the others."""
    ok = is_outcome(F.col("outcome").cast("double"))
    return bouts.where(ok), bouts.where(~ok)


def replay_blocks(bouts: DataFrame, system, block: int, timed: bool = True) -> DataFrame:
    """What ``replay`` gives, by blocks of ``block`` bouts in the order of seq.

    A block's connected groups run side by side; each block's rows and states are stored before the next one begins.
    With fewer bouts a block than half the competitors, most groups are small.
    """
    if block < 1:
        raise ValueError("a block has one bout at least")
    numbered = staged(with_sequence(bouts.where("a <> b"), ["seq", "league"], "_at"), "numbered-bouts")
    blocks = -(-numbered.count() // block)
    played, states = None, None
    for k in range(blocks):
        part = numbered.where((F.col("_at") >= k * block) & (F.col("_at") < (k + 1) * block)).drop("_at").withColumn("_league", F.col("league"))
        groups = staged(split_groups(part), "block")
        seeds = None
        if states is not None:
            ends = F.explode(F.array("a", "b")).alias("competitor")
            here = groups.select("league", "_league", ends).distinct()
            seeds = here.join(states.withColumnRenamed("league", "_league"), ["_league", "competitor"]).select("league", "competitor", "state")
        out = replay(groups.drop("_league"), system, timed, seeds)
        out = staged(out.withColumn("league", F.substring_index("league", "\u0001", 1)), "replayed")
        played = out.where("kind = 'bout'") if played is None else played.unionByName(out.where("kind = 'bout'"))
        new = out.where("kind = 'state'").select("league", "competitor", "rating", "spread", "games", "state")
        if states is None:
            states = new
        else:
            past = states.select("league", "competitor", F.col("games").alias("_games"))
            sums = new.join(past, ["league", "competitor"], "left").withColumn("games", F.col("games") + F.coalesce("_games", F.lit(0))).drop("_games")
            states = staged(sums.unionByName(states.join(new, ["league", "competitor"], "left_anti")), "states")
    if played is None:
        return replay(bouts, system, timed)
    last = states.withColumn("kind", F.lit("state")).select(*[F.col(c) if c in states.columns or c == "kind" else F.lit(None).cast(k).alias(c) for c, k in played.dtypes])
    return played.unionByName(last)


def ratings_of(replayed: DataFrame, *more: str) -> DataFrame:
    return replayed.where("kind = 'state'").select(*more, "league", "competitor", "rating", "spread", "games", "state")


def history_of(replayed: DataFrame) -> DataFrame:
    return replayed.where("kind = 'bout'").select("league", "seq", "a", "b", "predicted", "outcome")


def leaderboard(ratings: DataFrame, limit: int | None = None) -> DataFrame:
    """Best first; equal ratings by name."""
    out = ratings.orderBy(F.desc("rating"), "competitor")
    return out.limit(limit) if limit else out


def predict(fixtures: DataFrame, ratings: DataFrame, expected, default: float) -> DataFrame:
    """``fixtures`` (league, a, b, ...) with ``predicted``; unknown competitors have the default rating.

    Adaptive execution broadcasts the ratings where they are small and shuffles both sides otherwise.
    """
    side = lambda c: ratings.select(F.col("league").alias(f"_l{c}"), F.col("competitor").alias(f"_c{c}"), F.col("rating").alias(f"_r{c}"))
    out = fixtures
    for c in ("a", "b"):
        out = out.join(side(c), (F.col("league") == F.col(f"_l{c}")) & (F.col(c) == F.col(f"_c{c}")), "left")
    mine, other = F.coalesce("_ra", F.lit(default)), F.coalesce("_rb", F.lit(default))
    return out.withColumn("predicted", expected(mine, other)).drop(*[f"_{k}{c}" for k in "lcr" for c in "ab"])


def known_fixtures(fixtures: DataFrame, ratings: DataFrame) -> DataFrame:
    """Fixtures whose competitors both have a rating."""
    who = ratings.select("league", "competitor")
    out = fixtures
    for c in ("a", "b"):
        out = out.join(who.withColumnRenamed("competitor", c), ["league", c], "left_semi")
    return out


def predict_states(fixtures: DataFrame, ratings: DataFrame, system) -> DataFrame:
    """``fixtures`` (league, a, b, ...) with ``predicted`` from both sides' states; unknown competitors are new.

    The chance is a column expression where the system has one (``expected_column``), else the system's own ``expected``.
    """
    side = lambda c: ratings.select("league", F.col("competitor").alias(c), F.col("state").alias(f"_s{c}"))
    out = fixtures.join(side("a"), ["league", "a"], "left").join(side("b"), ["league", "b"], "left")
    new = F.lit(json.dumps(system.new()))
    return said_by(out.withColumns({"_sa": F.coalesce("_sa", new), "_sb": F.coalesce("_sb", new)}), system).drop("_sa", "_sb")


def said_by(rows: DataFrame, system) -> DataFrame:
    """``rows`` with ``predicted`` from the states ``_sa`` and ``_sb``."""
    if hasattr(system, "expected_column"):
        return rows.withColumn("predicted", system.expected_column(F.col("_sa"), F.col("_sb")))
    keep = [f for f in rows.schema.fields if f.name != "predicted"]
    schema = T.StructType([*keep, T.StructField("predicted", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [system.expected(json.loads(a), json.loads(b)) for a, b in zip(batch.column("_sa").to_pylist(), batch.column("_sb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(said, pa.float64())], names=[*(f.name for f in keep), "predicted"])

    return rows.mapInArrow(run, schema)
