"""Replay by dependency levels: bouts that wait for nobody are played at once, by as many tasks as there are.

A bout is ready when both its sides have played all their earlier bouts. All ready bouts
are independent of each other, whatever connects their sides later on, so a level is a
join with both sides' states and one pass over rows, also where one connected group
holds all bouts. Bouts are taken in blocks of time, so that a round looks at one block
only; the rest of a block, once fewer than ``few`` bouts of it are ready, is replayed by
connected groups, for which a round would cost more than it plays. Every round's rows
and states are stored, so a lost executor costs one round.

Ratings and predictions are those of ``fold.replay`` to the last bit.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutworks.functions.outcomes import strict_outcome
from boutworks.operators.fold import _KINDS, _NAMES, REPLAY, history_of, ratings_of, replay, split_groups
from boutworks.operators.sequence import segmented_sums, with_sequence
from boutworks.runtime import staged

FEW = 20_000
_STATE = ["league", "competitor", "rating", "spread", "games", "state"]


def _played(ready: DataFrame, system) -> DataFrame:
    """Rows of ``replay`` for bouts that have both sides' states beside them (``sa``, ``sb`` as JSON or null, ``na``, ``nb`` games)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for league, seq, a, b, outcome, day, age, sa, sb, na, nb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = (system.new() if s is None else json.loads(s) for s in (sa, sb))
                out.append((league, "bout", seq, a, b, system.expected(x, y), outcome, None, None, None, None, None))
                system.play(x, y, outcome, day, age)
                for who, s, n in ((a, x, na), (b, y, nb)):
                    out.append((league, "state", None, None, None, None, None, who, system.rating(s), system.spread(s), n + 1, json.dumps(s)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)], names=_NAMES)

    return ready.select("league", "seq", "a", "b", "outcome", "day", "age", "sa", "sb", "na", "nb").mapInArrow(run, REPLAY)


def _side(table: DataFrame, c: str, **columns: str) -> DataFrame:
    return table.select("league", F.col("competitor").alias(c), *[F.col(k).alias(v) for k, v in columns.items()])


def _after(states: DataFrame | None, new: DataFrame) -> DataFrame:
    """The states with those of ``new`` in place of the older ones, stored."""
    if states is None:
        return staged(new, "states")
    return staged(new.unionByName(states.join(new, ["league", "competitor"], "left_anti")), "states")


def replay_levels(bouts: DataFrame, system, block: int, few: int = FEW, timed: bool = True) -> tuple[DataFrame, DataFrame]:
    """(history, ratings) of all played bouts, as ``history_of`` and ``ratings_of`` give them; bouts without an outcome are left out."""
    if block < 1 or few < 1:
        raise ValueError("block and few must be positive")
    day = F.unix_micros(F.col("ts").cast("timestamp")) / 8.64e10 if timed and "ts" in bouts.columns else F.lit(None).cast("double")
    age = F.col("age_a").cast("int") if "age_a" in bouts.columns else F.lit(None).cast("int")
    kept = bouts.where("a <> b and outcome is not null")
    columns = ["league", F.col("seq").cast("long").alias("seq"), "a", "b", strict_outcome(F.col("outcome").cast("double")).alias("outcome"), day.alias("day"), age.alias("age")]
    more = ["ts"] if "ts" in bouts.columns else []
    numbered = staged(with_sequence(kept.select(*columns, *more), ["seq", "league"], "_at"), "numbered-bouts")
    history, states = None, None
    for k in range(-(-numbered.count() // block)):
        part = numbered.where((F.col("_at") >= k * block) & (F.col("_at") < (k + 1) * block)).drop("_at")
        sides = part.select("league", "seq", F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("competitor")) for c in ("a", "b")])).alias("s"), F.lit(1).cast("long").alias("k")).select("league", "seq", "s.*", "k")
        turn = segmented_sums(sides, ["league", "competitor"], ["seq"], ["k"])
        turns = turn.groupBy("league", "seq").agg(*[F.max(F.when(F.col("side") == c, F.col("k"))).alias(f"k{c}") for c in ("a", "b")])
        rest = staged(part.join(turns, ["league", "seq"]), "block")
        done = None  # how many bouts of the block each side has played
        while True:
            here = rest
            if done is not None:
                for c in ("a", "b"):
                    here = here.join(_side(done, c, n=f"d{c}"), ["league", c], "left").withColumn(f"d{c}", F.coalesce(f"d{c}", F.lit(0)))
            else:
                here = here.withColumns({"da": F.lit(0), "db": F.lit(0)})
            here = staged(here.withColumn("ready", (F.col("ka") == F.col("da") + 1) & (F.col("kb") == F.col("db") + 1)).drop("da", "db"), "turns")
            ready = here.where("ready")
            n = ready.count()
            if n < few:
                break
            rows = ready
            for c in ("a", "b"):
                if states is None:
                    rows = rows.withColumns({f"s{c}": F.lit(None).cast("string"), f"n{c}": F.lit(0).cast("long")})
                else:
                    rows = rows.join(_side(states, c, state=f"s{c}", games=f"n{c}"), ["league", c], "left").withColumn(f"n{c}", F.coalesce(f"n{c}", F.lit(0).cast("long")))
            out = staged(_played(rows, system), "level")
            history = history_of(out) if history is None else history.unionByName(history_of(out))
            states = _after(states, ratings_of(out).select(*_STATE))
            went = ready.select("league", F.explode(F.array(*[F.struct(F.col(c).alias("competitor"), F.col(f"k{c}").alias("n")) for c in ("a", "b")])).alias("s")).select("league", "s.*")
            done = staged(went if done is None else went.unionByName(done.join(went, ["league", "competitor"], "left_anti")), "done")
            rest = here.where("not ready").drop("ready")
        left = here.drop("ready", "ka", "kb", "day")
        if left.isEmpty():
            continue
        groups = staged(split_groups(left.withColumn("_league", F.col("league"))), "groups")
        seeds, past = None, None
        if states is not None:
            who = groups.select("league", "_league", F.explode(F.array("a", "b")).alias("competitor")).distinct()
            known = who.join(states.withColumnRenamed("league", "_league"), ["_league", "competitor"])
            seeds, past = known.select("league", "competitor", "state"), states.select("league", "competitor", F.col("games").alias("_games"))
        out = replay(groups.drop("_league").withColumnRenamed("age", "age_a"), system, timed, seeds)
        out = staged(out.withColumn("league", F.substring_index("league", "\u0001", 1)), "replayed")
        new = ratings_of(out).select(*_STATE)
        if past is not None:
            new = new.join(past, ["league", "competitor"], "left").withColumn("games", F.col("games") + F.coalesce("_games", F.lit(0))).select(*_STATE)
        history = history_of(out) if history is None else history.unionByName(history_of(out))
        states = _after(states, new)
    if history is None:
        empty = replay(bouts.where("outcome is not null"), system, timed)
        return history_of(empty), ratings_of(empty)
    return history, states
