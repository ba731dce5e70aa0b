"""Ratings under Structured Streaming.

Bouts are keyed by league. Each league keeps one state entry per competitor in a
map in the state store, so a micro-batch reads and writes only the competitors
that play in it. Bouts of a batch are replayed by (ts, seq). A bout before its
league's latest one, or without a time, goes out as a row of kind ``late`` instead
of being played. A league's rows of one batch are sorted in one task: bound the
trigger (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``) where a league has very
many.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PLAYED = "league string, kind string, seq long, a string, b string, predicted double, rating_a double, rating_b double"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Replay(StatefulProcessor):
    def __init__(self, system, timed: bool):
        self.system, self.timed = system, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = handle.getMapState("states", "competitor string", "state string")
        self.latest = handle.getValueState("latest", "day double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows)).sort_values(["day", "seq"], kind="stable")
        last = self.latest.get()[0] if self.latest.exists() else float("-inf")
        known: dict[str, list] = {}
        out = []

        def state(who: str) -> list:
            if who not in known:
                known[who] = json.loads(self.states.getValue((who,))[0]) if self.states.containsKey((who,)) else self.system.new()
            return known[who]

        for r in data.itertuples(index=False):
            if not r.day >= last:  # earlier, or null
                out.append((key[0], "late", r.seq, r.a, r.b, None, None, None))
                continue
            last = r.day
            a, b = state(r.a), state(r.b)
            p = self.system.expected(a, b)
            self.system.play(a, b, r.outcome, r.day if self.timed else None)
            out.append((key[0], "bout", r.seq, r.a, r.b, p, self.system.rating(a), self.system.rating(b)))
        for who, s in known.items():
            self.states.updateValue((who,), (json.dumps(s),))
        if last > float("-inf"):
            self.latest.update((last,))
        yield pd.DataFrame(out, columns=[f.strip().split()[0] for f in PLAYED.split(",")])

    def close(self) -> None:
        pass


def rate_stream(bouts: DataFrame, system, timed: bool = True) -> DataFrame:
    """Played bouts with the ratings after them. The session needs ``STATE_STORE`` as its state store provider."""
    rows = bouts.where("a <> b and outcome is not null").select("league", "seq", "a", "b", F.col("outcome").cast("double").alias("outcome"), (F.unix_micros(F.col("ts").cast("timestamp")) / 8.64e10).alias("day"))
    return rows.groupBy("league").transformWithStateInPandas(_Replay(system, timed), PLAYED, "Append", "None")


def running_points(bouts: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Points for and against per competitor and tumbling window of a stream with a watermark."""
    from boutworks.functions.outcomes import unit_score

    a = unit_score(F.col("score_a"), F.col("score_b"), F.col("outcome"))
    b = unit_score(F.col("score_b"), F.col("score_a"), 1 - F.col("outcome"))
    side = lambda who, mine, theirs: F.struct(F.col(who).alias("competitor"), mine.alias("mine"), theirs.alias("theirs"))
    both = bouts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).select("league", "ts", F.explode(F.array(side("a", a, b), side("b", b, a))).alias("s"))
    return both.groupBy(F.window("ts", window).alias("w"), "league", F.col("s.competitor").alias("competitor")).agg(F.sum("s.mine").alias("pts_for"), F.sum("s.theirs").alias("pts_against")).select("league", "competitor", F.col("w.start").alias("window_start"), "pts_for", "pts_against")
