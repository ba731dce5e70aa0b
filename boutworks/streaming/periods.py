"""Rating periods of a stream: a period counts as soon as the watermark has passed its end.

The open periods are a streaming aggregation, one row of state for two competitors
that met in one. What it gives out, whole periods only, goes through the same joins
and sums as stored periods do, from the ratings that the batch before left. Each
micro-batch with closed periods writes its ratings under its own number, so one that
runs again after a failure replaces what it wrote and starts from the same ratings.

A bout whose period has been closed is left out by the watermark; the query's
progress counts such rows (``numRowsDroppedByWatermark``). Bouts of oneself and
rows without outcome or time are left out too, as in batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from boutworks.operators.periods import displayed, empty_states, period_of, rate_results, results_of
from boutworks.operators.systems import Glicko, Glicko2
from boutworks.runtime import discard, finished

#: Tables of ratings that are kept: the newest, and those that a failed batch would start from again.
KEPT = 2


class PeriodRatings:
    """Ratings below ``path``, moved on by streams that start from its checkpoint."""

    def __init__(self, path: str, system: Glicko | Glicko2, days: float = 1.0, delay: str = "1 day") -> None:
        if days <= 0:
            raise ValueError("a period must be positive")
        self.path, self.system, self.days, self.delay = path, system, days, delay

    def closed(self, bouts: DataFrame) -> DataFrame:
        """Results of the same two in one period, once the watermark has passed its end."""
        window = F.window("ts", f"{round(self.days * 8.64e10)} microseconds").alias("w")
        sums = results_of(bouts).withWatermark("ts", self.delay).groupBy(window, "league", "a", "b").agg(F.sum("n").alias("n"), F.sum("score").alias("score"))
        return sums.select("league", "a", "b", "n", "score", period_of(F.col("w.start"), self.days).alias("period"))

    def start(self, bouts: DataFrame, **trigger) -> StreamingQuery:
        """Rate what comes; by default all that is there, and stop."""
        out = self.closed(bouts).writeStream.outputMode("append").option("checkpointLocation", f"{self.path}/checkpoint")
        return out.foreachBatch(self._rate).trigger(**(trigger or {"availableNow": True})).start()

    def _rate(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mine = f"{self.path}/states/{number:012d}"
        earlier = [p for p in finished(spark, f"{self.path}/states/*") if p.rsplit("/", 1)[1] < f"{number:012d}"]
        rate_results(batch, self.system, self._read(spark, earlier[-1]) if earlier else None, mine)
        for path in earlier[: 1 - KEPT]:
            discard(spark, path)

    def _read(self, spark: SparkSession, path: str) -> DataFrame:
        return spark.read.schema(empty_states(spark, self.system).schema).parquet(path)

    def ratings(self, spark: SparkSession) -> DataFrame:
        """As ``rate_periods``, after the periods closed so far."""
        done = finished(spark, f"{self.path}/states/*")
        return displayed(self._read(spark, done[-1]) if done else empty_states(spark, self.system), self.system)
