"""Streams over stored bouts that end by themselves: each run takes what is new, and the sink is a table in the shared folder."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutworks.runtime import work_path
from boutworks.streaming.periods import PeriodRatings
from boutworks.streaming.ratings import STATE_STORE, rate_stream, running_points

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def _state_store(spark: SparkSession):
    """The state store that maps per key need, for the queries started inside."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class Inbox:
    """A folder of bouts that blocks are added to, and a stream over it that goes on from its checkpoint."""

    def __init__(self, spark: SparkSession, schema, transform) -> None:
        self.spark, self.schema, self.transform = spark, schema, transform
        self.path, self.sink, self.checkpoint = (work_path(spark, f"stream-{part}") for part in ("in", "out", "checkpoint"))

    def put(self, block: DataFrame) -> None:
        block.write.mode("append").parquet(self.path)

    def run(self) -> None:
        """Take all that is new, and stop."""
        rows = self.transform(self.spark.readStream.schema(self.schema).parquet(self.path))
        self.out_schema = rows.schema
        with _state_store(self.spark):
            rows.writeStream.format("parquet").option("path", self.sink).option("checkpointLocation", self.checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.out_schema).parquet(self.sink)


def played_in_blocks(bouts: DataFrame, system, blocks: list) -> DataFrame:
    """``rate_stream`` over ``bouts`` that arrive in blocks (conditions), each taken by a run of its own from the checkpoint of the one before."""
    inbox = Inbox(bouts.sparkSession, bouts.schema, lambda rows: rate_stream(rows, system))
    for block in blocks:
        inbox.put(bouts.where(block))
        inbox.run()
    return inbox.table()


def last_ratings(played: DataFrame) -> DataFrame:
    """(league, competitor, rating) after each competitor's last played bout."""
    side = lambda c: F.struct(F.col(c).alias("competitor"), F.col(f"rating_{c}").alias("rating"))
    both = played.where("kind = 'bout'").select("league", "seq", F.explode(F.array(side("a"), side("b"))).alias("s"))
    return both.groupBy("league", F.col("s.competitor").alias("competitor")).agg(F.max_by("s.rating", "seq").alias("rating"))


def points_stream(bouts: DataFrame) -> DataFrame:
    """``running_points`` of the days that the watermark has closed."""
    inbox = Inbox(bouts.sparkSession, bouts.schema, running_points)
    inbox.put(bouts)
    inbox.run()
    return inbox.table()


def periods_in_blocks(bouts: DataFrame, system, days: float, delay: str, blocks: list) -> DataFrame:
    """Ratings by the periods that the watermark has closed, of ``bouts`` that arrive in blocks; each block is a run of its own."""
    spark = bouts.sparkSession
    inbox, rated = work_path(spark, "stream-in"), PeriodRatings(work_path(spark, "stream-periods"), system, days, delay)
    for block in blocks:
        bouts.where(block).write.mode("append").parquet(inbox)
        rated.start(spark.readStream.schema(bouts.schema).parquet(inbox)).awaitTermination()
    return rated.ratings(spark)
