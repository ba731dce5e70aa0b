"""Chess games in PGN text as bouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A game begins with this header, whatever the line ends of the file.
_NEXT_GAME = '[Event "'


def read_pgn(spark: SparkSession, path: str) -> DataFrame:
    """One game per row in ``game``, without the beginning of its first header, whatever the size of the files."""
    return spark.read.option("lineSep", _NEXT_GAME).text(path).where("value <> ''").select(F.col("value").alias("game"))


def _header(name: str) -> Column:
    found = F.regexp_extract("game", rf'\[{name} "([^"]*)"\]', 1)
    return F.when(found != "", found)


def games(raw: DataFrame, limit: int | None = None) -> DataFrame:
    """a, b, outcome, ts and attributes of the games with a known result; ``limit`` counts those."""
    when = F.concat_ws(" ", _header("UTCDate"), _header("UTCTime"))
    ts = F.coalesce(F.try_to_timestamp(when, F.lit("yyyy.MM.dd HH:mm:ss")), F.try_to_timestamp(when, F.lit("yyyy-MM-dd HH:mm:ss")))
    result = _header("Result")
    outcome = F.when(result == "1-0", 1.0).when(result == "0-1", 0.0).when(result == "1/2-1/2", 0.5)
    rating = lambda name: F.coalesce(_header(name).try_cast("int"), F.lit(1500)).cast("string")
    attributes = F.map_filter(
        F.create_map(
            F.lit("white_elo"), rating("WhiteElo"), F.lit("black_elo"), rating("BlackElo"), F.lit("time_control"), _header("TimeControl"),
            F.lit("eco"), _header("ECO"), F.lit("opening"), _header("Opening"), F.lit("termination"), _header("Termination"),
            F.lit("game_id"), F.element_at(F.split(_header("Site"), "/"), -1),
        ),
        lambda k, v: v.isNotNull(),
    )
    out = raw.select(_header("White").alias("a"), _header("Black").alias("b"), outcome.alias("outcome"), ts.alias("ts"), attributes.alias("attributes")).where("a is not null and b is not null and outcome is not null")
    return out.limit(limit) if limit else out
