"""Team schedules in CSV as bouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ["start_date", "home_team", "away_team", "home_points", "away_points"]
OPTIONAL = ["home_conference", "away_conference", "neutral_site", "conference_game", "venue"]


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def read_seasons(spark: SparkSession, paths: dict[int, str], reader=read_schedule) -> tuple[DataFrame, list[int]]:
    """The finished games of all seasons, with ``season``, and the seasons without any.

    Every season is read and checked before anything is returned: one that can't be read, or lacks a column, is an error
    that names all such seasons, so a short result is never stored as a whole one. No games at all are an error too.
    """
    failed, empty, out = {}, [], None
    for season, path in sorted(paths.items()):
        try:
            games = normalise(reader(spark, path)).withColumn("season", F.lit(season))
            if games.isEmpty():
                empty.append(season)
                continue
        except Exception as e:  # reported below
            failed[season] = str(e).splitlines()[0][:200]
            continue
        out = games if out is None else out.unionByName(games, allowMissingColumns=True)
    if failed:
        raise RuntimeError("seasons that can't be read: " + "; ".join(f"{k} ({v})" for k, v in failed.items()))
    if out is None:
        raise ValueError("there are no games")
    return out, empty


def normalise(raw: DataFrame) -> DataFrame:
    """The known columns under one name; display names win over names, unfinished games go.

    A missing required column is an error before anything runs.
    """
    has = set(raw.columns)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in has]) if any(n in has for n in names) else None
    made = {"start_date": pick("start_date", "date"), **{f"{s}_team": pick(f"{s}_team", f"{s}_display_name", f"{s}_name") for s in ("home", "away")}, **{f"{s}_points": pick(f"{s}_points", f"{s}_score") for s in ("home", "away")}}
    if missing := [k for k, v in made.items() if v is None]:
        raise ValueError(f"the schedule lacks {', '.join(missing)}")
    rows = raw.where(F.lower(F.col("status_type_completed").cast("string")) == "true") if "status_type_completed" in has else raw
    return rows.select(*[v.alias(k) for k, v in made.items()], *[c for c in OPTIONAL if c in has])


def bouts(schedule: DataFrame) -> DataFrame:
    """a (home), b (away), outcome, ts, scores and attributes of the games with both scores."""
    home, away = F.col("home_points").try_cast("double"), F.col("away_points").try_cast("double")
    extra = [c for c in OPTIONAL if c in schedule.columns]
    attributes = F.map_filter(F.create_map(*[x for c in ["home_points", "away_points", *extra] for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull())
    return schedule.where(home.isNotNull() & away.isNotNull()).select(
        F.col("home_team").alias("a"), F.col("away_team").alias("b"),
        F.when(home > away, 1.0).when(home < away, 0.0).otherwise(0.5).alias("outcome"),
        F.col("start_date").try_cast("timestamp").alias("ts"), home.alias("score_a"), away.alias("score_b"), attributes.alias("attributes"),
    )
