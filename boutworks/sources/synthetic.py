"""Generated competitors and bouts; the same seed gives the same rows on any cluster."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(seed: int, *keys: Column | str) -> Column:
    """A number in (0, 1) from a hash of seed and keys, whatever the partitioning and the engine."""
    said = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]).cast("binary"))
    return (F.conv(F.substring(said, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _normal(seed: int, *keys: Column | str) -> Column:
    return F.sqrt(-2 * F.log(_uniform(seed, *keys))) * F.cos(2 * math.pi * _uniform(seed + 1, *keys))


def competitors(spark: SparkSession, n: int, mean: float = 1500.0, deviation: float = 300.0, kind: str = "normal", seed: int = 42) -> DataFrame:
    u = _uniform(seed, "id")
    skills = {
        "normal": mean + deviation * _normal(seed, "id"),
        "uniform": mean + deviation * math.sqrt(3) * (2 * u - 1),
        "pareto": (F.pow(1 - u, -1 / 3) - 1) * deviation + mean - deviation,
    }
    if kind not in skills:
        raise ValueError(f"unknown distribution {kind}")
    return spark.range(n).select("id", F.concat(F.lit("competitor_"), F.col("id").cast("string")).alias("competitor"), skills[kind].alias("skill"))


def bouts(spark: SparkSession, n: int, competitors_n: int, span_days: int = 365, noise: float = 100.0, draw_probability: float = 0.1, seed: int = 42, **skill) -> DataFrame:
    """seq, a, b, outcome, ts and the true skills: close noisy differences draw with a given probability."""
    if competitors_n < 2:
        raise ValueError("a bout needs two competitors")
    who = competitors(spark, competitors_n, seed=seed, **skill)
    first = F.floor(_uniform(seed + 10, "seq") * competitors_n)
    second = F.pmod(first + 1 + F.floor(_uniform(seed + 11, "seq") * (competitors_n - 1)), F.lit(competitors_n))
    picks = spark.range(n).withColumnRenamed("id", "seq").select("seq", first.alias("i"), second.alias("j"))
    side = lambda k, name: who.select(F.col("id").alias(k), F.col("competitor").alias(name), F.col("skill").alias(f"skill_{name}"))
    rows = picks.join(side("i", "a"), "i").join(side("j", "b"), "j")
    apart = F.col("skill_a") - F.col("skill_b") + noise * _normal(seed + 12, "seq")
    draw = (F.abs(apart) < noise) & (_uniform(seed + 14, "seq") < draw_probability)
    ts = F.timestamp_seconds(F.lit(1_577_836_800) + F.floor(_uniform(seed + 15, "seq") * span_days * 86_400))
    return rows.select("seq", F.lit("all").alias("league"), "a", "b", F.when(draw, 0.5).when(apart > 0, 1.0).otherwise(0.0).alias("outcome"), ts.alias("ts"), "skill_a", "skill_b", (F.col("skill_a") - F.col("skill_b")).alias("skill_diff"))
