"""Train and test splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutworks.operators.sequence import with_sequence


def _ratio(ratio: float) -> float:
    if not 0 <= ratio <= 1:
        raise ValueError("the test ratio must be between 0 and 1")
    return ratio


def time_split(bouts: DataFrame, ratio: float = 0.2) -> DataFrame:
    """``bouts`` with ``split``: the earliest int(n * (1 - ratio)) timed rows train, as do rows without a time."""
    _ratio(ratio)
    timed = bouts.where("ts is not null")
    n = timed.count()
    if not n:
        return random_split(bouts, ratio)
    k = int(n * (1 - ratio))
    ranked = with_sequence(timed, ["ts", "seq"], "_at")
    done = ranked.withColumn("split", F.when(F.col("_at") < k, "train").otherwise("test")).drop("_at")
    return done.unionByName(bouts.where("ts is null").withColumn("split", F.lit("train")))


def _hashed(column: str, seed: int):
    return F.md5(F.concat_ws(":", F.col(column).cast("string"), F.lit(str(seed))).cast("binary"))


def random_split(bouts: DataFrame, ratio: float = 0.2, seed: int = 0) -> DataFrame:
    """An exact share of the rows, in the order of a hash of seq, is test."""
    _ratio(ratio)
    n = bouts.count()
    k = int(n * (1 - ratio))
    ranked = with_sequence(bouts.withColumn("_h", _hashed("seq", seed)), ["_h", "seq"], "_at")
    return ranked.withColumn("split", F.when(F.col("_at") < k, "train").otherwise("test")).drop("_at", "_h")


def competitor_split(bouts: DataFrame, ratio: float = 0.2, seed: int = 0) -> DataFrame:
    """A share of the competitors is held out; bouts with any of them test, the others train."""
    _ratio(ratio)
    who = bouts.select(F.explode(F.array("a", "b")).alias("who")).distinct().withColumn("_h", _hashed("who", seed))
    k = int(who.count() * (1 - ratio))
    held = with_sequence(who, ["_h", "who"], "_at").where(F.col("_at") >= k).select("who")
    out = bouts
    for c in ("a", "b"):
        out = out.join(held.select(F.col("who").alias(c), F.lit(True).alias(f"_held_{c}")), c, "left")
    test = F.coalesce("_held_a", F.lit(False)) | F.coalesce("_held_b", F.lit(False))
    return out.withColumn("split", F.when(test, "test").otherwise("train")).drop("_held_a", "_held_b")
