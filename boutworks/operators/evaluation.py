"""Evaluation of predicted bouts: confusion, metrics, calibration, cohorts, thresholds.

A history has seq, a, b, predicted (double, may be null) and label (a, b, draw or
null). Bouts without a prediction or label are skipped. Where ``by`` names columns,
all is done for each of their values, in the same jobs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutworks.functions.outcomes import actual_winner, predicted_label, predicted_loser, predicted_winner
from boutworks.operators.sequence import running_sums, segmented_sums
from boutworks.runtime import staged


def judged(history: DataFrame) -> DataFrame:
    return history.where("predicted is not null and label is not null")


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def _cells(lower: float, upper: float) -> dict[str, Column]:
    p, y = predicted_label(F.col("predicted"), lower, upper), F.col("label")
    return {
        "tp": ((p == "draw") & (y == "draw")) | ((p == "a") & (y == "a")),
        "fp": ((p == "draw") & (y != "draw")) | ((p == "a") & (y == "b")),
        "tn": (p == "b") & (y == "b"),
        "fn": ((p != "draw") & (y == "draw")) | ((p == "b") & (y == "a")),
    }


def confusion(history: DataFrame, lower: float = 0.45, upper: float = 0.55, by: tuple[str, ...] = ()) -> DataFrame:
    """One row: tp, fp, tn, fn."""
    return judged(history).groupBy(*by).agg(*[F.coalesce(_count(c), F.lit(0)).alias(k) for k, c in _cells(lower, upper).items()])


def _ratio(top: Column, bottom: Column, empty: float) -> Column:
    return F.when(bottom == 0, F.lit(empty)).otherwise(top / bottom)


def metrics(history: DataFrame, lower: float = 0.5, upper: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy (0 when empty), precision, recall and f1 (NaN on a zero denominator) beside the counts."""
    nan = float("nan")
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = confusion(history, lower, upper, by).withColumns({"accuracy": _ratio(tp + tn, tp + fp + tn + fn, 0.0), "precision": _ratio(tp, tp + fp, nan), "recall": _ratio(tp, tp + fn, nan)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(F.isnan(p) | F.isnan(r) | (p + r == 0), nan).otherwise(2 * p * r / (p + r)))


def metrics_with_draws(history: DataFrame, lower: float = 0.33, upper: float = 0.66) -> DataFrame:
    """Three-class accuracy, f1 over the counts, and how draws do; 0 on zero denominators."""
    p, y = predicted_label(F.col("predicted"), lower, upper), F.col("label")
    more = {"n": F.lit(True), "right": p == y, "true_draw": (p == "draw") & (y == "draw"), "false_draw": (p == "draw") & (y != "draw"), "draws": y == "draw"}
    one = judged(history).agg(*[F.coalesce(_count(c), F.lit(0)).alias(k) for k, c in {**_cells(lower, upper), **more}.items()])
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return one.select(
        "tp", "fp", "tn", "fn", "true_draw", "false_draw",
        _ratio(F.col("right"), F.col("n"), 0.0).alias("accuracy"), _ratio(tp, tp + fp, 0.0).alias("precision"), _ratio(tp, tp + fn, 0.0).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn, 0.0).alias("f1"), _ratio(F.col("draws"), F.col("n"), 0.0).alias("draw_rate"),
        _ratio(F.col("true_draw"), F.col("draws"), 0.0).alias("draw_accuracy"),
    )


def report(history: DataFrame, lower: float = 0.5, upper: float = 0.5) -> DataFrame:
    """Per bout the predicted sides, the probability in percent and whether the winner was right; no winner twice is right."""
    p, a, b = F.col("predicted"), F.col("a"), F.col("b")
    winner = actual_winner(F.col("label"))
    actual = F.when(winner == "a", F.lower(a)).when(winner == "b", F.lower(b))
    named = predicted_winner(p, a, b, lower, upper)
    return history.where(p.isNotNull()).select("seq", named.alias("predicted_winner"), predicted_loser(p, a, b, lower, upper).alias("predicted_loser"), (p * 100).alias("probability"), winner.alias("actual_winner"), named.eqNullSafe(actual).alias("correct"))


def _value(label: Column) -> Column:
    return F.when(label == "a", 1.0).when(label == "draw", 0.5).otherwise(0.0)


def calibration_pairs(history: DataFrame) -> DataFrame:
    return judged(history).select(_value(F.col("label")).alias("y"), F.col("predicted").alias("p"))


def bin_of(p: Column, bins: int) -> Column:
    """Equal-width bin, edges k * (1 / bins), the last one closed."""
    edges = F.array(*[F.lit(k * (1.0 / bins)) for k in range(bins + 1)])
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.size(F.filter(edges, lambda e: e <= p)) - 1))


def calibration_bins(history: DataFrame, bins: int = 10) -> DataFrame:
    """Mean prediction and outcome of each bin that has bouts."""
    return calibration_pairs(history).groupBy(bin_of(F.col("p"), bins).alias("bin")).agg(F.avg("p").alias("mean_predicted"), F.avg("y").alias("mean_outcome"), F.count("*").alias("n"))


def density(history: DataFrame, bins: int = 20) -> DataFrame:
    """Histogram of the predictions over [0, 1]; densities integrate to 1."""
    pairs = calibration_pairs(history)
    total = pairs.agg(F.count("*").alias("total"))
    return pairs.groupBy(bin_of(F.col("p"), bins).alias("bin")).count().crossJoin(total).select("bin", (F.col("count") * bins / F.col("total")).alias("density"))


def losses(history: DataFrame) -> DataFrame:
    """Log-loss and Brier score."""
    y, p = F.col("y"), F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("p")))
    return calibration_pairs(history).agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"), F.avg((F.col("p") - y) * (F.col("p") - y)).alias("brier"), F.count("*").alias("n"))


def summary(history: DataFrame) -> DataFrame:
    return history.where("predicted is not null").agg(F.min("predicted").alias("low"), F.max("predicted").alias("high"), F.avg("predicted").alias("mean"), _count(F.col("predicted") > 0.5).alias("above"), F.count("*").alias("n"))


def cohorts(history: DataFrame, earlier: DataFrame | None = None, bin_size: int = 5, lower: float = 0.5, upper: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy by the smaller number of earlier bouts of the two sides, in bins.

    Every bout counts as experience, also a skipped one. ``earlier`` (a, b) seeds the counts.
    """
    if isinstance(bin_size, bool) or bin_size <= 0:
        raise ValueError("bin_size must be a positive integer")
    both = history.select(*by, "seq", F.explode(F.array("a", "b")).alias("who"), F.lit(1).cast("long").alias("k"))
    seen = segmented_sums(both, [*by, "who"], ["seq"], ["k"], current=False)
    if earlier is not None:
        seeds = earlier.select(F.explode(F.array("a", "b")).alias("who")).groupBy("who").agg(F.count("*").alias("seed"))
        seen = seen.join(seeds, "who", "left").withColumn("k", F.col("k") + F.coalesce("seed", F.lit(0)))
    least = seen.groupBy(*by, "seq").agg(F.min("k").alias("k"))
    right = predicted_label(F.col("predicted"), lower, upper) == F.col("label")
    cut = judged(history).join(least, [*by, "seq"]).groupBy(*by, F.floor(F.col("k") / bin_size).cast("long").alias("bin")).agg(_count(right).alias("correct"), F.count("*").alias("total"))
    return cut.select(*by, "bin", "correct", "total", (F.col("correct") / F.col("total")).alias("accuracy"), (F.col("bin") * bin_size).alias("min_bouts"), (F.col("bin") * bin_size + bin_size - 1).alias("max_bouts"))


def best_cuts(history: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The exact threshold sweep: one row with the numbers of distinct predictions below the two cuts, and what is correct.

    Lower cut i and upper cut j lie between distinct predictions; ties go to the smallest i, then the smallest j.
    Prefix sums run over distinct predictions, range-sorted by Spark, not over bouts. ``near`` has the predictions on
    both sides of the cuts as (k, value), k from 1.
    """
    y = F.col("label")
    groups = judged(history).groupBy(*by, "predicted").agg(_count(y == "a").alias("a"), _count(y == "b").alias("b"), _count(y == "draw").alias("d"))
    keys = list(by) or ["_all"]
    counted = groups.withColumns({"k": F.lit(1).cast("long"), **({} if by else {"_all": F.lit(0)})})
    sums = staged(segmented_sums(counted, keys, ["predicted"], ["a", "b", "d", "k"], part=True), "sums")
    none = sums.select(*keys).distinct().select(*keys, F.lit(None).cast("double").alias("predicted"), *[F.lit(0).cast("long").alias(c) for c in ("a", "b", "d", "k")], F.lit(-1).alias("_part"))
    cuts = sums.unionByName(none)
    # the best upper cut at or after each lower one: inside the range, or in a later range
    own = F.struct((F.col("d") - F.col("a")).alias("score"), (-F.col("k")).alias("neg"))
    tops = cuts.groupBy(*keys, "_part").agg(F.max(own).alias("top"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    after = tops.select(*keys, "_part", F.max("top").over(later).alias("after"))
    # from above: a frame that only grows costs a step per row
    down = Window.partitionBy(*keys, "_part").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scored = cuts.select(*keys, "_part", "a", "k", "b", "d", F.max(own).over(down).alias("here")).join(after, [*keys, "_part"]).withColumn("up", F.greatest("here", "after"))
    best = F.max(F.struct((F.col("b") - F.col("d") + F.col("up.score")).alias("correct"), (-F.col("k")).alias("neg_i"), (-F.col("up.neg")).alias("j")))
    top = scored.groupBy(*keys).agg(best.alias("t"), F.max("a").alias("all_a"))
    top = top.select(*keys, (F.col("t.correct") + F.col("all_a")).alias("correct"), (-F.col("t.neg_i")).alias("below_lower"), F.col("t.j").alias("below_upper"))
    beside = cuts.join(top, keys).where("k > 0 and k in (below_lower, below_lower + 1, below_upper, below_upper + 1)")
    near = beside.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", F.col("predicted").alias("value")))).alias("near"))  # four at most
    return top.join(near, keys, "left").select(*by, "correct", "below_lower", "below_upper", "near")


def thresholds(history: DataFrame, initial: tuple[float, float] = (0.5, 0.5), by: tuple[str, ...] = ()) -> list[tuple]:
    """(values of ``by``..., accuracy, lower, upper) for each: the best cuts, or ``initial`` where nothing does better."""
    right = _count(predicted_label(F.col("predicted"), *initial) == F.col("label"))
    start = judged(history).groupBy(*by).agg(right.alias("start"), F.count("*").alias("total"))
    best = best_cuts(history, by)
    both = start.join(best, list(by)) if by else start.crossJoin(best)  # one row each
    return [(*(r[c] for c in by), *_cut_values(r, initial)) for r in both.collect()]


def _cut_values(r, initial: tuple[float, float]) -> tuple[float, float, float]:
    if r["start"] >= r["correct"]:
        return r["start"] / r["total"], *initial
    near = {k: v for k, v in r["near"]}

    def value(k: int, lower: bool) -> float:
        if k not in near:
            return math.nextafter(near[k + 1], -math.inf)
        if k + 1 not in near:
            return math.nextafter(near[k], math.inf)
        mid = (near[k] + near[k + 1]) / 2
        return mid if near[k] < mid < near[k + 1] else near[k + 1] if lower else near[k]

    return r["correct"] / r["total"], value(r["below_lower"], True), value(r["below_upper"], False)


def optimize_thresholds(history: DataFrame, initial: tuple[float, float] = (0.5, 0.5)) -> tuple[float, tuple[float, float]]:
    """(accuracy, (lower, upper)): the best cuts, or ``initial`` where nothing does better."""
    for accuracy, lower, upper in thresholds(history, initial):
        return accuracy, (lower, upper)
    return 0.0, initial


def random_search(history: DataFrame, trials: int = 1000, seed: int = 0) -> DataFrame:
    """The best of random threshold pairs between the smallest and largest prediction, drawn by a hash of trial and seed.

    The cuts are sorted among the distinct predictions, and prefix sums give what each has below it, so a trial costs two rows.
    """
    pairs = judged(history)
    y = F.col("label")
    groups = pairs.groupBy("predicted").agg(_count(y == "a").alias("a"), _count(y == "b").alias("b"), _count(y == "draw").alias("d"))
    ends = pairs.agg(F.min("predicted").alias("low"), F.max("predicted").alias("high"), _count(y == "a").alias("all_a"))
    share = lambda side: F.conv(F.substring(F.md5(F.concat_ws(":", F.col("trial").cast("string"), F.lit(side), F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    value = lambda side: F.col("low") + (F.col("high") - F.col("low")) * share(side)
    # one row of bounds beside the trials
    drawn = pairs.sparkSession.range(trials).select(F.col("id").alias("trial")).crossJoin(F.broadcast(ends)).select("trial", "all_a", value("x").alias("x"), value("y").alias("y"))
    cuts = staged(drawn.select("trial", "all_a", F.least("x", "y").alias("lower"), F.greatest("x", "y").alias("upper")), "drawn-cuts")
    none = [F.lit(0).cast("long").alias(c) for c in "abd"]
    # a lower cut comes before an equal prediction, an upper one after it
    mixed = groups.select("predicted", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("trial"), *"abd")
    for kind, c in ((0, "lower"), (2, "upper")):
        mixed = mixed.unionByName(cuts.select(F.col(c).alias("predicted"), F.lit(kind).alias("kind"), "trial", *none))
    below = running_sums(mixed, ["predicted", "kind", "trial"], ["a", "b", "d"]).where("trial is not null")
    at = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    sums = below.groupBy("trial").agg(at(0, "b").alias("b_low"), at(0, "d").alias("d_low"), at(2, "a").alias("a_up"), at(2, "d").alias("d_up"))
    scored = cuts.join(sums, "trial").select("trial", "lower", "upper", (F.col("b_low") + F.col("all_a") - F.col("a_up") + F.col("d_up") - F.col("d_low")).alias("correct"))
    return scored.orderBy(F.desc("correct"), "trial").limit(1)


@dataclass
class Evaluation:
    """What systems trained on the earlier bouts say of the later ones whose competitors they know."""

    #: system, n judged bouts, the columns of ``metrics``, ``accuracy_opt`` (also as ``optimized_accuracy``) at the best thresholds, and these.
    metrics: DataFrame
    #: system, place, competitor, rating: the best competitors.
    top: DataFrame
    #: system and the columns of ``cohorts``: accuracy by earlier bouts.
    cohorts: DataFrame
    #: system, seq, a, b, outcome, predicted, label.
    history: DataFrame


def evaluate(bouts: DataFrame, systems, ratio: float = 0.3, timed: bool = True, top: int = 5, bin_size: int = 5) -> Evaluation:
    """Evaluation of one system or several, step systems and fits alike, in one pass.

    All step systems are replayed by one job, fits share the pair table, and predictions, metrics, threshold sweep and
    cohorts are grouped by system, so that the jobs don't grow with the number of systems.
    """
    from boutworks.functions.outcomes import label_of_number
    from boutworks.operators.fold import ratings_of, replay_many, said_by
    from boutworks.operators.models import Fit, fit_all
    from boutworks.operators.splits import time_split

    systems = list(systems) if isinstance(systems, (list, tuple)) else [systems]
    split = staged(time_split(bouts, ratio), "split")
    train = split.where("split = 'train'")
    steps, fitted = [s for s in systems if not isinstance(s, Fit)], [s for s in systems if isinstance(s, Fit)]
    null = lambda kind: F.lit(None).cast(kind)
    rated = None
    if steps:
        rated = ratings_of(replay_many(train, steps, timed), "system").select("system", "league", "competitor", "rating", null("double").alias("scale"), "state")
    if fitted:
        own = fit_all(train, fitted).select("system", "league", "competitor", "rating", "scale", null("string").alias("state"))
        rated = own if rated is None else rated.unionByName(own)
    rated = staged(rated, "ratings")
    fixtures = split.where("split = 'test'").select("league", "seq", "a", "b", "outcome")
    side = lambda c: rated.select("system", "league", F.col("competitor").alias(c), F.col("rating").alias(f"_r{c}"), F.col("scale").alias(f"_k{c}"), F.col("state").alias(f"_s{c}"))
    both = fixtures.join(side("a"), ["league", "a"]).join(side("b"), ["system", "league", "b"])
    said = null("double")
    for s in systems:
        if isinstance(s, Fit):
            said = F.when(F.col("system") == s.name, s.expected_column(*[F.col(c) for c in ("_ra", "_rb", "_ka", "_kb")])).otherwise(said)
        elif hasattr(s, "expected_column"):
            said = F.when(F.col("system") == s.name, s.expected_column(F.col("_sa"), F.col("_sb"))).otherwise(said)
    columns = ["system", "seq", "a", "b", "outcome", "predicted"]
    history = both.withColumn("predicted", said).select(*columns)
    for s in steps:
        if not hasattr(s, "expected_column"):  # a system of the user's
            own = said_by(both.where(F.col("system") == s.name), s).select(*columns)
            history = history.where(F.col("system") != s.name).unionByName(own)
    history = staged(history.withColumn("label", label_of_number(F.col("outcome"))), "history")
    by = ("system",)
    spark = bouts.sparkSession
    cuts = spark.createDataFrame(thresholds(history, by=by), "system string, accuracy_opt double, lower double, upper double")
    every = spark.createDataFrame([(s.name,) for s in systems], "system string")
    found = metrics(history, by=by).join(judged(history).groupBy("system").agg(F.count("*").alias("n")), "system")
    made = every.join(found, "system", "left").join(cuts, "system", "left")
    counts = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n", "tp", "fp", "tn", "fn")}
    ends = {c: F.coalesce(c, F.lit(v)) for c, v in (("accuracy", 0.0), ("precision", math.nan), ("recall", math.nan), ("f1", math.nan), ("accuracy_opt", 0.0), ("lower", 0.5), ("upper", 0.5))}
    made = made.withColumns({**counts, **ends}).withColumn("optimized_accuracy", F.col("accuracy_opt"))
    place = F.row_number().over(Window.partitionBy("system").orderBy(F.desc(F.round("rating", 6)), "competitor"))
    return Evaluation(
        made.select("system", "n", "tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "f1", "accuracy_opt", "optimized_accuracy", "lower", "upper"),
        rated.select("system", place.alias("place"), "competitor", "rating").where(F.col("place") <= top),
        cohorts(history, train, bin_size, by=by), history,
    )
