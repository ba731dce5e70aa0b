"""Quality rules with an isolation forest over their statistics.

``rule_statistics`` counts per document in one vectorised pass, without a
shuffle. ``fit_forest`` joins the counts of all documents with all labels, deals
every labelled good row to random-split trees that Spark grows side by side, and
sets the score threshold from the scores of all labelled rows by prefix sums;
``apply_rules`` scores every document by its mean path length. Trees split inside
the range of all labelled rows.

Each tree gets a random share of the good rows, as the method has it: ``TREE_ROWS``
or, where there are more, a ``TREES``-th of them, so that no row is in no tree. Trees
end at a depth of 14, where a leaf counts its rows, so the forest is bounded.

Defined cases: null text has no words; a document without words fails the base
rule; without labelled rows of both classes the forest rejects nothing; labels
that are null or name no document are ignored, and a repeated doc_id counts once
in the fit. Input columns named like an output are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutworks.llm._batches import IS_SPACE, append_columns, codes_of, joined, spans_array, text_array, word_spans
from boutworks.operators.sequence import running_sums
from boutworks.runtime import staged

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Trees, and good rows that each gets at least, if there are as many.
TREES, TREE_ROWS = 200, 1024
SEED = 17

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
FEATURES = ["f_symbols", "f_lines", "f_repeats", "f_length"]
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets])


def _repeats(codes: np.ndarray, row: np.ndarray, n_rows: int, n_codes: int) -> np.ndarray:
    """Words of each row inside a 3-word window that occurs again in the row."""
    n = len(codes)
    if n < 3:
        return np.zeros(n_rows, dtype=np.int64)
    at = np.flatnonzero(row[2:] == row[:-2])
    wide, tall = max(1, int(n_codes).bit_length()), max(1, int(n_rows).bit_length())
    if 3 * wide + tall <= 63:
        key = ((row[at] << wide | codes[at]) << wide | codes[at + 1]) << wide | codes[at + 2]
    else:
        key = np.unique(codes[at] * n_codes + codes[at + 1], return_inverse=True)[1]
        key = np.unique(key * n_codes + codes[at + 2], return_inverse=True)[1]
        key = row[at] * (int(key.max(initial=0)) + 1) + key
    order = np.sort(key)
    again = order[1:][order[1:] == order[:-1]]
    hit = np.zeros(n + 1, dtype=np.int32)
    if len(again):
        spot = np.minimum(np.searchsorted(again, key), len(again) - 1)
        found = at[again[spot] == key]
        np.add.at(hit, found, 1)
        np.add.at(hit, found + 3, -1)
    return np.bincount(row[np.cumsum(hit[:-1]) > 0], minlength=n_rows)


def _dup_lines(flat: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word that equal an earlier line of their row, and lines with a word."""
    n_rows = len(offsets) - 1
    if not len(flat):
        return np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64)
    breaks = np.flatnonzero(flat == 0x0A)
    heads = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks[breaks + 1 < len(flat)] + 1)
    # a line feed belongs to the line before it and is left out of the comparison
    tails = np.append(heads[1:], len(flat))
    ends = np.where(flat[tails - 1] == 0x0A, tails - 1, tails)
    has = np.diff(np.concatenate([np.searchsorted(starts, heads), [len(starts)]])) > 0
    heads, ends = heads[has], ends[has]
    row = np.searchsorted(offsets, heads, side="right") - 1
    codes, distinct = codes_of(spans_array(flat, heads, ends))
    key = np.unique(row * max(1, len(distinct)) + codes)
    lines = np.bincount(row, minlength=n_rows)
    return lines - np.bincount(key // max(1, len(distinct)), minlength=n_rows), lines


def _count(part: pa.RecordBatch, text_col: str) -> list[pa.Array]:
    flat, offsets = joined(text_array(part.column(text_col)))
    n_rows = part.num_rows
    starts, ends, row = word_spans(flat, offsets)
    codes, distinct = codes_of(spans_array(flat, starts, ends))
    dup, lines = _dup_lines(flat, offsets, starts)
    found = [
        np.bincount(row, minlength=n_rows),
        _per_row(((flat & 0xC0) != 0x80) & ~IS_SPACE[flat], offsets),
        _per_row(_SYMBOL[flat], offsets),
        dup,
        _repeats(codes, row, n_rows, len(distinct)),
        lines,
    ]
    return [pa.array(x.astype(np.int64)) for x in found]


def rule_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the counts of ``COUNTS``."""
    return append_columns(df, text_col, [T.StructField(c, T.LongType()) for c in COUNTS], lambda part: _count(part, text_col))


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Square roots of ratios, and the mean word length; a row without words is all zero."""
    x = {k: np.asarray(v, dtype=np.float64) for k, v in counts.items()}
    words, lines, chars = (np.maximum(x[k], 1) for k in ("n_words", "n_lines", "word_chars"))
    ratios = [x["n_symbols"] / chars, x["n_dup_lines"] / lines, x["n_repeat_words"] / words]
    return np.column_stack([*map(np.sqrt, ratios), x["word_chars"] / words])


@dataclass
class Forest:
    """Flat arrays of all trees; a leaf has feature -1 and holds its path length."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    roots: np.ndarray
    tree_rows: int
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected path length): near 1 for anomalies."""
        total = np.zeros(len(x))
        for root in self.roots.tolist():
            at = np.full(len(x), root)
            live = np.arange(len(x))
            while len(live):
                node = at[live]
                live = live[self.feature[node] >= 0]
                node = at[live]
                at[live] = self.left[node] + (x[live, self.feature[node]] >= self.split[node])
            total += self.split[at]
        return np.exp2(-total / max(1, len(self.roots)) / max(_expected(self.tree_rows), 1e-9))


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _grow_tree(rows: np.ndarray, low: np.ndarray, high: np.ndarray, limit: int, rng: np.random.Generator) -> tuple[list[int], list[float], list[int]]:
    """Features, splits and left children of one tree over ``rows``; the root is node 0, a right child follows its left one.

    A split draws a feature and a value inside the node's part of the range, so
    that a value which ``rows`` never take ends in an empty leaf near the root.
    """
    feature, split, left = [-1], [0.0], [-1]
    todo = [(0, rows, low, high, 0)]
    while todo:
        at, rows, low, high, depth = todo.pop()
        if len(rows) < 2 or depth >= limit:
            split[at] = depth + _expected(len(rows))
            continue
        f = int(rng.integers(rows.shape[1]))
        cut = rng.uniform(low[f], high[f])
        feature[at], split[at], left[at] = f, cut, len(feature)
        feature += [-1, -1]
        split += [0.0, 0.0]
        left += [-1, -1]
        side = rows[:, f] >= cut
        below, above = high.copy(), low.copy()
        below[f] = above[f] = cut
        todo += [(left[at], rows[~side], low, below, depth + 1), (left[at] + 1, rows[side], above, high, depth + 1)]
    return feature, split, left


def _limit(tree_rows: int) -> int:
    return math.ceil(math.log2(max(2, tree_rows))) + 4


def _widened(box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    margin = 0.1 * (box[1] - box[0]) + 1e-9
    return box[0] - margin, box[1] + margin


def _planted(trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], tree_rows: int) -> Forest:
    """The trees in one set of arrays."""
    sizes = [len(f) for f, _, _ in trees]
    roots = np.cumsum([0, *sizes])[: len(trees)].astype(np.int64)
    whole = lambda k, kind: np.concatenate([np.zeros(0, kind), *[np.asarray(t[k], kind) for t in trees]])
    return Forest(whole(0, np.int64), whole(1, np.float64), whole(2, np.int64) + np.repeat(roots, sizes), roots, tree_rows, np.inf)


def grow_forest(x: np.ndarray, box: np.ndarray | None = None, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
    """Trees of random splits inside ``box`` over subsamples of ``x``, which is in memory; ``fit_forest`` grows them in Spark."""
    rng = np.random.default_rng(seed)
    grown = []
    if len(x):
        low, high = _widened(np.array([x.min(axis=0), x.max(axis=0)]) if box is None else box)
        for _ in range(trees):
            grown.append(_grow_tree(x[rng.choice(len(x), min(tree_rows, len(x)), replace=False)], low, high, _limit(tree_rows), rng))
    return _planted(grown, min(tree_rows, max(1, len(x))))


def _judged(n_words, n_repeat_words):
    """Whether the base rule lets a row pass; columns or arrays."""
    return (n_words >= MIN_WORDS) & (100 * n_repeat_words <= MAX_REPEAT_PERCENT * n_words)


def labelled_rows(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, ``good`` and the features of every labelled document that passes the base rule; counts are joined, not texts."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    both = counted.select("doc_id", *COUNTS).join(known, "doc_id")
    least = both.groupBy("doc_id").agg(F.min(F.struct(*COUNTS, "quality")).alias("s")).select("doc_id", "s.*")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features({c: batch.column(c).to_numpy() for c in COUNTS})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("good"), *[pa.array(c) for c in x.T]], names=["doc_id", "good", *FEATURES])

    judged = least.where(_judged(F.col("n_words"), F.col("n_repeat_words"))).withColumn("good", F.col("quality") > 0).drop("quality")
    doc_id = T.StructField("doc_id", judged.schema["doc_id"].dataType)
    return judged.mapInArrow(run, T.StructType([doc_id, T.StructField("good", T.BooleanType()), *[T.StructField(c, T.DoubleType()) for c in FEATURES]]))


def dealt_to_trees(good: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """``tree`` and the features of ``n`` rows, each in as many different trees as give every tree ``TREE_ROWS``, in one at least."""
    copies = min(TREES, math.ceil(TREES * TREE_ROWS / n))
    steps = [s for s in range(1, TREES) if math.gcd(s, TREES) == 1]  # such a step comes back to no tree before it has met all
    key = F.xxhash64("doc_id", F.lit(seed))
    first, step = F.pmod(key, F.lit(TREES)), F.element_at(F.array(*map(F.lit, steps)), (F.pmod(F.shiftrightunsigned(key, 32), F.lit(len(steps))) + 1).cast("int"))
    trees = F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda j: F.pmod(first + j * step, F.lit(TREES)).cast("int"))
    return good.select(F.explode(trees).alias("tree"), *FEATURES)


def fit_counts(counted: DataFrame, labels: DataFrame, seed: int = SEED) -> Forest:
    """``fit_forest`` from the counts that ``rule_statistics`` gave."""
    rows = staged(labelled_rows(counted, labels), "labelled")
    bad = F.count(F.when(~F.col("good"), 1)).alias("bad")
    ends = rows.agg(F.count(F.when(F.col("good"), 1)).alias("good"), bad, *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in FEATURES]).first()
    if not ends["good"] or not ends["bad"]:
        return _planted([], 1)
    low, high = _widened(np.array([[ends[f"{k}_{c}"] for c in FEATURES] for k in ("min", "max")]))

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        x = np.column_stack([table.column(c).to_numpy() for c in FEATURES])
        tree = _grow_tree(x[np.lexsort(x.T)], low, high, _limit(TREE_ROWS), np.random.default_rng([seed, key[0].as_py()]))
        arrays = [np.asarray(a, kind).tobytes() for a, kind in zip(tree, (np.int8, np.float64, np.int32), strict=True)]
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "rows": pa.array([len(x)]), **{c: pa.array([a], pa.binary()) for c, a in zip(("feature", "split", "left"), arrays, strict=True)}})

    dealt = dealt_to_trees(rows.where("good"), ends["good"], seed)
    # one row a tree, of bounded depth
    grown = dealt.groupBy("tree").applyInArrow(grow, "tree int, rows long, feature binary, split binary, left binary").orderBy("tree").collect()
    trees = [(np.frombuffer(t.feature, np.int8), np.frombuffer(t.split, np.float64), np.frombuffer(t.left, np.int32)) for t in grown]
    forest = _planted(trees, round(sum(t.rows for t in grown) / len(grown)))
    forest.threshold = calibrate(rows, forest, ends["good"], ends["bad"])
    return forest


def calibrate(rows: DataFrame, forest: Forest, n_good: int, n_bad: int) -> float:
    """The score that best parts good from bad rows (share of good kept plus share of bad rejected).

    Of equally good scores the highest counts, so that doubt keeps a document.
    Prefix sums run over the distinct scores of all ``rows``, range-sorted by Spark.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = forest.scores(np.column_stack([batch.column(c).to_numpy() for c in FEATURES]))
            yield pa.RecordBatch.from_arrays([pa.array(score), batch.column("good")], names=["score", "good"])

    scored = rows.mapInArrow(run, "score double, good boolean")
    counts = scored.groupBy("score").agg(F.count(F.when(F.col("good"), 1)).alias("own"), F.count(F.when(~F.col("good"), 1)).alias("bad"))
    sums = staged(running_sums(counts.withColumn("here", F.col("own")), ["score"], ["own", "bad"]), "score-sums")
    wide = lambda c, n: F.col(c).cast("decimal(19,0)") * F.lit(n).cast("decimal(18,0)")
    best = sums.where("here > 0").agg(F.max(F.struct((wide("own", n_bad) - wide("bad", n_good)).alias("gain"), "score")).alias("top")).first().top.score
    above = sums.where(F.col("score") > best).agg(F.min("score")).first()[0]
    return float(best) if above is None else float((best + above) / 2)


def fit_forest(documents: DataFrame, labels: DataFrame, seed: int = SEED) -> Forest:
    """The forest and its threshold, from the statistics of all labelled documents; the driver gets trees, never rows."""
    return fit_counts(rule_statistics(documents.select("doc_id", "text")), labels, seed)


_VERDICT = [T.StructField("base_failed", T.BooleanType()), T.StructField("anomaly", T.DoubleType()), T.StructField("kept", T.BooleanType())]


def _verdict(counts: dict[str, np.ndarray], forest: Forest) -> list[pa.Array]:
    failed = ~_judged(counts["n_words"], counts["n_repeat_words"])
    score = forest.scores(features(counts))
    return [pa.array(failed), pa.array(score), pa.array(~failed & (score <= forest.threshold))]


def apply_rules(df: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """``df`` with the counts, base_failed, anomaly (the score) and kept."""

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        made = _count(part, text_col)
        return [*made, *_verdict({c: a.to_numpy() for c, a in zip(COUNTS, made, strict=True)}, forest)]

    return append_columns(df, text_col, [*[T.StructField(c, T.LongType()) for c in COUNTS], *_VERDICT], compute)


def verdicts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rule counts and verdict of every document; counted once, for the fit and the verdict."""
    counted = staged(rule_statistics(documents.select("doc_id", "text")).select("doc_id", *COUNTS), "rule-counts")
    forest = fit_counts(counted, labels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _verdict({c: batch.column(c).to_numpy() for c in COUNTS}, forest)
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, *[f.name for f in _VERDICT]])

    return counted.mapInArrow(run, T.StructType([*counted.schema.fields, *_VERDICT])).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "anomaly"
    )
