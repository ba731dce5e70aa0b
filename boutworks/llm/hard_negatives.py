"""Hard negatives of anchors by norm-bucketed inner-product search.

All rows are quantised to integers, sorted by norm by a range partitioning, and packed
into buckets of ``BUCKET_ROWS`` neighbours, largest norms first. A bucket's largest
norm times an anchor's norm bounds every score in it (Cauchy-Schwarz), so a task
going down its buckets leaves out, for each anchor, those that can't reach the
running kth score, or the lower limit of a positive's window.

Anchors are sent to the buckets in blocks: ``BLOCK_ROWS`` of them, and no more than
``BLOCK_BYTES``, are broadcast at a time, whatever their number, and the broadcast is
destroyed before the next one. First pass: the best rows of the same label, per task and
then in all. Second pass: for the windows these positives open, the best rows of other
labels. What a task returns is bounded by the answers asked for, not by its rows.

Scores are exact: products of blocks are taken in double precision where norms prove
that no sum reaches 2^53, else in 64-bit integers.

Defined cases: rows without id, label or vector and rows with a null or non-finite
component take no part, nor do rows whose squared norm reaches 2^62, since their
scores have no 64 bits; a shorter vector counts as followed by zeros; rows equal in id,
label and vector count once, other rows with one id are rows by themselves; ties go
by the smaller id; an anchor without positives, or a positive without negatives, has
no rows; an empty table has an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutworks.runtime import staged

BUCKET_ROWS = 1024
#: Anchors in one broadcast.
BLOCK_ROWS, BLOCK_BYTES = 16_384, 32 << 20
#: Anchors multiplied with a bucket at once.
TILE = 256
#: Rows of a range of norms, at most so many as the session has shuffle partitions.
RANGE_ROWS = 4 * BUCKET_ROWS
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH, OUT_OF = 80, 100, 100
SCALE = 256.0
EXACT, LARGEST = float(2**53), float(2**62)
_NONE = np.iinfo(np.int64).min


@dataclass
class Block:
    """Rows of vectors: ids, labels, squared norms and quantised components."""

    ids: np.ndarray
    labels: np.ndarray
    norms: np.ndarray
    vectors: np.ndarray

    def tile(self, a: int, b: int) -> Block:
        return Block(self.ids[a:b], self.labels[a:b], self.norms[a:b], self.vectors[a:b])


def quantised(rows: DataFrame, vec_id: str, label: Column, vector: str, scale: float) -> DataFrame:
    """(id, label, q, norm) of the rows that take part."""
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    valid = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    size = F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + F.floor(x.cast("double") * scale).cast("double") * F.floor(x.cast("double") * scale).cast("double"))
    used = rows.where(F.col(vec_id).isNotNull() & label.isNotNull() & valid).where(size < LARGEST)
    return used.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(whole, lambda x: x.cast("long")).alias("q"), size.alias("norm")).distinct()


PACKED = "part int, bucket int, ids binary, labels binary, norms binary, width int, vectors binary"


def buckets(vectors: DataFrame, rows: int) -> DataFrame:
    """Rows sorted by falling norm and packed, one row per bucket; ranges of norms are partitions."""
    spark = vectors.sparkSession
    parts = max(1, min(-(-rows // RANGE_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-rows // (64 * BUCKET_ROWS)))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = number = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, BUCKET_ROWS - n)
                held.append(part)
                at, n = at + part.num_rows, n + part.num_rows
                if n == BUCKET_ROWS:
                    yield _packed(held, number)
                    held, n, number = [], 0, number + 1
        if held:
            yield _packed(held, number)

    order = [F.desc("norm"), F.col("id")]
    return vectors.repartitionByRange(parts, *order, "label").sortWithinPartitions(*order, "label").mapInArrow(pack, PACKED)


def _packed(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).combine_chunks()
    q = table.column("q").combine_chunks() if isinstance(table.column("q"), pa.ChunkedArray) else table.column("q")
    offsets, flat = np.asarray(q.offsets), q.values.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(offsets)
    width = int(sizes.max(initial=0))
    vectors = np.zeros((len(sizes), width), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    vectors[row, np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat[offsets[0] : offsets[-1]]
    if vectors.size and np.abs(vectors).max() < 2**31:
        vectors = vectors.astype(np.int32)
    column = lambda c, kind: table.column(c).to_numpy().astype(kind).tobytes()
    values = [[0], [number], [column("id", np.int64)], [column("label", np.int64)], [column("norm", np.float64)], [width], [vectors.tobytes()]]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[f.split()[0] for f in PACKED.split(", ")])


def _unpacked(row: dict) -> Block:
    ids = np.frombuffer(row["ids"], np.int64)
    cells = len(ids) * row["width"]
    kind = np.int32 if len(row["vectors"]) == 4 * cells else np.int64
    return Block(ids, np.frombuffer(row["labels"], np.int64), np.frombuffer(row["norms"], np.float64), np.frombuffer(row["vectors"], kind).reshape(len(ids), row["width"]))


def _scores(a: Block, b: Block) -> np.ndarray:
    """Inner products, exact, as 64-bit integers."""
    width = min(a.vectors.shape[1], b.vectors.shape[1])
    x, y = a.vectors[:, :width], b.vectors[:, :width]
    if math.sqrt(float(a.norms.max(initial=0)) * float(b.norms.max(initial=0))) < EXACT / 4:
        return np.rint(x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x.astype(np.int64) @ y.astype(np.int64).T


def _bound(a: np.ndarray, b: float) -> np.ndarray:
    """No score of rows with these squared norms is above it."""
    return np.sqrt(a * b) * (1 + 1e-9) + 1


def _best(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of each owner's k best, by falling score and rising id."""
    order = np.lexsort((ids, -score.astype(np.float64) if len(score) and abs(score).max() < EXACT else -score, owner))
    own = owner[order]
    head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    place = np.arange(len(own)) - np.repeat(head, np.diff(np.append(head, len(own)))) if len(own) else np.zeros(0, np.int64)
    return order[place < k]


class _Running:
    """The best k of each window so far."""

    def __init__(self, windows: int, k: int) -> None:
        self.k = k
        self.owner, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        self.kth = np.full(windows, _NONE, np.int64)

    def add(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(owner):
            return
        owner, score, ids = np.concatenate([self.owner, owner]), np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        kept = _best(owner, score, ids, self.k)
        self.owner, self.score, self.ids = owner[kept], score[kept], ids[kept]
        n = np.bincount(self.owner, minlength=len(self.kth))
        least = np.full(len(self.kth), np.iinfo(np.int64).max, np.int64)
        np.minimum.at(least, self.owner, self.score)
        full = n >= self.k
        self.kth[full] = least[full]


@dataclass
class Anchors:
    """A block of anchors with the windows each has: (low, high) scores; none are open in the first pass."""

    rows: Block
    same: bool
    window: np.ndarray  # the anchor of each window, rising
    low: np.ndarray
    high: np.ndarray

    def search(self, found: Iterable[Block], k: int) -> _Running:
        """The best k rows of each window, among rows of the same label, or of others."""
        best = _Running(len(self.window), k)
        for bucket in found:
            most = float(bucket.norms.max(initial=0))
            for a in range(0, len(self.rows.ids), TILE):
                tile = self.rows.tile(a, a + TILE)
                first, last = np.searchsorted(self.window, [a, a + len(tile.ids)])
                own, need = self.window[first:last] - a, np.maximum(self.low[first:last], best.kth[first:last])
                open_ = _bound(tile.norms[own], most) >= need
                if not open_.any():
                    continue
                least, top = np.full(len(tile.ids), np.iinfo(np.int64).max, np.int64), np.full(len(tile.ids), _NONE, np.int64)
                np.minimum.at(least, own[open_], need[open_])
                np.maximum.at(top, own[open_], self.high[first:last][open_])
                score = _scores(tile, bucket)
                ok = (score >= least[:, None]) & (score <= top[:, None]) & ((bucket.labels == tile.labels[:, None]) == self.same)
                if self.same:  # the anchor itself is one of the rows; a row with its id and other values isn't
                    i, j = np.nonzero((bucket.ids == tile.ids[:, None]) & ok)
                    for x, y in zip(i.tolist(), j.tolist(), strict=True):
                        ok[x, y] = not _equal(tile.vectors[x], bucket.vectors[y])
                i, j = np.nonzero(ok)
                if not len(i):
                    continue
                # each hit for each open window of its anchor
                wide = np.bincount(own, minlength=len(tile.ids))
                start = np.concatenate([[0], np.cumsum(wide)[:-1]])
                times = wide[i]
                w = np.repeat(start[i], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                i, j = np.repeat(i, times), np.repeat(j, times)
                s = score[i, j]
                fits = open_[w] & (s >= need[w]) & (s <= self.high[first:last][w])
                best.add(w[fits] + first, s[fits], bucket.ids[j[fits]])
        return best


def _equal(a: np.ndarray, b: np.ndarray) -> bool:
    n = min(len(a), len(b))
    return bool((a[:n] == b[:n]).all() and not a[n:].any() and not b[n:].any())


def _searched(table: DataFrame, anchors: Anchors, k: int) -> DataFrame:
    """(window, score, id) best of each task."""
    sent = table.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[Block]:
            for batch in batches:
                for k_ in range(batch.num_rows):
                    yield _unpacked(batch.slice(k_, 1).to_pylist()[0])

        best = sent.value.search(found(), k)
        for a in range(0, len(best.owner), 10_000):
            part = slice(a, a + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[part], pa.int64()) for x in (best.owner, best.score, best.ids)], names=["window", "score", "id"])

    out = table.mapInArrow(run, "window long, score long, id long")
    best = Window.partitionBy("window").orderBy(F.desc("score"), "id")
    out = staged(out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "searched")
    sent.destroy()
    return out


def _stack(rows: list) -> Block:
    width = max((len(r["q"]) for r in rows), default=0)
    vectors = np.zeros((len(rows), width), dtype=np.int64)
    for k, r in enumerate(rows):
        vectors[k, : len(r["q"])] = r["q"]
    column = lambda c, kind: np.array([r[c] for r in rows], dtype=kind)
    return Block(column("id", np.int64), column("label", np.int64), column("norm", np.float64), vectors)


def _blocks(anchors: DataFrame) -> Iterator[Block]:
    """The anchors in blocks of bounded size, one after another."""
    held, size = [], 0
    for r in anchors.toLocalIterator():
        cost = 8 * len(r["q"]) + 64
        if held and (len(held) == BLOCK_ROWS or size + cost > BLOCK_BYTES):
            yield _stack(held)
            held, size = [], 0
        held.append(r)
        size += cost
    if held:
        yield _stack(held)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(
    rows: DataFrame, is_anchor: Column, label: Column | None = None, vec_id: str = "vec_id", vector: str = "embedding", scale: float = SCALE,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """For each anchor (a condition on ``id``) and each of its best rows of the same label the best rows of other labels
    whose score is at least ``low`` and at most ``high`` hundredths of the positive's.
    """
    if positives < 1 or negatives < 1 or not 0 <= low <= high:
        raise ValueError("positives and negatives must be positive, and low must not be above high")
    spark = rows.sparkSession
    vectors = staged(quantised(rows, vec_id, F.col("label") if label is None else label, vector, scale), "vectors")
    table = staged(buckets(vectors, vectors.count()), "buckets")
    made = None
    for block in _blocks(vectors.where(is_anchor)):
        n = len(block.ids)
        every = Anchors(block, True, np.arange(n), np.full(n, _NONE), np.full(n, np.iinfo(np.int64).max))
        # at most ``positives`` rows for each anchor of the block
        near = sorted(((r["window"], r["rank"], r["id"], r["score"]) for r in _searched(table, every, positives).collect()))
        if not near:
            continue
        window, _, positive, score = (np.array(c, dtype=np.int64) for c in zip(*near, strict=True))
        # exact limits: low * p <= 100 * s <= high * p
        limits = [(-(-low * p // OUT_OF), high * p // OUT_OF) for p in score.tolist()]
        least, most = (np.array(c, dtype=np.int64) for c in zip(*limits, strict=True))
        hits = _searched(table, Anchors(block, False, window, least, most), negatives)
        opened = zip(range(len(window)), block.ids[window].tolist(), positive.tolist(), score.tolist(), strict=True)
        windows = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in zip(*opened, strict=True)], names=["window", "anchor_id", "positive_id", "positive_score"]))
        out = hits.join(windows, "window").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        made = out if made is None else made.unionByName(out)
    return spark.createDataFrame([], RESULT) if made is None else made


#: Whole table by brute force: every anchor with every row.
SQL = """
WITH v AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
