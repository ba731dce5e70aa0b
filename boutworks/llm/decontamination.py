"""Benchmark decontamination by suffix arrays over the training text.

A shard is a byte-bounded chunk of whole documents inside a task. Its word
suffixes are sorted by their leading words; every test suffix is binary-searched
in every shard, which gives all verbatim occurrences with their places. Matches
that continue along one alignment are joined into the longest match. Documents
never leave their task, so nothing is shuffled.

The test set is broadcast in blocks of bounded size, one at a time: a block is
collected, its pass over the rows is written to the shared folder, and its
broadcast is destroyed before the next block is collected. Each pass adds to the
hits so far. A test set of one block needs no such table.

Defined cases: null text has no words; an item without words never occurs; items
without an id cause hits but aren't listed; a repeated item_id is listed once;
repeated rows have the same hits each; a text longer than a shard is a shard of its
own; without items nothing is hit, and an empty table has an empty result. Input
columns named like an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutworks.llm._batches import append_columns, binary_from, codes_of, gather, joined, spans_array, text_array, word_spans
from boutworks.runtime import discard, work_path

WINDOW = 10
#: Text bytes of the test set in one broadcast.
BLOCK_BYTES = 32 << 20
#: Pairs of an occurrence in a chunk and a use in the test set that are looked at together.
PLACES = 1 << 20

#: Lower-cases A-Z; every ASCII byte outside letters and digits separates words.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)
_FOLD_TABLE = np.frombuffer(_FOLD, dtype=np.uint8)


@dataclass
class TestSet:
    """Distinct windows of the items, packed for comparison."""

    words: pa.Array  # distinct words; code 1 is the first
    bits: int
    low: np.ndarray  # (windows, columns) smallest and largest packed suffix of a match
    high: np.ndarray
    size: np.ndarray  # words of each window
    uses: np.ndarray  # for each window its places: starts into item and offset
    use_item: np.ndarray
    use_at: np.ndarray
    names: list[str | None]

    @property
    def columns(self) -> int:
        return self.low.shape[1]


def _pack(codes: np.ndarray, bits: int, length: int) -> np.ndarray:
    """``length`` codes from every position on, packed into 63-bit columns; zero past the end."""
    per = max(1, 62 // bits)
    n = len(codes)
    padded = np.concatenate([codes, np.zeros(length, dtype=np.int64)])
    out = np.zeros((n, -(-length // per)), dtype=np.int64)
    for k in range(length):
        out[:, k // per] = (out[:, k // per] << bits) | padded[k : k + n]
    last = length % per
    if last:
        out[:, -1] <<= bits * (per - last)
    return out


def build_test_set(rows: list[tuple[str | None, str | None]], window: int = WINDOW) -> TestSet:
    """Windows of (item_id, text) rows."""
    texts = pa.array([(t or "").encode() for _, t in rows], pa.large_binary())
    flat, offsets = joined(texts)
    flat = _FOLD_TABLE[flat]
    starts, ends, row = word_spans(flat, offsets)
    codes, words = codes_of(spans_array(flat, starts, ends))
    codes = codes + 1
    bits = max(1, int(len(words) + 1).bit_length())
    first = np.searchsorted(row, np.arange(len(rows)))
    count = np.bincount(row, minlength=len(rows))
    at = np.arange(len(codes)) - first[row] if len(codes) else np.zeros(0, np.int64)
    size = np.minimum(window, count[row])
    whole = at + size <= count[row]
    spot, size, item, at = np.flatnonzero(whole), size[whole], row[whole], at[whole]
    # codes after the end of a short window are blanked out
    low, high = np.zeros((len(spot), -(-window // max(1, 62 // bits))), np.int64), None
    high = low.copy()
    for length in np.unique(size).tolist():
        own = size == length
        grid = codes[spot[own][:, None] + np.arange(length)]
        packed = [_pack_rows(np.pad(grid, ((0, 0), (0, window - length)), constant_values=fill), bits) for fill in (0, (1 << bits) - 1)]
        low[own], high[own] = packed
    key = np.column_stack([low, size])
    distinct, first_use, back = np.unique(key, axis=0, return_index=True, return_inverse=True) if len(key) else (key, np.zeros(0, int), np.zeros(0, int))
    back = back.ravel()
    order = np.argsort(back, kind="stable")
    uses = np.concatenate([[0], np.cumsum(np.bincount(back, minlength=len(distinct)))]).astype(np.int64)
    return TestSet(words, bits, low[first_use], high[first_use], size[first_use], uses, item[order], at[order], [None if i is None else str(i) for i, _ in rows])


def _pack_rows(grid: np.ndarray, bits: int) -> np.ndarray:
    per = max(1, 62 // bits)
    length = grid.shape[1]
    out = np.zeros((len(grid), -(-length // per)), dtype=np.int64)
    for k in range(length):
        out[:, k // per] = (out[:, k // per] << bits) | grid[:, k]
    if length % per:
        out[:, -1] <<= bits * (per - length % per)
    return out


def _less(a: np.ndarray, b: np.ndarray, equal: bool) -> np.ndarray:
    """Row-wise lexicographic a < b, or a <= b."""
    result = np.full(len(a), equal)
    for k in range(a.shape[1] - 1, -1, -1):
        result = (a[:, k] < b[:, k]) | ((a[:, k] == b[:, k]) & result)
    return result


def _search(keys: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of all ``wanted`` rows at once in the sorted rows ``keys``."""
    low = np.zeros(len(wanted), dtype=np.int64)
    high = np.full(len(wanted), len(keys), dtype=np.int64)
    while (low < high).any():
        open_ = low < high
        mid = (low + high) >> 1
        at = keys[np.minimum(mid, len(keys) - 1)]
        below = _less(at, wanted, right)
        low = np.where(open_ & below, mid + 1, low)
        high = np.where(open_ & ~below, mid, high)
    return low


@dataclass
class _Found:
    n_words: np.ndarray
    spans: list[list[dict]]
    items: list[list[str]]
    longest: np.ndarray


def _match(texts: pa.Array, test: TestSet, window: int) -> _Found:
    n_rows = len(texts)
    flat, offsets = joined(texts)
    flat = _FOLD_TABLE[flat]
    starts, ends, row = word_spans(flat, offsets)
    coded, distinct = codes_of(spans_array(flat, starts, ends))
    n_words = np.bincount(row, minlength=n_rows)
    found = _Found(n_words, [[] for _ in range(n_rows)], [[] for _ in range(n_rows)], np.zeros(n_rows, dtype=np.int64))
    if not len(coded) or not len(test.low):
        return found
    known = pc.fill_null(pc.index_in(distinct, test.words), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    # a zero after each row keeps matches inside it; words outside the test set are zero too
    place = np.arange(len(coded)) + row
    codes = np.zeros(len(coded) + n_rows, dtype=np.int64)
    codes[place] = known[coded]
    suffix = np.flatnonzero(codes)
    keys = _pack(codes, test.bits, window)[suffix]
    order = np.lexsort(keys.T[::-1])
    suffix, keys = suffix[order], keys[order]
    # windows whose first word isn't in the shard have no suffix there
    per = max(1, 62 // test.bits)
    present = np.zeros(1 << test.bits, dtype=bool)
    present[known] = True
    tried = np.flatnonzero(present[test.low[:, 0] >> (test.bits * (per - 1))])
    low, high = _search(keys, test.low[tried], False), _search(keys, test.high[tried], True)
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return found
    times = (high - low)[hit]
    which, at = np.repeat(tried[hit], times), suffix[gather(low[hit], times)]
    cover = np.zeros(len(codes) + 1, dtype=np.int32)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + test.size[which], -1)
    inside = np.concatenate([[0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0]])
    edges = np.diff(inside)
    doc_of = np.searchsorted(np.cumsum(n_words + 1), np.flatnonzero(edges == 1), side="right")
    first = np.concatenate([[0], np.cumsum(n_words + 1)])
    for d, a, b in zip(doc_of.tolist(), np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
        found.spans[d].append({"start": a - int(first[d]), "end": b - int(first[d])})
    _by_items(found, test, which, at, first)
    return found


def _by_items(found: _Found, test: TestSet, which: np.ndarray, at: np.ndarray, first: np.ndarray) -> None:
    """The items of each document and its longest match, from the places ``at`` where windows ``which`` occur.

    Items are taken in blocks of ``PLACES`` places (occurrences times uses) at most, or one item, so that a window that
    very many items share costs no more memory than others.
    """
    windows, code = np.unique(which, return_inverse=True)
    uses = np.diff(test.uses)[windows]
    use = gather(test.uses[windows], uses)
    owner, times = np.repeat(np.arange(len(windows)), uses), np.bincount(code, minlength=len(windows))
    cost = np.cumsum(np.bincount(test.use_item[use], weights=times[owner], minlength=len(test.names)))
    block = np.concatenate([[0], cost[:-1]]) // PLACES
    by_window = np.argsort(code, kind="stable")
    starts = np.concatenate([[0], np.cumsum(times)])
    doc_at = np.searchsorted(first, at, side="right") - 1
    for b in np.unique(block[test.use_item[use]]).tolist():
        mine = np.flatnonzero(block[test.use_item[use]] == b)
        spot = by_window[gather(starts[owner[mine]], times[owner[mine]])]
        own = np.repeat(use[mine], times[owner[mine]])
        item, place, doc = test.use_item[own], at[spot], doc_at[spot]
        for key in np.unique(doc * len(test.names) + item).tolist():
            name = test.names[key % len(test.names)]
            if name is not None:
                found.items[key // len(test.names)].append(name)
        shift, size = place - test.use_at[own], test.size[which[spot]]
        order = np.lexsort((place, shift, item))
        item, shift, place, size, doc = item[order], shift[order], place[order], size[order], doc[order]
        fresh = np.concatenate([[True], (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (place[1:] != place[:-1] + 1)])
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))
        np.maximum.at(found.longest, doc, place - place[head] + size)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", SPANS),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
    T.StructField("longest_match", T.LongType()),
]
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _join_spans(a: list[dict], b: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(a + b, key=lambda s: (s["start"], s["end"])):
        if out and s["start"] <= out[-1]["end"]:
            out[-1] = {"start": out[-1]["start"], "end": max(out[-1]["end"], s["end"])}
        else:
            out.append(dict(s))
    return out


def _test_rows(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))


def _blocks_of(benchmark: DataFrame, block_bytes: int) -> int:
    """Into how many blocks of about ``block_bytes`` the test rows are dealt."""
    return -(-(_test_rows(benchmark).agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0) // block_bytes)


def _test_block(benchmark: DataFrame, k: int, blocks: int) -> list[tuple[str | None, str]]:
    """The test rows of one block; only these are on the driver."""
    rows = _test_rows(benchmark)
    part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else rows
    return sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] is None, r))


def find_matches(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``documents`` with n_words, hit_spans (word positions), hit_items (sorted) and longest_match (words)."""
    spark = documents.sparkSession
    out, path = documents, None
    blocks = _blocks_of(benchmark, block_bytes)
    for k in range(max(1, blocks)):
        shared = spark.sparkContext.broadcast(build_test_set(_test_block(benchmark, k, blocks), window))
        out = _pass(out, shared, text_col, window, again=k > 0)
        if blocks > 1:
            before, path = path, work_path(spark, "hits")
            out.write.parquet(path)
            shared.destroy()
            out = spark.read.schema(out.schema).parquet(path)
            if before:
                discard(spark, before)
    return out


def _pass(df: DataFrame, shared, text_col: str, window: int, again: bool) -> DataFrame:
    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        found = _match(text_array(part.column(text_col)), shared.value, window)
        spans, items, longest = found.spans, found.items, found.longest
        if again:
            spans = [_join_spans(a, b) for a, b in zip(part.column("hit_spans").to_pylist(), spans, strict=True)]
            items = [a + b for a, b in zip(part.column("hit_items").to_pylist(), items, strict=True)]
            longest = np.maximum(longest, part.column("longest_match").to_numpy())
        items = [sorted(set(x)) for x in items]
        return [pa.array(found.n_words), pa.array(spans, _ARROW_SPANS), pa.array(items, pa.list_(pa.string())), pa.array(longest)]

    return append_columns(df, text_col, _FIELDS, compute)


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The hits of every document."""
    found = find_matches(documents.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
        "longest_match",
    )


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``documents`` without those in which a window of a test item occurs; columns unchanged."""
    found = find_matches(documents, benchmark, text_col)
    kept = found.where(F.size("hit_spans") == 0)
    return kept.select(*[c for c in documents.columns if c.lower() not in {f.name.lower() for f in _FIELDS}])


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), i AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM i),
h AS (
  SELECT s.r, s.p, s.n, i.item_id
  FROM (SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') AS g
        FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n)) s
  JOIN i ON i.g = s.g AND i.n = s.n
), hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS q FROM h) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h WHERE item_id IS NOT NULL) GROUP BY r),
runs AS (SELECT r, item_id, n, p, p - row_number() OVER (PARTITION BY r, item_id, n, p - q ORDER BY p) AS run, p - q AS shift
       FROM (SELECT h.r, h.item_id, h.n, h.p, j.q FROM h JOIN (
               SELECT item_id, least(10, len(w)) AS n, q, array_to_string(w[q : q + least(10, len(w)) - 1], ' ') AS g
               FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS q FROM b WHERE len(w) > 0)) j
               ON j.item_id = h.item_id AND j.n = h.n
             JOIN d ON d.r = h.r AND array_to_string(d.w[h.p : h.p + h.n - 1], ' ') = j.g)),
longest AS (SELECT r, max(k) AS longest_match FROM (SELECT r, max(n) + count(*) - 1 AS k FROM runs GROUP BY r, item_id, n, shift, run) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items.x, '')) AS items_sha256,
       coalesce(hit.n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest.longest_match, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r) LEFT JOIN longest USING (r)
"""
