"""Exact repeated substrings by a sparse suffix array over the whole corpus.

Every ``width``-byte window of a text is represented by its minimiser: the
``ANCHOR``-byte string of least hash inside it. Consecutive windows with the same
minimiser form a run, so the suffixes to compare start at about 1.5 % of the
bytes. A suffix whose leading ``ANCHOR`` bytes occur once can't repeat and is
left out; runs that agree in all their bytes, as inside copies, are recognised by
their 128-bit digest and needn't be sorted. All other suffixes, with the bytes
before them, are range-partitioned by sampled splitters on their leading bytes.
Each bucket sorts its suffixes by multikey quicksort and compares neighbours: two
windows at distance o before their anchors are equal if the suffixes share
``width - o`` bytes and the preceding bytes agree in o places. Groups that touch
a bucket's first or last suffix may go on in the next bucket; their windows are
compared across the boundaries by digest.

One run of each kind stands for all its copies in the sort, so a passage that a
third of all documents share costs one suffix per anchor.

Defined cases: null text is empty; an empty table has an empty result; texts under
``width`` bytes lose nothing; a text longer than a chunk is a chunk of its own;
repeated rows, also with equal ids, count as separate places, so both lose what
they share; columns other than the id and text pass through where documented.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutworks.llm._batches import append_columns, binary_from, bound_batches, chunks, gather, joined, text_array
from boutworks.runtime import staged

WIDTH = 200
ANCHOR = 64
_CHUNK = 2 << 20
#: Bits of a place in a chunk, always the same; the other bits are the anchor's hash. A text has under 2 GB.
PLACE_BITS = 31
#: Bytes of suffixes that one bucket sorts.
BUCKET_BYTES = 12 << 20

_RNG = np.random.default_rng(20250707)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _RNG.integers(0, 1 << 62, 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _blend(left: np.ndarray, right: np.ndarray, k: int) -> np.ndarray:
    h = left * _MUL[k]
    h += right
    h ^= h >> np.uint64(31)
    return h


def _hashes(flat: np.ndarray) -> np.ndarray:
    """Hashes of the ANCHOR-byte strings from every byte on."""
    size, h = 1, _BYTE[flat]
    k = 0
    while size < ANCHOR:
        h = _blend(h[:-size], h[size:], k) if len(h) > size else h[:0]
        size, k = size * 2, k + 1
    return h


def runs(flat: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> dict[str, np.ndarray]:
    """Runs of windows with one minimiser: row, first and last window start, anchor, and hashes.

    Places are byte offsets within the row. Of equal hashes the first is least, so equal windows have equal anchors wherever they stand.
    """
    empty = {c: np.zeros(0, np.int64) for c in ("row", "s", "e", "a", "kh", "bh", "ch")}
    span = width - ANCHOR + 1
    if len(flat) < width:
        return empty
    short = _hashes(flat)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = ((short * _MUL[11]) & ~low) | np.arange(len(short), dtype=np.uint64)
    size = 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if span > size:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    anchor = (least & low).astype(np.int64)
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    start = gather(offsets[:-1], counts)
    if not len(start):
        return empty
    row = np.repeat(np.arange(len(counts)), counts)
    at = anchor[start]
    first = np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1])])
    heads = np.flatnonzero(first)
    tails = np.append(heads[1:], len(start)) - 1
    s, e, a, row = start[heads], start[tails], at[heads], row[heads]
    # a run's 128-bit digest is of all its bytes and of the anchor's place in them
    whole = flat.tobytes()
    ends, into = (e + width).tolist(), (a - s).tolist()
    digests = b"".join([xxhash.xxh3_128_digest(whole[x:y], o) for x, y, o in zip(s.tolist(), ends, into, strict=True)])
    digest = np.frombuffer(digests, dtype="<i8").reshape(-1, 2)
    base = offsets[:-1][row]
    return {"row": row, "s": s - base, "e": e - base, "a": a - base, "kh": short[a].view(np.int64), "bh": digest[:, 0], "ch": digest[:, 1]}


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents with two hashes that name a row by its id and text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the second hash folds in the length and the ends' order, so that both must collide at once
    return documents.withColumns({"_r1": F.xxhash64(F.col(id_col), text), "_r2": F.xxhash64(text, F.length(text), F.col(id_col), F.lit(7))})


def _all_runs(keyed: DataFrame, text_col: str, width: int) -> DataFrame:
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col, _CHUNK):
                flat, offsets = joined(text_array(part.column(text_col)))
                r = runs(flat, offsets, width)
                own = [part.column(c).to_numpy()[r["row"]] for c in ("_r1", "_r2")]
                places = [r[c].astype(np.int32) for c in ("s", "e", "a")]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (r["kh"], r["bh"], r["ch"], *own, *places)], names=["kh", "bh", "ch", "_r1", "_r2", "s", "e", "a"])

    return keyed.select("_r1", "_r2", text_col).mapInArrow(scan, "kh long, bh long, ch long, _r1 long, _r2 long, s int, e int, a int")


_CONTEXT = "suffix binary, before binary, weight int, r1 long, r2 long, a int"


def _contexts(rows: DataFrame, text_col: str, width: int) -> DataFrame:
    """The suffix of each listed run, and the bytes before it reversed.

    Equal rows have the same runs: a task gives those of a row once, however often it comes. It remembers the last
    ``SEEN_ROWS`` rows; one that slips through only adds a context that is there already.
    """
    kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], None] = {}
        for batch in batches:
            fresh = []
            for i, key in enumerate(zip(batch.column("_r1").to_pylist(), batch.column("_r2").to_pylist(), strict=True)):
                if key not in seen:
                    fresh.append(i)
                    seen[key] = None
                    if len(seen) > SEEN_ROWS:
                        del seen[next(iter(seen))]
            for part in chunks(batch.take(pa.array(fresh, pa.int64())), text_col, _CHUNK):
                texts = [t or b"" for t in part.column(text_col).cast(pa.large_binary()).to_pylist()]
                found = [
                    (text[run["a"] : run["e"] + width], text[run["s"] : run["a"]][::-1], run["w"], r1, r2, run["a"])
                    for text, r1, r2, open_runs in zip(texts, part.column("_r1").to_pylist(), part.column("_r2").to_pylist(), part.column("open").to_pylist(), strict=True)
                    for run in open_runs
                ]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["suffix", "before", "weight", "r1", "r2", "a"])

    return rows.select("_r1", "_r2", text_col, "open").mapInArrow(cut, _CONTEXT)


def _matrix(strings: list[bytes], width: int) -> np.ndarray:
    """The strings as rows of bytes, padded with zeros to a multiple of 8."""
    wide = -(-width // 8) * 8
    return np.frombuffer(b"".join(s.ljust(wide, b"\0") for s in strings), dtype=np.uint8).reshape(len(strings), wide)


def multikey_order(grid: np.ndarray) -> np.ndarray:
    """The order of the rows: multikey quicksort with 8-byte characters.

    Each step sorts, inside every group that is equal so far, by the next character; rows alone in their group are done.
    """
    n = len(grid)
    order = np.arange(n)
    group = np.zeros(n, dtype=np.int64)  # by place in the order
    keys = np.ascontiguousarray(grid).view(">u8").astype(np.uint64)
    live = np.arange(n)  # places whose group has several rows
    for column in range(keys.shape[1]):
        if not len(live):
            break
        value = keys[order[live], column]
        inner = np.lexsort((value, group[live]))
        order[live] = order[live[inner]]
        value = value[inner]
        own = group[live]
        fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (value[1:] != value[:-1])])
        group[live] = live[np.maximum.accumulate(np.where(fresh, np.arange(len(live)), 0))]
        own = group[live]
        alone = np.concatenate([[True], own[1:] != own[:-1]]) & np.concatenate([own[1:] != own[:-1], [True]])
        live = live[~alone]
    return order


def _common(grid: np.ndarray) -> np.ndarray:
    """Leading bytes that each row but the first shares with the row before."""
    differ = grid[1:] != grid[:-1]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), grid.shape[1])


def repeated_windows(suffixes: list[bytes], before: list[bytes], weight: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """(contexts, width - ANCHOR + 1) booleans: the window o bytes before the anchor occurs again."""
    n, most = len(suffixes), width - ANCHOR
    out = np.zeros((n, most + 1), dtype=bool)
    if not n:
        return out
    right, left = _matrix(suffixes, width), _matrix(before, max(8, most))
    right_order, left_order = multikey_order(right), multikey_order(left)
    right_common, left_common = _common(right[right_order]), _common(left[left_order])
    nearest = width - np.array([len(s) for s in suffixes])
    farthest = np.array([len(b) for b in before])
    right_class, left_class = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for o in range(most + 1):
        own = np.flatnonzero((nearest <= o) & (o <= farthest))
        if not len(own):
            continue
        right_class[right_order[1:]] = np.cumsum(right_common < width - o)
        left_class[left_order[1:]] = np.cumsum(left_common < o)
        right_class[right_order[0]] = left_class[left_order[0]] = 0
        key = right_class[own] * n + left_class[own]
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        total = np.add.reduceat(weight[own[order]], heads)
        out[own[order], o] = np.repeat(total >= 2, np.diff(np.append(heads, len(key))))
    return out


#: Rows whose contexts a task has given and remembers.
SEEN_ROWS = 200_000
_BUCKET = "dest long, packed binary, r1 long, r2 long, s int, e int"
#: A window of an edge group: its digest, whether it is known to repeat, and its place.
_WINDOW = np.dtype([("d", "S16"), ("known", "i1"), ("r1", "<i8"), ("r2", "<i8"), ("s", "<i4")])


def _bucket_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["dest", "packed", "r1", "r2", "s", "e"])


def _sort_bucket(width: int, dests: int):
    """Spans of repeated windows of a bucket; windows of its edge groups go out packed, dealt by digest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if not rows:
            return
        suffixes, before = [r[0] for r in rows], [r[1] for r in rows]
        lead = [s[:ANCHOR] for s in suffixes]
        edges = {min(lead), max(lead)}
        again = repeated_windows(suffixes, before, np.array([r[2] for r in rows], dtype=np.int64), width)
        out: list[tuple] = []
        edge: list[tuple] = []
        witnessed: set[bytes] = set()
        for i, (suffix, prefix, weight, r1, r2, a) in enumerate(rows):
            known = weight > 1  # all windows of the run repeat, and their spans are known
            if not known:
                marks = np.flatnonzero(np.diff(np.concatenate([[0], again[i].astype(np.int8), [0]])))
                out += [(None, None, r1, r2, a - int(far) + 1, a - int(near)) for near, far in zip(marks[::2], marks[1::2], strict=True)]
            if lead[i] in edges:
                string = prefix[::-1] + suffix
                for o in range(width - len(suffix), len(prefix) + 1):
                    at = len(prefix) - o
                    digest = hashlib.blake2b(string[at : at + width], digest_size=16).digest()
                    if not (known or again[i][o]):
                        edge.append((digest, 0, r1, r2, a - o))
                    elif digest not in witnessed:
                        witnessed.add(digest)
                        edge.append((digest, 1, 0, 0, 0))
        yield _bucket_batch(out)
        windows = np.array(edge, dtype=_WINDOW)
        dest = np.array([int.from_bytes(e[0][:8], "little") % dests for e in edge], dtype=np.int64)
        order = np.argsort(dest, kind="stable")
        windows, dest = windows[order], dest[order]
        heads = np.flatnonzero(np.concatenate([[True], dest[1:] != dest[:-1]])) if len(dest) else []
        yield _bucket_batch([(int(dest[x]), windows[x:y].tobytes(), None, None, None, None) for x, y in zip(heads, [*heads[1:], len(dest)], strict=True)])

    return run


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of edge groups that another bucket has too; rows ascend by ``dest``."""

    def found(raw: list[bytes]) -> pa.RecordBatch:
        windows = np.frombuffer(b"".join(raw), dtype=_WINDOW)
        windows = windows[np.argsort(windows["d"], kind="stable")]
        heads = np.flatnonzero(np.concatenate([[True], windows["d"][1:] != windows["d"][:-1]]))
        sizes = np.diff(np.append(heads, len(windows)))
        hit = windows[(np.repeat(sizes, sizes) > 1) & (windows["known"] == 0)]
        columns = [pa.nulls(len(hit), pa.int64()), pa.nulls(len(hit), pa.binary()), *(pa.array(hit[c]) for c in ("r1", "r2", "s", "s"))]
        return pa.RecordBatch.from_arrays(columns, names=["dest", "packed", "r1", "r2", "s", "e"])

    now, held = None, []
    for batch in batches:
        for dest, packed in zip(batch.column("dest").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            if dest != now and held:
                yield found(held)
                held = []
            now = dest
            held.append(packed)
    if held:
        yield found(held)


def repeated_spans(keyed: DataFrame, text_col: str, width: int = WIDTH) -> DataFrame:
    """(_r1, _r2, spans): window starts [s, e] of each row that repeat somewhere."""
    found = staged(_all_runs(keyed, text_col, width), "runs")
    differ = (F.min("bh") != F.max("bh")) | (F.min("ch") != F.max("ch"))
    shared = found.groupBy("kh").agg(F.count("*").alias("n"), differ.alias("mixed")).where("n > 1").select("kh", "mixed")
    # stored first, so that the join shuffles both sides itself and splits a frequent anchor's partition
    shared = staged(shared, "shared-anchors")
    occurring = staged(found.join(shared, "kh"), "shared-runs")
    same = occurring.where("not mixed").select("_r1", "_r2", "s", "e")
    mixed = occurring.where("mixed")
    kinds = staged(mixed.groupBy("kh", "bh", "ch").agg(F.count("*").alias("n"), F.min(F.struct("_r1", "_r2", "s", "e", "a")).alias("one")), "run-kinds")
    copied = mixed.join(kinds.where("n > 1").select("kh", "bh", "ch"), ["kh", "bh", "ch"]).select("_r1", "_r2", "s", "e")
    # one run of each kind is sorted; a kind met twice stands for two
    one = kinds.select("one.*", F.least("n", F.lit(2)).cast("int").alias("w"))
    open_runs = one.groupBy("_r1", "_r2").agg(F.collect_list(F.struct("s", "e", "a", "w")).alias("open"))
    contexts = staged(_contexts(keyed.join(open_runs, ["_r1", "_r2"]), text_col, width), "suffixes")
    size = contexts.agg(F.sum(F.octet_length("suffix") + F.octet_length("before"))).first()[0] or 0
    count = max(2, -(-size // BUCKET_BYTES))
    dests = 4 * count
    buckets = contexts.repartitionByRange(count, "suffix", "before")
    sorted_ = staged(buckets.mapInArrow(_sort_bucket(width, dests), _BUCKET), "bucket-spans")
    # windows of edge groups that two buckets have, or that stand beside a window known to repeat
    edge = sorted_.where("dest is not null").repartition(dests, "dest").sortWithinPartitions("dest")
    across = edge.mapInArrow(_meet, _BUCKET)
    column = lambda df: df.select(F.col("r1").alias("_r1"), F.col("r2").alias("_r2"), "s", "e")
    every = same.unionByName(copied).unionByName(column(sorted_.where("dest is null"))).unionByName(column(across))
    return every.groupBy("_r1", "_r2").agg(F.collect_set(F.struct("s", "e")).alias("_spans"))


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _cover(starts: list[dict] | None, width: int) -> list[tuple[int, int]]:
    """Maximal byte ranges [start, end) under the windows."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in starts or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e + width))
        else:
            out.append((s, e + width))
    return out


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``documents`` with ``removed_spans`` (byte ranges), ``kept_bytes`` (what is left of the UTF-8 text) and
    ``kept_text`` (the same without the rest of characters that were cut).

    Input columns named like an output are replaced; others, whatever their names and types, stay.
    """
    bound_batches(documents.sparkSession)
    made = ("removed_spans", "kept_bytes", "kept_text")
    others = [c for c in documents.columns if c != text_col and c.lower() not in made]
    given = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(others)]).alias("_others"))
    keyed = _keyed(given, "_id", "_text")
    spans = staged(repeated_spans(keyed.select("_r1", "_r2", "_text"), "_text", width), "repeats")
    rows = keyed.join(spans, ["_r1", "_r2"], "left").drop("_r1", "_r2", "_id")
    fields = [T.StructField("removed_spans", _SPANS), T.StructField("kept_bytes", T.BinaryType()), T.StructField("kept_text", T.StringType())]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(part: pa.RecordBatch) -> list[pa.Array]:
        flat, offsets = joined(text_array(part.column("_text")))
        ranges = [_cover(s, width) for s in part.column("_spans").to_pylist()]
        keep = np.ones(len(flat), dtype=bool)
        for at, own in zip(offsets[:-1].tolist(), ranges, strict=True):
            for a, b in own:
                keep[at + a : at + b] = False
        left = np.concatenate([[0], np.cumsum(keep)])[offsets]
        listed = pa.array([[{"start": a, "end": b} for a, b in own] for own in ranges], kind)
        kept = binary_from(flat[keep], left)
        if len(flat[keep]) == len(flat):
            return [listed, kept.cast(pa.binary()), kept.cast(pa.large_string()).cast(pa.string())]
        return [listed, kept.cast(pa.binary()), pa.array([b.decode("utf-8", "ignore") for b in kept.to_pylist()], pa.string())]

    cut_rows = append_columns(rows, "_text", fields, cut)
    back = [F.col("_text").alias(c) if c == text_col else F.col("_others").getField(f"c{others.index(c)}").alias(c) for c in documents.columns if c in others or c == text_col]
    return cut_rows.select(*back, *made)


def report(documents: DataFrame) -> DataFrame:
    """Per document: bytes, removed bytes and spans, and the digest of the rest."""
    left = remove_repeats(documents.select("doc_id", "text"))
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return left.select(
        "doc_id",
        (F.octet_length("kept_bytes") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("removed_spans").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, p, b[p : p + 199] AS g FROM (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS p FROM d WHERE octet_length(b) >= 200)),
again AS (SELECT g FROM w GROUP BY g HAVING count(*) > 1),
hit AS (SELECT r, p FROM w SEMI JOIN again USING (g)),
edge AS (SELECT r, p, p > coalesce(lag(p) OVER o, -1000) + 200 AS fresh FROM hit WINDOW o AS (PARTITION BY r ORDER BY p)),
runs AS (SELECT r, p, sum(CAST(fresh AS INT)) OVER (PARTITION BY r ORDER BY p) AS k FROM edge),
spans AS (SELECT r, k, min(p) AS s, max(p) + 200 AS e FROM runs GROUP BY r, k),
ends AS (SELECT r, s, e, lag(e, 1, 1) OVER (PARTITION BY r ORDER BY s) AS from_, row_number() OVER (PARTITION BY r ORDER BY s DESC) = 1 AS final FROM spans),
kept AS (SELECT ends.r, sum(e - s) AS n_removed, count(*) AS n_spans,
                string_agg(hex(b[from_ : s - 1]), '' ORDER BY s) || coalesce(max(CASE WHEN final THEN hex(b[e : octet_length(b)]) END), '') AS x
         FROM ends JOIN d ON d.r = ends.r GROUP BY ends.r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(CASE WHEN x IS NULL THEN b ELSE unhex(x) END) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
