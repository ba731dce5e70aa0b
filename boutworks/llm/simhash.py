"""SimHash near-duplicates with pigeonring filtering.

Fingerprints are computed per document in vectorised chunks. Each distinct
fingerprint is cut into 6 segments of 10 or 11 bits on a ring. Two fingerprints
that differ in at most 4 bits have a start from which every chain of l consecutive
segments differs in at most l * 4 / 6 bits. The first four steps of such a chain
(budgets 0, 1, 2, 2) need an equal first segment and an equal one among the next
three, which gives a join key of 20 to 22 bits for each of the 15 pairs of
segments. Inside a key, candidates are pruned by the chain budgets before the full
Hamming check, and only a spanning forest of the links is passed on, never all
pairs. Keys with many fingerprints are dealt
out as pairs of blocks. Links become components by star contraction.

``similar_groups`` is the same for a similarity of shingle sets (``SIMILARITY``
on ``WIDE_SHINGLE`` words). Such pairs differ in up to about 18 bits, too many for
keys of bits, so the ring has 64 segments of the shingle space and each segment's
value is its smallest hash. Sets that differ in at most 15 segments have a start
from which the first four segments of the chain agree (budget 0); at a similarity
of 0.8, with 13 segments apart on average, the chance that no such start exists
is below 1e-4. All sets that share a chain become loose clusters, whatever their
fingerprints; inside a cluster the sets themselves are compared, so a link always
means the similarity.

Defined cases: text without words, null text included, has fingerprint zero and
links like any other; exact copies share one fingerprint and one component; a
null doc_id is a member but never the component's name while another id exists;
very long texts are handled one by one; an empty table has an empty result.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutworks.llm._batches import append_columns, binary_from, gather, give_back, joined, text_array, word_spans
from boutworks.llm._xxh64 import xxh64
from boutworks.operators.components import connected_components, spanning_forest
from boutworks.runtime import staged

SHINGLE, SEED, BITS_APART = 4, 42, 4
SEGMENTS = 6
#: First bits of the segments, and the end.
SEGMENT_ENDS = [0, 11, 22, 33, 44, 54, 64]
#: (start, step): the pairs of segments that make a key; three steps apart, either can be the start.
KEY_PAIRS = [(i, step) for step in (1, 2, 3) for i in range(SEGMENTS if step < 3 else SEGMENTS // 2)]
#: Fingerprints of one key that are compared within one block.
BLOCK = 4096

#: Near duplicates by similarity: words of a shingle, least Jaccard similarity of the sets.
WIDE_SHINGLE, SIMILARITY = 5, 0.8
#: Segments of the shingle space, segments of a chain.
SET_SEGMENTS, SET_CHAIN = 64, 4
#: Sets and shingles of one block of a cluster.
SET_BLOCK, SHINGLE_BLOCK = 2048, 1 << 21
#: A cluster of more sets than this is spread over several tasks, in so many blocks unless it needs more.
SPREAD_BLOCK, SPREAD_BLOCKS = 128, 24


def _spaced(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words joined by single spaces: bytes, word starts, word ends and rows."""
    starts, ends, row = word_spans(flat, offsets)
    sizes = ends - starts
    out = np.full(int(sizes.sum()) + len(sizes), 0x20, dtype=np.uint8)
    heads = np.cumsum(sizes + 1) - sizes - 1
    out[gather(heads, sizes)] = flat[gather(starts, sizes)]
    upper = (out >= 0x41) & (out <= 0x5A)
    out[upper] += 32
    return out, heads, heads + sizes, row


def _shingles(texts: pa.Array, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, row by row, and their number in each row."""
    flat, offsets = joined(texts)
    words, starts, ends, row = _spaced(flat, offsets)
    count = np.bincount(row, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)])
    width = np.minimum(count, shingle)
    shingles = np.where(count > 0, count - width + 1, 0)
    at = gather(first[:-1], shingles)
    if not len(at):
        return np.zeros(0, dtype=np.uint64), shingles
    own = np.repeat(np.arange(len(texts)), shingles)
    return xxh64(words, starts[at], ends[at + width[own] - 1] - starts[at], seed), shingles


def _majority(hashes: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """Fingerprints of rows with so many hashes each: bits set in over half of them."""
    out = np.zeros(len(shingles), dtype=np.uint64)
    if not len(hashes):
        return out
    # byte-wide counters of bits k, k + 8, ...; 255 rows can't overflow them
    parts = -(-shingles // 255)
    within = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    heads = np.repeat(np.cumsum(shingles) - shingles, parts) + 255 * within
    row_heads = (np.cumsum(parts) - parts)[parts > 0]
    ones = np.zeros((int((parts > 0).sum()), 64), dtype=np.int64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0101010101010101), heads)
        counts = np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones[:, k::8] = np.add.reduceat(counts, row_heads, axis=0)
    full = 2 * ones > shingles[parts > 0][:, None]
    out[parts > 0] = np.packbits(full, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints_of(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Unsigned 64-bit fingerprints of the rows."""
    return _majority(*_shingles(texts, shingle, seed))


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The id and ``fp``, the fingerprint as a signed long."""
    field = [T.StructField("fp", T.LongType())]
    rows = documents.select(F.col(id_col), F.col(text_col).alias("_text"))
    made = append_columns(rows, "_text", field, lambda part: [pa.array(fingerprints_of(text_array(part.column("_text")), shingle).view(np.int64))])
    return made.select(id_col, "fp")


def chain_keys(nodes: DataFrame) -> DataFrame:
    """(k, fp): the 15 keys of each fingerprint."""

    def part(i: int) -> Column:
        low, high = SEGMENT_ENDS[i % SEGMENTS], SEGMENT_ENDS[i % SEGMENTS + 1]
        return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1))

    keys = [F.lit(n << 22) + part(i) * 2048 + part(i + step) for n, (i, step) in enumerate(KEY_PAIRS)]
    return nodes.select(F.explode(F.array(*keys)).alias("k"), "fp")


def deal_blocks(keyed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(g, k, fp): keys with more than ``block`` fingerprints become pairs of blocks.

    Every two fingerprints of a key meet in some group of at most about two blocks.
    """
    counts = keyed.groupBy("k").count().where(F.col("count") > block).select("k", F.ceil(F.col("count") / block).cast("long").alias("n"))
    counts = staged(counts, "hot-keys")
    if counts.isEmpty():
        return keyed.select(F.col("k").cast("long").alias("g"), "k", "fp")
    dealt = keyed.join(counts, "k", "left").withColumn("b", F.pmod(F.xxhash64("fp"), F.coalesce("n", F.lit(1)))).withColumn(
        "o", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("n", F.lit(1)) - 1))
    )
    return dealt.select(F.xxhash64("k", F.least("b", "o"), F.greatest("b", "o")).alias("g"), "k", "fp")


def _chains_hold(apart: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether every chain from ``start`` over the segments' differences stays within its budget."""
    ring = np.take_along_axis(apart, (start[:, None] + np.arange(SEGMENTS)) % SEGMENTS, axis=1)
    budget = np.arange(1, SEGMENTS + 1) * BITS_APART // SEGMENTS
    return (np.cumsum(ring, axis=1) <= budget).all(axis=1)


def _pigeonring(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which fingerprint pairs keep the chain budgets from their key's start and differ in few bits."""
    start, step = np.array(KEY_PAIRS)[key >> 22].T
    parts = [((a ^ b) >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1) for low, high in zip(SEGMENT_ENDS[:-1], SEGMENT_ENDS[1:], strict=True)]
    apart = np.bitwise_count(np.stack(parts, axis=1)).astype(np.int64)
    near = _chains_hold(apart, start)
    near |= (step == 3) & _chains_hold(apart, start + 3)
    near[near] = np.bitwise_count(a[near] ^ b[near]) <= BITS_APART
    return near


def _neighbours(group: np.ndarray, key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all fingerprints of equal group and key; rows are sorted by both."""
    linked = (group[1:] == group[:-1]) & (key[1:] == key[:-1]) & (fp[1:] != fp[:-1])
    return spanning_forest(fp[:-1][linked], fp[1:][linked])


_Near = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
_Linked = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _link_groups(group: np.ndarray, key: np.ndarray, fp: np.ndarray, is_near: _Near = _pigeonring) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of equal group and key; rows are sorted by both."""
    found_u, found_v, held = [], [], 0
    live = np.arange(len(fp))
    step = 1
    while len(live):
        live = live[live + step < len(fp)]
        live = live[(group[live] == group[live + step]) & (key[live] == key[live + step])]
        a, b = fp[live], fp[live + step]
        near = is_near(a, b, key[live]) & (a != b)
        if near.any():
            found_u.append(a[near])
            found_v.append(b[near])
            held += int(near.sum())
            if held > 1_000_000:
                u, v = spanning_forest(np.concatenate(found_u), np.concatenate(found_v))
                found_u, found_v, held = [u], [v], len(u)
        step += 1
    if not found_u:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return spanning_forest(np.concatenate(found_u), np.concatenate(found_v))


def _whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches in order of their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column(0).to_numpy()
        # the last group may go on in the next batch
        before = np.flatnonzero(group != group[-1])
        cut = int(before[-1]) + 1 if len(before) else 0
        if cut or held and held[-1].column(0)[-1] != batch.column(0)[0]:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
    give_back()


def _edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


def _links(dealt: DataFrame, linked: _Linked) -> DataFrame:
    """(u, v): a forest of the links inside each key of (g, k, fp)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_groups(batches):
            g, k, f = (part.column(i).to_numpy() for i in range(3))
            yield _edges(*linked(g, k, f.view(np.uint64)))

    return dealt.repartition("g").sortWithinPartitions("g", "k").select("g", F.col("k").cast("long"), "fp").mapInArrow(run, "u long, v long")


def fingerprint_links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(u, v): links that connect all fingerprints of at most 4 differing bits."""
    return _links(deal_blocks(chain_keys(nodes), block), _link_groups)


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """The id, ``fingerprint`` (16 hex digits) and ``component_id`` of every row."""
    rows = staged(fingerprints(documents, id_col, text_col, shingle), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min(id_col).alias("first_id"))
    parts = connected_components(fingerprint_links(nodes.select("fp"), block))
    named = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    # stored, so that the joins shuffle both sides themselves and can split a large component or a frequent fingerprint
    least = staged(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "least-ids")
    of = staged(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "components")
    return rows.join(of, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _distinct(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and their number."""
    hashes, shingles = _shingles(texts, shingle, SEED)
    row = np.repeat(np.arange(len(texts)), shingles)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    first = np.ones(len(row), dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[first], np.bincount(row[first], minlength=len(texts))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _chains(hashes: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The keys of each row: chains of segment minima that hold a shingle."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    segment = (hashes >> np.uint64(58)).astype(np.int64)
    place = row * SET_SEGMENTS + segment
    first = np.ones(len(place), dtype=bool)
    first[1:] = place[1:] != place[:-1]
    least = np.zeros(len(sizes) * SET_SEGMENTS, dtype=np.uint64)
    least[place[first]] = hashes[first] | np.uint64(1)
    least = least.reshape(-1, SET_SEGMENTS)
    keys = np.broadcast_to(np.arange(1, SET_SEGMENTS + 1, dtype=np.uint64), least.shape)
    filled = np.zeros(least.shape, dtype=bool)
    for step in range(SET_CHAIN):
        part = np.roll(least, -step, axis=1)
        keys, filled = _mixed(keys ^ part), filled | (part > 0)
    ends = np.concatenate([[0], np.cumsum(filled.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[filled].view(np.int64)))


def _summary(texts: pa.Array, shingle: int) -> list[pa.Array]:
    """fp, the set's own hash, its size and its chains; fp is that of the set, each shingle once."""
    hashes, sizes = _distinct(texts, shingle)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(hashes))])
    ends = np.cumsum(sizes)
    own = _mixed(total[ends] - total[ends - sizes] + sizes.astype(np.uint64))
    return [pa.array(_majority(hashes, sizes).view(np.int64)), pa.array(own.view(np.int64)), pa.array(sizes.astype(np.int64)), _chains(hashes, sizes)]


def link_sets(nodes: np.ndarray, flat: np.ndarray, sizes: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between sets (``flat``, one after another) of at least that Jaccard similarity.

    A set is compared with all others by the postings of its shingles, until the
    sets not yet compared are all in one component: no link can add to it.
    """
    n = len(nodes)
    own = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[order][1:] != flat[order][:-1]
    heads = np.flatnonzero(new)
    lengths = np.diff(np.append(heads, len(flat)))
    code = np.empty(len(flat), dtype=np.int64)
    code[order] = np.cumsum(new) - 1
    posted, starts = own[order], np.concatenate([[0], np.cumsum(sizes)])
    root, todo, found = np.arange(n), np.ones(n, dtype=bool), []
    while todo.any():
        largest = int(np.argmax(np.bincount(root[todo], minlength=n)))
        outside = np.flatnonzero(todo & (root != largest))
        if not len(outside):
            break
        at = int(outside[0])
        todo[at] = False
        mine = code[starts[at] : starts[at + 1]]
        common = np.bincount(posted[gather(heads[mine], lengths[mine])], minlength=n)
        near = np.flatnonzero(common >= similarity * (sizes + sizes[at] - common) - 1e-9)
        near = near[(root[near] != root[at]) & (sizes[near] > 0)]
        if len(near):
            joined_roots = np.unique(np.append(root[near], root[at]))
            _, one = np.unique(root[near], return_index=True)
            found += [(at, int(x)) for x in near[one]]
            root[np.isin(root, joined_roots)] = joined_roots[0]
    u, v = (np.array([p[i] for p in found], dtype=np.int64) for i in (0, 1))
    return nodes[u], nodes[v]


def _set_links(members: DataFrame, texts: DataFrame, shingle: int, block: int) -> DataFrame:
    """(u, v): a forest of the similar sets inside each cluster of ``members`` (id, root, own, size)."""
    spread = F.least(F.ceil(F.count("*") / SPREAD_BLOCK), F.lit(SPREAD_BLOCKS))
    blocks = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / SHINGLE_BLOCK), spread).alias("n"))
    dealt = members.join(staged(blocks, "cluster-blocks"), "root")
    field = [T.StructField("_set", T.BinaryType())]

    def sets(part: pa.RecordBatch) -> list[pa.Array]:
        hashes, sizes = _distinct(text_array(part.column("_text")), shingle)
        ends = np.concatenate([[0], np.cumsum(sizes)]) * 8
        return [binary_from(hashes.view(np.uint8), ends).cast(pa.binary())]

    whole = texts.join(staged(dealt, "members"), "_key").select("root", "own", "n", "_text")
    listed = append_columns(whole, "_text", field, sets).select("root", "own", "n", "_set", F.pmod(F.xxhash64("own"), "n").alias("b"))
    pairs = listed.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    grouped = pairs.select(F.xxhash64("root", F.least("b", "o"), F.greatest("b", "o")).alias("g"), "own", "_set")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_groups(batches):
            group, nodes = part.column(0).to_numpy(), part.column(1).to_numpy()
            flat, offsets = joined(text_array(part.column(2).combine_chunks()))
            cuts = np.flatnonzero(np.diff(group, prepend=group[:1] - 1, append=group[-1:] - 1)).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = np.ascontiguousarray(flat[offsets[a] : offsets[b]]).view(np.uint64)
                yield _edges(*link_sets(nodes[a:b], own, np.diff(offsets[a : b + 1]) // 8))

    return grouped.repartition("g").sortWithinPartitions("g").mapInArrow(run, "u long, v long")


def similar_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WIDE_SHINGLE, block: int = SET_BLOCK) -> DataFrame:
    """The id and ``component_id`` of every row: what links of at least ``SIMILARITY`` connect, by its smallest id.

    Rows of equal sets, those without words too, are one; ids must not be null.
    """
    texts = documents.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text"))
    fields = [T.StructField("fp", T.LongType()), T.StructField("own", T.LongType()), T.StructField("size", T.LongType()), T.StructField("chains", T.ArrayType(T.LongType()))]
    made = append_columns(texts, "_text", fields, lambda part: _summary(text_array(part.column("_text")), shingle))
    rows = staged(made.drop("_text"), "summaries")
    sets = rows.groupBy("own").agg(F.min("_key").alias("_key"), F.min("fp").alias("fp"), F.min("size").alias("size"))
    chains = rows.groupBy("own").agg(F.min("fp").alias("fp"), F.any_value("chains").alias("chains")).select(F.explode("chains").alias("k"), "fp")
    links = fingerprint_links(rows.select("fp").distinct()).union(_links(deal_blocks(chains), _neighbours))
    clusters = connected_components(links).withColumnRenamed("node", "fp")
    placed = staged(sets.join(clusters, "fp", "left").select("own", "_key", "size", F.coalesce("component", "fp").alias("root")), "placed-sets")
    shared = staged(placed.groupBy("root").count().where("count > 1").select("root"), "clusters")
    parts = connected_components(_set_links(placed.join(shared, "root"), texts, shingle, block))
    named = placed.join(parts.withColumnRenamed("node", "own"), "own", "left").select("own", "_key", F.coalesce("component", "own").alias("group"))
    least = staged(named.groupBy("group").agg(F.min("_key").alias("component_id")), "least-keys")
    of = staged(named.join(least, "group").select("own", "component_id"), "components")
    return rows.join(of, "own").select(F.col("_key").alias(id_col), "component_id")


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WIDE_SHINGLE) -> DataFrame:
    """``documents`` with one row of each group of near duplicates: the one with the smallest id, nulls first.

    Among rows with that id a hash of the row decides, and of equal rows one stays.
    """
    columns = documents.columns
    # the whole row is one column, so that no name clashes, and is hashed as JSON, which any type has
    keyed = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)]).alias("_all"))
    keyed = keyed.withColumn("_row", F.xxhash64(F.to_json("_all"), "_text"))
    named = keyed.select(F.struct("_id", "_row").alias("_key"), "_text")
    kept = similar_groups(named, "_key", "_text", shingle).select("component_id.*").distinct()
    kept = kept.select(F.col("_id").alias("_keep_id"), F.col("_row").alias("_keep_row"))
    stay = keyed.join(kept, F.col("_id").eqNullSafe(F.col("_keep_id")) & (F.col("_row") == F.col("_keep_row")), "left_semi")
    one = stay.dropDuplicates(["_id", "_row"])
    return one.select(*[F.col("_all").getField(f"c{k}").alias(c) for k, c in enumerate(columns)])
