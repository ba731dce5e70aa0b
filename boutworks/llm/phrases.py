"""Phrase collocations by level-wise passes.

Level k counts the phrases of k words. Its pass over the texts emits a phrase only
where both of its parts of k - 1 words, the leading and the trailing one, are frequent
on the level before: no other phrase can be frequent. What is frequent goes to the
tasks as a filter of hashed bits, broadcast: built in slices by the executors, at 16
bits a phrase, and never over ``FILTER_BITS`` (64 MB) whatever the corpus. A filter
has no false negatives, and all that is emitted is counted exactly and held against
the threshold, so collisions, and a filter that is full, cost emitted rows and never
a wrong result.

A task counts the phrases of a chunk of text by their word numbers before it emits
strings, and Spark adds up partial sums before its shuffle, so a very common phrase is
a row per task. Level tables are stored; cuts of the candidates are scored by joins
with them, in exact decimals. One-word parts, which very many candidates may share,
are salted. The best of each language are chosen in two steps, so that no task gets
all candidates of a language.

Defined cases: null text has no words and a null language is ``und``; texts without
words count nothing; ties go by the order stated at ``collocations``; repeated rows
count each; a very long text is a chunk by itself and read whole; an empty table has
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutworks.llm._batches import binary_from, bound_batches, chunks, codes_of, gather, give_back, joined, spans_array, text_array, word_spans
from boutworks.llm._xxh64 import xxh64
from boutworks.runtime import staged

LONGEST, MIN_COUNT, TOP, COVER = 5, 100, 2000, 100
NO_LANG = "und"
#: Text bytes counted at once.
CHUNK = 4 << 20
#: Bits of the largest filter, and of a slice of it that one task builds.
FILTER_BITS, SLICE_BITS, BITS_EACH = 1 << 29, 1 << 20, 16
#: Rows that stand for each one-word part, and tasks that share a language's candidates.
SALTS, SHARES = 16, 64

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_ENDS_PIECE = np.zeros(256, dtype=bool)
_ENDS_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_FOLD[_ENDS_PIECE] = 0x20
_FOLD[0x09] = 0x20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of a chunk: their numbers, hashes and places, and how far each one's piece goes on."""

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        flat, offsets = joined(texts)
        ends_piece = _ENDS_PIECE[flat]
        piece = np.cumsum(ends_piece, dtype=np.int64)
        flat = _FOLD[flat]
        self.starts, self.ends, row = word_spans(flat, offsets)
        self.codes, distinct = codes_of(spans_array(flat, self.starts, self.ends))
        sizes = np.diff(np.frombuffer(distinct.buffers()[1], dtype=np.int64)[: len(distinct) + 1]) if len(distinct) else np.zeros(0, np.int64)
        whole, at = joined(distinct) if len(distinct) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        self.kinds = max(1, len(distinct))
        lang = langs.dictionary_encode()
        self.lang_names = lang.dictionary.to_pylist()
        names = pa.array([n.encode() for n in self.lang_names], pa.large_binary())
        lang_bytes, lang_at = joined(names)
        lang_hash = xxh64(lang_bytes, lang_at[:-1], np.diff(lang_at), 7)
        self.lang = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row] if len(row) else np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            word = xxh64(whole, at[:-1], sizes, 11)[self.codes] if len(self.codes) else np.zeros(0, np.uint64)
            self.word = word
            self.first = _stirred(word ^ (lang_hash[self.lang] * _MIX)) if len(word) else word
        # words that stand together in one piece of one row have the same number
        together = piece[self.starts] * (len(offsets) + 1) + row if len(row) else np.zeros(0, np.int64)
        edge = np.flatnonzero(np.diff(together, append=-1) != 0) + 1  # the first word behind each piece
        self.room = edge[np.searchsorted(edge, np.arange(len(row)), side="right")] - np.arange(len(row)) if len(row) else np.zeros(0, np.int64)
        # the words with one space behind each
        sizes = self.ends - self.starts
        self.at = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.flat = np.full(int(self.at[-1]), 0x20, dtype=np.uint8)
        self.flat[gather(self.at[:-1], sizes)] = flat[gather(self.starts, sizes)]

    def hashes(self, k: int) -> np.ndarray:
        """A hash of the language and the k words from each word on; without meaning where the piece is shorter."""
        h = self.first
        with np.errstate(over="ignore"):
            for j in range(1, k):
                h = h.copy()
                h[: len(h) - j] = _stirred(h[: len(h) - j] * _MIX + self.word[j:])
        return h

    def counts(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """One place of each distinct phrase of k words among the places, and its count; by word numbers, not by hashes."""
        rank = self.lang[at]
        first = at
        for j in range(k):
            _, first, rank = np.unique(rank * self.kinds + self.codes[at + j], return_index=True, return_inverse=True)
        return at[first], np.bincount(rank, minlength=len(first))

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        starts = self.at[at]
        sizes = self.at[at + k] - 1 - starts
        return binary_from(self.flat[gather(starts, sizes)], np.concatenate([[0], np.cumsum(sizes)]), pa.large_string())


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def frequent_filter(level: DataFrame, k: int, most_bits: int = FILTER_BITS) -> np.ndarray:
    """Bits of the phrases of ``level``, two each. Executors build it in slices; at most ``most_bits`` reach the driver."""
    bits = 1 << 16
    keys = level.count()
    while bits < keys * BITS_EACH and bits < most_bits:
        bits *= 2
    slice_bits = min(bits, SLICE_BITS)

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "phrase", CHUNK):
                words = Words(text_array(part.column("phrase")), part.column("lang").cast(pa.large_string()))
                at = np.flatnonzero(words.room >= k)
                spots = np.sort(np.concatenate(_probes(words.hashes(k)[at], bits)))
                number, first = np.unique(spots // slice_bits, return_index=True)
                parts = np.split((spots % slice_bits).astype("<u4"), first[1:])
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "bits"])

    def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(number: int, own: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])

        now, own = None, np.zeros(slice_bits, dtype=bool)
        for batch in batches:
            for number, spots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if number != now:
                    if now is not None:
                        yield packed(now, own)
                    now, own[:] = number, False
                own[np.frombuffer(spots, dtype="<u4")] = True
        if now is not None:
            yield packed(now, own)

    spots = level.select("lang", "phrase").mapInArrow(places, "slice long, bits binary")
    made = spots.repartition(bits // slice_bits, "slice").sortWithinPartitions("slice").mapInArrow(slices, "slice long, bits binary")
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in made.toLocalIterator():
        out[r["slice"] * (slice_bits // 8) :][: slice_bits // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = _probes(h, len(bits) * 8)
    return ((bits[a >> 3] >> (a & 7).astype(np.uint8)) & (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def level_counts(docs: DataFrame, k: int, frequent: np.ndarray | None) -> DataFrame:
    """(lang, phrase, a) of the phrases of k words whose parts of k - 1 words pass the filter; of all words on level 1."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(frequent) if frequent is not None else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                words = Words(text_array(part.column("text")), part.column("lang").cast(pa.large_string()))
                at = np.flatnonzero(words.room >= k)
                if sent is not None:
                    held = np.zeros(len(words.room) + 1, dtype=bool)
                    held[:-1] = _held(sent.value, words.hashes(k - 1))
                    at = at[held[at] & held[at + 1]]
                if not len(at):
                    continue
                first, n = words.counts(at, k)
                langs = pa.array(words.lang_names, pa.large_string()).take(pa.array(words.lang[first]))
                yield pa.RecordBatch.from_arrays([langs.cast(pa.string()), words.phrases(first, k).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "phrase", "n"])
        give_back()

    return docs.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("a"))


def levels(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all words, and the stored tables of the frequent phrases of 1 to ``longest`` words."""
    if longest < 2 or min_count < 1:
        raise ValueError("a phrase has two words at least and a count of one")
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = staged(level_counts(docs, 1, None), "words")
    tables = [staged(words.where(F.col("a") >= min_count), "level-1")]
    for k in range(2, longest + 1):
        counted = level_counts(docs, k, frequent_filter(tables[-1], k - 1))
        tables.append(staged(counted.where(F.col("a") >= min_count), f"level-{k}"))
    return words.groupBy("lang").agg(F.sum("a").alias("n")), tables


def collocations(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, top: int = TOP, cover: int = COVER) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``longest`` words.

    A phrase's score is that of its lowest cut, of equal ones the first. A phrase inside a longer one that has ``cover``
    percent of its count is dropped. Ranks go by score, then a, both falling, then the phrase in byte order.
    """
    totals, tables = levels(docs, longest, min_count)
    sized = [t.withColumn("words", F.lit(k)) for k, t in enumerate(tables, 1)]
    candidates, parts = sized[1], sized[0]
    for t in sized[2:]:
        candidates = candidates.unionByName(t)
    for t in sized[1:-1]:
        parts = parts.unionByName(t)
    kept = staged(_without_covered(candidates, cover), "candidates")

    salts = F.when(F.col("words") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    parts = parts.select("lang", F.col("phrase").alias("part"), F.col("a").alias("count"), F.explode(salts).alias("salt"))
    words = F.split("phrase", " ")
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    joined_up = lambda start, size: F.array_join(F.slice(words, start, size), " ")
    own = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    cuts = cuts.withColumns({
        "left": joined_up(F.lit(1), F.col("cut")), "left_salt": F.when(F.col("cut") == 1, own).otherwise(0),
        "right": joined_up(F.col("cut") + 1, F.col("words") - F.col("cut")), "right_salt": F.when(F.col("words") - F.col("cut") == 1, own).otherwise(0),
    })
    side = lambda name: parts.select("lang", F.col("part").alias(name), F.col("salt").alias(f"{name}_salt"), F.col("count").alias(name[0]))
    cuts = cuts.join(side("left"), ["lang", "left", "left_salt"]).join(side("right"), ["lang", "right", "right_salt"])
    # few languages with very many candidates each: their totals are salted too
    totals = totals.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    cuts = cuts.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)).cast("int")).join(totals, ["lang", "share"])
    big = lambda c: f"cast({c} as decimal(15,0))"
    score = F.expr(f"(cast(1000 as decimal(4,0)) * {big('a')} * {big('n')}) div ({big('l')} * {big('r')})")
    lowest = cuts.groupBy("lang", "share", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("low"))
    scored = lowest.select("lang", "share", "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n", F.col("low.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _without_covered(candidates: DataFrame, cover: int) -> DataFrame:
    """Candidates that no longer one covers.

    Looking one word further suffices: between a phrase and a longer one that covers it stand phrases whose counts are no less than the longer one's.
    """
    words = F.split("phrase", " ")
    inner = F.array(F.array_join(F.slice(words, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("words") - 1), " "))
    around = candidates.where("words > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("around")).groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    return candidates.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * cover)).drop("around")


#: Whole texts of the table, by plain n-grams.
SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), lists AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces
), sizes AS (SELECT lang, w, unnest(range(1, least(5, len(w)) + 1)) AS k FROM lists
), grams AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sizes
), f AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS a FROM grams GROUP BY ALL
), totals AS (SELECT lang, sum(a)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (SELECT * FROM f WHERE k > 1 AND a >= 100
), covered AS (
  SELECT DISTINCT s.lang, s.phrase FROM c s JOIN c g ON s.lang = g.lang AND s.k < g.k AND 100 * g.a >= 100 * s.a AND contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' ')
), cuts AS (
  SELECT c.lang, c.phrase, c.a, c.k, string_split(c.phrase, ' ') AS w, unnest(range(1, c.k)) AS cut FROM c ANTI JOIN covered USING (lang, phrase)
), scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, cut, x.a AS l, y.a AS r, n, (1000 * cuts.a * n) // (x.a * y.a) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1 : cut], ' ')
  JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[cut + 1 : cuts.k], ' ') JOIN totals ON totals.lang = cuts.lang
), low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM low QUALIFY rank <= 2000
"""
