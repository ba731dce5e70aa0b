"""Interpolated modified Kneser-Ney n-gram scoring.

Counting runs in Spark: a first pass gives every training word a number, small for
frequent words. Then each task counts the n-grams of its texts and packs their word
numbers into blocks by hash range, the blocks are shuffled, and each range is merged
into a sorted hash array. Merging a range also gives, for the shorter n-grams at its
n-grams' ends and beginnings, how many of the range's n-grams end in one (its
continuation count is the sum over ranges) and what follows one; these go on as
blocks of the next lower order, down to single words. Blocks of shorter n-grams are
kept as a table in ``PARTS`` parts, which are shuffled and merged one after another and
deleted, and Spark drops the shuffle files of each step when it ends: the disk holds the
arrays, one order's blocks and what is made of them, never those of all orders.
All arrays are files in the shared folder; workers
map them into memory and look up whole chunks of sorted queries, so pages are
shared and no worker holds the model. On a store that can't be mapped, a worker
reads the ranges it needs and keeps at most ``HELD_BYTES`` of them.

P(w | h) = max(c(hw) - D(c(hw)), 0) / c(h) + gamma(h) P(w | h without its first word)
P(w) = max(n(w) - D1(n(w)), 0) / N1 + gamma1 / (V + 1)

c counts n-grams in the highest order and, below it, the distinct words before
them; c(h) is the sum over what follows h; the discounts D of each order for counts
one, two and three or more follow from its counts of counts; gamma is what the
discounts free. A history that training never saw is shortened. A text begins with
start marks that are never predicted, and ends with an end token.

Defined cases: null text is empty and has the end token alone; without training
rows every word has the uniform probability 1 / (V + 1), V = 0; words and n-grams
are told apart by 64-bit hashes; repeated rows are counted, and scored, each; very
long texts are handled one by one; an empty table has an empty result; columns
named like an output are replaced, others travel along or are ignored as
documented.
"""

from __future__ import annotations

import io
import os
import urllib.parse
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutworks.llm._batches import append_columns, bound_batches, chunks, codes_of, give_back, joined, text_array, word_spans
from boutworks.runtime import discard, staged, work_path

#: Words of the longest n-grams, unless given; README has the figures for others.
ORDER = 3
#: Numbers of the start mark and of words that training never saw, and the hash of the end token.
START, UNKNOWN, END = np.uint64(0), np.uint64(1), np.uint64(0x454E44)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORD_SEED = 11
#: Longer words, in bytes, are hashed one by one.
_LONG_WORD = 512
#: Text bytes scored at once: n-grams of more text lie closer together in the sorted arrays, and fewer are distinct.
SCORED_BYTES = 8 << 20
#: Tokens that a task gathers before it packs their n-grams.
_HELD = 4_000_000
#: Hash ranges for each input partition: few, so that a block shares its words among many n-grams.
RANGES = 2
#: Parts of the ranges in which shorter n-grams are merged, one part after another.
PARTS = 4
#: Bytes of ranges that a worker keeps of a model it can't map, and ranges it keeps mapped.
HELD_BYTES, HELD_MAPS = 256 << 20, 4096


def _word_hashes(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of the words flat[start : start + length], eight bytes at a time."""
    padded = np.concatenate([flat, np.zeros(8, dtype=np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, shape=(len(flat) + 1, 8), strides=(1, 1))
    own = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)

    def stirred(key: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        key = key ^ (eight[at].view("<u8").ravel() & own[np.minimum(left, 8)])
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            key ^= key >> np.uint64(shift)
            key *= np.uint64(factor)
        return key ^ (key >> np.uint64(31))

    with np.errstate(over="ignore"):
        key = stirred(lengths.astype(np.uint64) * _MIX, starts, lengths)
        rows, done = np.flatnonzero((lengths > 8) & (lengths <= _LONG_WORD)), 8
        while len(rows):
            key[rows] = stirred(key[rows], starts[rows] + done, lengths[rows] - done)
            done += 8
            rows = rows[lengths[rows] > done]
    raw = memoryview(padded)
    for row in np.flatnonzero(lengths > _LONG_WORD).tolist():
        key[row] = xxhash.xxh64_intdigest(raw[starts[row] : starts[row] + lengths[row]], _WORD_SEED)
    key[key == END] += np.uint64(1)
    return key


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, the end token last; the tokens of all rows as places there, each row's words and its end token; and the ends of the rows."""
    flat, offsets = joined(texts)
    upper = (flat >= 0x41) & (flat <= 0x5A)
    flat = flat + (upper.astype(np.uint8) << np.uint8(5))
    starts, ends, row = word_spans(flat, offsets)
    codes, distinct = codes_of(pa.array(_word_hashes(flat, starts, ends - starts)))
    count = np.bincount(row, minlength=len(texts))
    out = np.full(len(codes) + len(texts), len(distinct), dtype=np.int64)
    out[np.arange(len(codes)) + row] = codes
    return np.append(distinct.to_numpy(), END), out, np.cumsum(count + 1)


def histories(tokens: np.ndarray, ends: np.ndarray, order: int) -> list[np.ndarray]:
    """The n-gram that ends in each token, as columns of words, the earliest first; rows begin with start marks."""
    columns = [tokens]
    for _ in range(order - 1):
        before = np.concatenate([np.full(1, START, tokens.dtype), columns[0][:-1]]) if len(tokens) else tokens
        if len(ends):
            before[ends[:-1]] = START
        columns.insert(0, before)
    return columns


def gram_key(words: list[np.ndarray]) -> np.ndarray:
    """Hashes of n-grams; that of a word is its own number."""
    key = words[0].astype(np.uint64)
    with np.errstate(over="ignore"):
        for word in words[1:]:
            key = (key ^ (key >> np.uint64(29))) * _MIX + word
            key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            key = key ^ (key >> np.uint64(29))
    return key


def _bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash, by its remainder, which no frequent word makes uneven."""
    return (key % np.uint64(buckets)).astype(np.int64)


def _ordinal(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges in a type that sorts fast."""
    return bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    fresh = np.ones(len(columns[0]), dtype=bool)
    fresh[1:] = False
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(fresh)


def _summed(key: np.ndarray, words: list[np.ndarray], stats: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct keys in order, with their words and the sums of the statistics."""
    order = np.argsort(key)
    key = key[order]
    heads = _heads(key)
    first = order[heads]
    return key[heads], [w[first] for w in words], [np.add.reduceat(s[order], heads) if len(heads) else s for s in stats]


def _side_by_side(words: list[np.ndarray]) -> np.ndarray | None:
    """The words of n-grams as numbers of 64 bits that have the order of the words; nothing if they don't fit."""
    bits = [int(w.max()).bit_length() if len(w) else 0 for w in words]
    if sum(bits) > 64:
        return None
    key = words[0].astype(np.uint64)
    for word, size in zip(words[1:], bits[1:], strict=True):
        key = (key << np.uint64(size)) | word
    return key


def _distinct(words: list[np.ndarray], stats: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct n-grams with the sums of the statistics, in the order of their first words."""
    key = _side_by_side(words)
    if key is not None:
        return _summed(key, words, stats)[1:]
    _, words, stats = _summed(gram_key(words), words, stats)
    order = np.lexsort(words[1::-1])
    return [w[order] for w in words], [s[order] for s in stats]


_codec = pa.Codec("zstd")


def _least(array: np.ndarray) -> np.ndarray:
    """The values in the narrowest type that holds them all."""
    most = int(array.max()) if len(array) else 0
    return array.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))


def _squeezed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of whole numbers, each byte of a number in a row of its own, behind their lengths and widths."""
    head = np.array([len(arrays), *(n for a in arrays for n in (len(a), a.itemsize))], dtype="<i8").tobytes()
    raw = head + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + _codec.compress(raw, asbytes=True)


def _restored(raw: bytes) -> list[np.ndarray]:
    data = np.frombuffer(_codec.decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True), np.uint8)
    at = 8 + 16 * int(data[:8].view("<i8")[0])
    out = []
    for n, wide in data[8:at].view("<i8").reshape(-1, 2).tolist():
        out.append(np.ascontiguousarray(data[at : at + n * wide].reshape(wide, n).T).view(f"<u{wide}").ravel())
        at += n * wide
    return out


def _pack(words: list[np.ndarray], stats: list[np.ndarray]) -> bytes:
    """A block: n-grams as columns of words, the first as differences, and their statistics."""
    first = np.diff(words[0].astype(np.uint64), prepend=np.uint64(0))
    return _squeezed([_least(c) for c in (first, *words[1:], *stats)])


def _unpack(raw: bytes, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    first, *columns = _restored(raw)
    return [_least(np.cumsum(first, dtype=np.uint64)), *columns[: order - 1]], [c.astype(np.int64) for c in columns[order - 1 :]]


def _narrow(table: np.ndarray) -> np.ndarray:
    """The values as bytes; of those that a byte can't hold, places and values stand behind them."""
    flat = table.ravel()
    over = np.flatnonzero(flat >= 255)
    tail = np.concatenate([over, flat[over]]).astype(np.uint64).view(np.uint8)
    return np.concatenate([np.minimum(flat, 255).astype(np.uint8), np.zeros(-len(flat) % 8, np.uint8), tail])


def _widened(raw: np.ndarray, n: int, wide: int, rows: np.ndarray) -> np.ndarray:
    """Some rows of a table of ``n`` rows that ``_narrow`` made."""
    size = n * wide
    found = raw[:size].reshape(n, wide)[rows].ravel()
    at, out = np.flatnonzero(found == 255), found.astype(np.int64)
    if len(at):
        places, values = np.array(raw[size + -size % 8 :]).view(np.uint64).reshape(2, -1)
        out[at] = values[np.searchsorted(places, (rows[at // wide] * wide + at % wide).astype(np.uint64))]
    return out.reshape(-1, wide)


_BLOCK = "bucket int, block binary, k int, n long, n1 long, n2 long, n3 long, n4 long, total long, grams long"
_NUMBERS = [f.split()[0] for f in _BLOCK.split(", ")][2:]


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    """(bucket, block) rows, or (bucket, None, order and numbers) of a merged range."""
    made = zip(*(r if len(r) > 2 else (*r, *[None] * len(_NUMBERS)) for r in rows), strict=True) if rows else [[]] * (2 + len(_NUMBERS))
    kinds = [pa.int32(), pa.binary(), pa.int32(), *[pa.int64()] * (len(_NUMBERS) - 1)]
    return pa.RecordBatch.from_arrays([pa.array(m, k) for m, k in zip(made, kinds, strict=True)], names=["bucket", "block", *_NUMBERS])


def _dealt(words: list[np.ndarray], stats: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """The n-grams as blocks of their ranges; inside a block they keep their order, and repeats of words compress well in that of ``_distinct``."""
    if not len(words[0]):  # a range may hold histories alone, which no shorter n-gram is counted from
        return
    bucket = _bucket_of(gram_key(words), buckets)
    order = np.argsort(_ordinal(bucket, buckets), kind="stable")
    bucket, words, stats = bucket[order], [w[order] for w in words], [s[order] for s in stats]
    heads = _heads(bucket)
    rows, held = [], 0
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(bucket)], strict=True):
        rows.append((int(bucket[a]), _pack([w[a:b] for w in words], [s[a:b] for s in stats])))
        held += len(rows[-1][1])
        if held > 4 << 20:
            yield _block_batch(rows)
            rows, held = [], 0
    if rows:
        yield _block_batch(rows)


def _words(text_col: str, buckets: int):
    """Blocks of the distinct words of the texts by hash, and how often they occur."""

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        key, _, (count,) = _summed(np.concatenate([k for k, _ in held]), [], [np.concatenate([c for _, c in held])])
        return key, count

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in chunks(batch, text_col):
                distinct, tokens, _ = tokens_of(text_array(part.column(text_col)))
                held.append((distinct, np.bincount(tokens, minlength=len(distinct))))
                size += len(distinct)
                if size > _HELD // 4:
                    held = [flush(held)]
                    size = len(held[0][0])
                    if size > _HELD // 8:
                        yield from _dealt([held[0][0]], [held[0][1]], buckets)
                        held, size = [], 0
        if held:
            key, count = flush(held)
            yield from _dealt([key], [count], buckets)
        give_back()

    return run


def _number(path: str, buckets: int):
    """Write a range's words, by hash, with their places in the order of falling counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (key,), stats in _groups(batches, 1):
            key, _, (count,) = _summed(key, [], stats)
            place = np.empty(len(key), np.int64)
            place[np.lexsort((key, -count))] = np.arange(len(key))
            _save(f"{path}/0-{bucket}.key.npy", key.astype(np.uint64))
            _save(f"{path}/0-{bucket}.n.npy", _least(place))
            yield _block_batch([(bucket, None, 0, len(key), *[None] * (len(_NUMBERS) - 2))])
        give_back()

    return run


@dataclass
class Vocabulary:
    """Numbers of the training words: their place in their range, so that frequent words have small ones, and the range."""

    path: str
    buckets: int
    present: list[int]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), UNKNOWN, dtype=np.uint64)
        for bucket, rows in _by_bucket(hashes, self.buckets, self.present):
            keys, places = _ranges.get(f"{self.path}/0-{bucket}")
            at = np.minimum(np.searchsorted(keys, hashes[rows]), len(keys) - 1)
            hit = keys[at] == hashes[rows]
            out[rows[hit]] = (places[at[hit]].astype(np.uint64) + np.uint64(1)) * np.uint64(self.buckets) + np.uint64(bucket)
        return out


def _by_bucket(key: np.ndarray, buckets: int, present: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of ``key`` that fall in each range that is there, in their order."""
    bucket = _bucket_of(key, buckets)
    order = np.argsort(_ordinal(bucket, buckets), kind="stable")
    heads, here = _heads(bucket[order]), set(present)
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(key)], strict=True):
        if int(bucket[order[a]]) in here:
            yield int(bucket[order[a]]), order[a:b]


def _tallied(held: list[tuple[np.ndarray, list[np.ndarray]]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams, in the order of their first words, and how often each occurs; ``held`` has chunks' word numbers and n-grams as columns of places there."""
    numbers, place = np.unique(np.concatenate([n for n, _ in held]), return_inverse=True)
    places = np.split(place.astype(np.uint64), np.cumsum([len(n) for n, _ in held])[:-1])
    order, size = len(held[0][1]), len(numbers).bit_length()
    if order * size > 64:
        columns = [np.concatenate([numbers[own[c[k]]] for own, (_, c) in zip(places, held, strict=True)]) for k in range(order)]
        words, (count,) = _distinct(columns, [np.ones(len(columns[0]), dtype=np.int64)])
        return words, count
    # the few words of one task fit side by side, and plain numbers sort fast
    key = np.empty(sum(len(c[0]) for _, c in held), dtype=np.uint64)
    end = 0
    for own, (_, columns) in zip(places, held, strict=True):
        part = own[columns[0]]
        for c in columns[1:]:
            part = (part << np.uint64(size)) | own[c]
        key[end : end + len(part)] = part
        end += len(part)
    key.sort()
    heads = _heads(key)
    count, key = np.diff(heads, append=len(key)), key[heads]
    return [numbers[(key >> np.uint64(k * size)) & np.uint64((1 << size) - 1)] for k in range(order - 1, -1, -1)], count


def _count(text_col: str, order: int, buckets: int, vocabulary: Vocabulary):
    """Blocks of the n-grams of the texts, counted within some ``_HELD`` tokens."""

    def flush(held: list[tuple[np.ndarray, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        words, count = _tallied(held)
        held.clear()
        yield from _dealt(words, [count], buckets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in chunks(batch, text_col):
                distinct, tokens, ends = tokens_of(text_array(part.column(text_col)))
                numbers = _least(np.append(START, vocabulary.numbers(distinct)))  # the start mark is in place 0
                columns = histories(_least(tokens + 1), ends, order)
                for at in range(0, len(tokens), _HELD):  # a very long text in several parts
                    held.append((numbers, [c[at : at + _HELD] for c in columns]))
                    size += len(held[-1][1][0])
                    if size > _HELD:
                        yield from flush(held)
                        held, size = [], 0
        if size:
            yield from flush(held)
        give_back()

    return run


def _open(path: str):
    """The file system and the plain path of a URI in the shared folder."""
    url = urllib.parse.urlparse(path)
    if url.scheme in ("", "file"):
        return pafs.LocalFileSystem(), url.path
    return pafs.FileSystem.from_uri(path)


def _save(path: str, array: np.ndarray) -> None:
    """Write an array; a task that runs again replaces the same file by the same bytes."""
    system, plain = _open(path)
    system.create_dir(os.path.dirname(plain), recursive=True)
    part = f"{plain}.{os.getpid()}.{os.urandom(4).hex()}"
    with system.open_output_stream(part) as f:
        np.lib.format.write_array_header_1_0(f, np.lib.format.header_data_from_array_1_0(array))
        f.write(np.ascontiguousarray(array).data.cast("B") if array.nbytes else b"")
    system.move(part, plain)


def _load(path: str) -> np.ndarray:
    """A file's values: memory-mapped where the shared folder is mounted, else read."""
    system, plain = _open(path)
    if isinstance(system, pafs.LocalFileSystem):
        return np.load(plain, mmap_mode="r")
    with system.open_input_file(plain) as f:
        return np.load(io.BytesIO(f.read()))


def _counts_of(count: np.ndarray) -> list[int]:
    return [int((count == k).sum()) for k in (1, 2, 3, 4)]


def _padded(stats: list[np.ndarray]) -> list[np.ndarray]:
    """All six statistics of a shorter n-gram; blocks of ends have the first two, blocks of beginnings the others."""
    none = np.zeros(len(stats[0]), np.int64)
    return {2: [*stats, *[none] * 4], 4: [*[none] * 2, *stats]}.get(len(stats), stats)


def _groups(batches: Iterable[pa.RecordBatch], order: int) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray]]]:
    """Words and statistics of each range, joined; rows ascend by range."""

    def whole(held: list[tuple]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        return tuple([np.concatenate(c) for c in zip(*part, strict=True)] for part in zip(*held, strict=True))

    now, held = None, []
    for batch in batches:
        for bucket, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != now and held:
                yield now, *whole(held)
                held = []
            now = bucket
            words, stats = _unpack(raw, order)
            held.append((words, _padded(stats)))
    if held:
        yield now, *whole(held)


def _merge(path: str, order: int, top: bool, buckets: int):
    """Write a range's sorted hashes and statistics of one order; pass on what the next lower order gets from it, and the numbers of higher ones.

    Statistics below the top are: count (distinct words before), frequency, and of what follows: the sum of the
    counts, and how many have the count one, two, and three or more.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = []

        def blocks() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                empty = batch.column(1).is_null()
                numbers.append(batch.filter(empty))
                yield batch.filter(pc.invert(empty))

        for bucket, words, stats in _groups(blocks(), order):
            key, words, stats = _summed(gram_key(words), words, stats)
            count, frequency = stats[0], stats[0] if top else stats[1]
            _save(f"{path}/{order}-{bucket}.key.npy", key)
            kept = [count] if top else [stats[0], *stats[2:], *([frequency] if order == 1 else [])]
            _save(f"{path}/{order}-{bucket}.n.npy", (_least if order == 1 else _narrow)(np.column_stack(kept).ravel()))
            seen = count > 0
            yield _block_batch([(bucket, None, order, len(key), *_counts_of(count), int(frequency.sum()), int(count.sum()))])
            if order > 1:
                n = count[seen]
                one, two = (n == 1).astype(np.int64), (n == 2).astype(np.int64)
                each = np.ones_like(n)
                for shorter, passed in (([w[seen] for w in words[1:]], [each, frequency[seen]]), ([w[seen] for w in words[:-1]], [n, one, two, each - one - two])):
                    yield from _dealt(*_distinct(shorter, passed), buckets)
        yield from numbers
        give_back()

    return run


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Discounts for counts one, two, and three or more; 0.5, 1, 1.5 where they can't be estimated."""
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.0), float(k)) for k, d in enumerate(found, 1)]


class _Ranges:
    """Ranges of a model that this worker has open, the longest unused of which go first."""

    def __init__(self) -> None:
        self.open: OrderedDict[str, tuple[np.ndarray, np.ndarray]] = OrderedDict()
        self.held = 0

    @staticmethod
    def _size(pair: tuple[np.ndarray, np.ndarray]) -> int:
        return sum(0 if isinstance(a, np.memmap) else a.nbytes for a in pair)

    def get(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        if name in self.open:
            self.open.move_to_end(name)
            return self.open[name]
        pair = _load(f"{name}.key.npy"), _load(f"{name}.n.npy")
        self.open[name] = pair
        self.held += self._size(pair)
        while len(self.open) > 1 and (self.held > HELD_BYTES or len(self.open) > HELD_MAPS):
            self.held -= self._size(self.open.popitem(last=False)[1])
        return pair


_ranges = _Ranges()


@dataclass
class NgramModel:
    """Where the arrays are, and the few numbers that hold for all of them."""

    path: str
    order: int
    buckets: int
    words: Vocabulary
    present: dict[int, list[int]]  # by order, ranges that have n-grams
    discount: dict[int, list[float]]
    vocabulary: int
    bigrams: int  # distinct ones: the sum of the words' continuation counts
    tokens: int
    word_gamma: float

    def _lookup(self, order: int, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Statistics of the distinct n-grams, a row each, zero where one is unknown; and the row of every n-gram."""
        wide = 1 if order == self.order else 6 if order == 1 else 5
        key, back = np.unique(gram_key(words), return_inverse=True)
        out = np.zeros((len(key), wide), dtype=np.int64)
        for bucket, rows in _by_bucket(key, self.buckets, self.present[order]):
            keys, values = map(np.asarray, _ranges.get(f"{self.path}/{order}-{bucket}"))
            sought = key[rows]
            at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == sought)
            out[rows[hit]] = values.reshape(-1, wide)[at[hit]] if order == 1 else _widened(values, len(keys), wide, at[hit])
        return out, back

    def _rest(self, order: int, table: np.ndarray) -> np.ndarray:
        """Counts less their discounts."""
        return np.maximum(table[:, 0] - _discount_of(table[:, 0], self.discount[order]), 0)

    def _follow(self, order: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of histories of ``order`` words: the sum of what follows, and what the discounts free of it."""
        return table[:, 1].astype(float), sum(table[:, 2 + k] * d for k, d in enumerate(self.discount[order + 1]))

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Per row: tokens, known tokens, add-one base score and log10 probability."""
        distinct, tokens, ends = tokens_of(texts)
        if not len(ends):
            return {"n_tokens": ends, "n_known": ends, "base_score": ends.astype(float), "score": ends.astype(float)}
        heads = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        numbers = self.words.numbers(distinct)
        columns = histories(_least(numbers)[tokens], ends, self.order)
        # all that follows from statistics is taken for distinct n-grams, and then dealt to the tokens
        table, back = self._lookup(1, [numbers])
        table, back, v = table[back], tokens, self.vocabulary
        p = (self._rest(1, table) / max(1, self.bigrams) + self.word_gamma / (v + 1))[back]
        base = np.log10((table[:, 5] + 1) / (self.tokens + (v + 1)))[back]
        known = (table[:, 5] > 0)[back]
        for order in range(2, self.order + 1):
            # a history is the shorter n-gram that ends in the token before
            first = self._follow(order - 1, self._lookup(order - 1, [np.array([START])] * (order - 1))[0])
            total, free = (np.concatenate([f, per[back[:-1]]]) for f, per in zip(first, self._follow(order - 1, table), strict=True))
            total[heads], free[heads] = first
            table, back = self._lookup(order, columns[-order:])
            free *= p
            free += self._rest(order, table)[back]
            p = np.divide(free, total, out=p, where=total > 0)
        return {
            "n_tokens": np.diff(np.append(heads, len(tokens))),
            "n_known": np.add.reduceat(known.astype(np.int64), heads),
            "base_score": np.add.reduceat(base, heads),
            "score": np.add.reduceat(np.log10(p), heads),
        }


def _discount_of(count: np.ndarray, discount: list[float]) -> np.ndarray:
    return np.array([0.0, *discount])[np.minimum(count, 3)]


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Let Spark delete the shuffle files of a query when it ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def train(rows: DataFrame, text_col: str = "text", order: int = ORDER) -> NgramModel:
    """Count the n-grams of ``rows`` and write the model's arrays to the shared folder."""
    if order < 2:
        raise ValueError("the order must be two at least")
    spark = rows.sparkSession
    bound_batches(spark)
    path = work_path(spark, "ngrams")
    buckets = max(16, RANGES * rows.rdd.getNumPartitions())

    def dealt(blocks: DataFrame, share: int = 1) -> DataFrame:
        """Ranges go to tasks by their number, so every task has as many; of a part there are only every ``share``-th."""
        return blocks.repartitionById(-(-buckets // share), F.floor(F.col("bucket") / share).cast("int")).sortWithinPartitions("bucket")

    def read(table: str) -> DataFrame:
        return spark.read.schema(f"{_BLOCK}, part int").parquet(table)

    def kept(blocks: DataFrame, to: str) -> None:
        blocks.withColumn("part", F.col("bucket") % PARTS).write.partitionBy("part").mode("append").parquet(to)

    with _shuffles_dropped(spark):
        numbered = dealt(rows.select(text_col).mapInArrow(_words(text_col, buckets), _BLOCK)).mapInArrow(_number(path, buckets), _BLOCK)
        words = Vocabulary(path, buckets, sorted(r.bucket for r in numbered.select("bucket").collect()))  # a row for each range
        counted = rows.select(text_col).mapInArrow(_count(text_col, order, buckets, words), _BLOCK)
        table = work_path(spark, "blocks")
        kept(dealt(counted).mapInArrow(_merge(path, order, True, buckets), _BLOCK), table)
        for k in range(order - 1, 1, -1):
            shorter = work_path(spark, "blocks")
            for part in range(PARTS):
                blocks = dealt(read(table).where(F.col("part") == part).drop("part"), PARTS)
                kept(blocks.mapInArrow(_merge(path, k, False, buckets), _BLOCK), shorter)
                discard(spark, f"{table}/part={part}")
            discard(spark, table)
            table = shorter
        merged = staged(dealt(read(table).drop("part")).mapInArrow(_merge(path, 1, False, buckets), _BLOCK), "merged")
        discard(spark, table)
        # a row of eight numbers for each order and range, summed by Spark
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _NUMBERS[1:]]
        orders = spark.createDataFrame([(k,) for k in range(1, order + 1)], "k int")
        found = orders.join(merged, "k", "left").groupBy("k").agg(*sums, F.collect_set("bucket").alias("at")).collect()
    numbers = {n.k: n for n in found}
    discount = {k: _discounts(n.n1, n.n2, n.n3, n.n4) for k, n in numbers.items()}
    single, d = numbers[1], discount[1]
    vocabulary = max(0, single.n - 1)  # the start mark is the one word that follows nothing
    more = vocabulary - single.n1 - single.n2
    gamma = (d[0] * single.n1 + d[1] * single.n2 + d[2] * more) / single.grams if single.grams else 1.0
    return NgramModel(path, order, buckets, words, {k: sorted(n["at"]) for k, n in numbers.items()}, discount, vocabulary, single.grams, single.total, gamma)


def score(rows: DataFrame, model: NgramModel, text_col: str = "text") -> DataFrame:
    """``rows`` with n_tokens, n_known, base_score, score and perplexity; clashing columns are replaced."""
    fields = [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")] + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score", "perplexity")]

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        found = model.score(text_array(part.column(text_col)))
        perplexity = np.power(10.0, np.minimum(-found["score"] / np.maximum(found["n_tokens"], 1), 300))
        return [pa.array(found[c]) for c in ("n_tokens", "n_known", "base_score", "score")] + [pa.array(perplexity)]

    return append_columns(rows, text_col, fields, compute, SCORED_BYTES)


def fold(documents: DataFrame) -> DataFrame:
    """doc_id, text and ``held_out``: crc32 of the id's text leaves 2 when divided by 7. A null id trains."""
    left = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    return documents.select("doc_id", "text", F.coalesce(left == 2, F.lit(False)).alias("held_out"))


def report(documents: DataFrame, order: int = ORDER) -> DataFrame:
    """Scores of all documents under the model of those that aren't held out."""
    rows = fold(documents)
    model = train(rows.where("not held_out"), order=order)
    return score(rows, model).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity"
    )
