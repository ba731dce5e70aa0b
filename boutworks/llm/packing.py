"""Packing of documents into training sequences of a fixed number of tokens.

A document's ids, with an end id behind them, are cut into full sequences, which need
no packing, and a tail. Tails are dealt at random to groups of about ``GROUP_DOCS``
documents, and each group is packed by itself: first-fit decreasing, where a
tournament tree over the free room of the group's bins leads to the first bin that a
tail fits into in as many steps as the tree has levels.

What first-fit leaves open is then closed where it pays: bins whose gap is at least
``MIN_CUT`` tokens take tails, or the leading part of one, from the emptiest bin. The
one bin that stays open is cut at powers of two, at which sequences aren't padded. So
a group pads nothing but gaps below ``MIN_CUT``.

Ids come from the tokenizers library. A text is cut before white space that follows
other text, where the byte-level pattern always starts a new token group; equal units
are encoded once and their ids gathered.

The encoded documents are stored once, with a number each, and groups follow from a
hash of that number: a task that is run again deals the same rows to the same groups,
and rows that are equal in all columns spread over groups like others. A task holds
one group's tails, never a whole document's ids but while it encodes them.

Defined cases: null text is empty, and an empty document has its end id alone; null
and repeated doc_ids and repeated rows are documents by themselves; equal lengths are
packed in the order of their numbers; very long texts are encoded whole, in units;
an empty table has an empty result; other columns are ignored, whatever their names.
Special tokens' strings in a text become their ids, as the library does by default.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutworks.llm._batches import append_columns, binary_from, gather, give_back, joined, text_array
from boutworks.runtime import staged

SEQUENCE = 2048
#: Documents whose tails are packed together; their tails are 16 MB at most at two bytes an id.
GROUP_DOCS = 4096
#: Smaller gaps are padded, larger ones are filled by cutting a tail.
MIN_CUT = 32
#: Ids remembered by a worker for units of text that it has encoded, and the longest unit that is remembered.
KNOWN_IDS, KNOWN_BYTES = 4_000_000, 64
#: Units of this size and more are cut at more places.
LONG_UNIT = 1 << 16

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_ASCII_DIGIT = np.zeros(256, dtype=bool)
_ASCII_DIGIT[0x30:0x3A] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[*b".,;:!?"]] = True
_GRAPHIC = np.zeros(256, dtype=bool)
_GRAPHIC[0x21:0x7F] = True


def unit_starts(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the units of the texts begin: at each text, before white space that follows a character that surely isn't,
    and between a letter and one of ``.,;:!?``.

    Such characters are printable ASCII and those led by the byte C3, and such letters those of ASCII and of C3.
    """
    if not len(flat):
        return np.zeros(0, dtype=np.int64)
    solid = _GRAPHIC[flat]
    latin = flat[:-1] == 0xC3
    solid[1:] |= latin
    letter = _ASCII_LETTER[flat]
    letter[1:] |= latin & (flat[1:] != 0x97) & (flat[1:] != 0xB7)  # the signs of multiplication and division
    cut = np.zeros(len(flat), dtype=bool)
    cut[1:] = (_WHITE[flat[1:]] & solid[:-1]) | (_STOP[flat[1:]] & letter[:-1])
    cut[offsets[:-1][offsets[:-1] < len(flat)]] = True
    starts = np.flatnonzero(cut)
    sizes = np.diff(np.append(starts, len(flat)))
    extra = [_inner_cuts(flat, s, n) for s, n in zip(starts[sizes >= LONG_UNIT].tolist(), sizes[sizes >= LONG_UNIT].tolist(), strict=True)]
    return np.sort(np.concatenate([starts, *extra])) if extra else starts


def _inner_cuts(flat: np.ndarray, start: int, size: int) -> np.ndarray:
    """More cuts of a long unit: between ASCII letters and digits, and between an ideographic comma or stop and an ideograph of U+5000 to U+8FFF."""
    own = flat[start : start + size]
    a, b = own[:-1], own[1:]
    cut = (_ASCII_LETTER[a] & _ASCII_DIGIT[b]) | (_ASCII_DIGIT[a] & _ASCII_LETTER[b])
    if size > 3:
        stop = ((own[:-3] == 0xE3) & (own[1:-2] == 0x80) & (own[2:-1] == 0x82)) | ((own[:-3] == 0xEF) & (own[1:-2] == 0xBC) & (own[2:-1] == 0x8C))
        cut[2:] |= stop & (own[3:] >= 0xE5) & (own[3:] <= 0xE8)
    return np.flatnonzero(cut) + 1 + start


class Tokenizer:
    """A tokenizer file of the tokenizers library; units that come again are not encoded again."""

    def __init__(self, path: str) -> None:
        self.path = path
        self._made = None

    def __reduce__(self):
        return tokenizer_of, (self.path,)

    @property
    def library(self):
        if self._made is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs in parallel
            import tokenizers

            self._made = tokenizers.Tokenizer.from_file(self.path)
            self._forget()
        return self._made

    def _forget(self) -> None:
        self._seen: dict[bytes, int] = {}
        self._ids, self._sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _made_of(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the units in a row, and how many each has."""
        made = [e.ids for e in self.library.encode_batch_fast([u.decode("utf-8", "replace") for u in units], add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(made), np.int32), np.fromiter(map(len, made), np.int64, len(made))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the offsets of the texts in them."""
        self.library  # noqa: B018  loads it
        if len(self._ids) > KNOWN_IDS:
            self._forget()
        flat, offsets = joined(texts)
        starts = unit_starts(flat, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        coded = binary_from(flat, np.append(starts, len(flat))).dictionary_encode()
        codes, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
        new = [u for u in distinct if u not in self._seen]
        short, long = [u for u in new if len(u) <= KNOWN_BYTES], [u for u in new if len(u) > KNOWN_BYTES]
        ids, sizes = self._made_of(short)
        for u in short:
            self._seen[u] = len(self._seen)
        self._ids, self._sizes = np.concatenate([self._ids, ids]), np.concatenate([self._sizes, sizes])
        # long units rarely come again: they are known for these texts only
        more, more_sizes = self._made_of(long)
        place = self._seen | {u: len(self._seen) + k for k, u in enumerate(long)} if long else self._seen
        pool, size = np.concatenate([self._ids, more]), np.concatenate([self._sizes, more_sizes])
        first = np.cumsum(size) - size
        own = np.asarray([place[u] for u in distinct], dtype=np.int64)[codes]
        ends = np.concatenate([[0], np.cumsum(size[own])])
        return pool[gather(first[own], size[own])], ends[np.searchsorted(starts, offsets)]


@functools.cache
def tokenizer_of(path: str) -> Tokenizer:
    """One for each file and worker, so that what it remembers outlives a task."""
    return Tokenizer(path)


def _tail_kind(tokenizer: Tokenizer, end_id: int) -> str:
    """Two bytes an id where the vocabulary allows it."""
    return "<u2" if max(tokenizer.library.get_vocab_size(), end_id) <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, tokenizer: Tokenizer, end_id: int, sequence: int = SEQUENCE) -> DataFrame:
    """(doc_id, doc_tokens, crcs of the full sequences, tail ids, row) of each document."""

    kind = _tail_kind(tokenizer, end_id)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        ids, offsets = tokenizer.encode(text_array(batch.column("text")))
        n, crcs, tails = [], [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = np.append(ids[a:b], end_id).astype("<u4")
            full = len(own) // sequence
            n.append(len(own))
            crcs.append([zlib.crc32(own[k * sequence : (k + 1) * sequence]) for k in range(full)])
            tails.append(own[full * sequence :].astype(kind).tobytes())
        return [pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary())]

    fields = [T.StructField("doc_tokens", T.LongType()), T.StructField("crcs", T.ArrayType(T.LongType())), T.StructField("tail", T.BinaryType())]
    made = append_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", fields, compute).drop("text")
    return made.withColumn("row", F.monotonically_increasing_id())


def first_fit(sizes: list[int], room: int) -> tuple[list[int], list[int]]:
    """The bin of each size, put in the order given into the first bin with room, and the fill of the bins.

    ``tree`` is a tournament: a node holds the larger room of its two children, the leaves that of the bins.
    """
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    tree = [room] * (2 * leaves)
    bins, used = [], 0
    for size in sizes:
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        bins.append(at - leaves)
        used = max(used, at - leaves + 1)
        left = tree[at] = tree[at] - size
        while at > 1:
            other = tree[at ^ 1]
            at //= 2
            best = left if left > other else other
            if tree[at] == best:
                break
            left = tree[at] = best
    return bins, [room - tree[leaves + k] for k in range(used)]


def pack(sizes: list[int], room: int, min_cut: int = MIN_CUT) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, length) that hold every item whole or in parts."""
    order = sorted((k for k, n in enumerate(sizes) if n), key=lambda k: (-sizes[k], k))
    where, fill = first_fit([sizes[k] for k in order], room)
    held: list[list[tuple[int, int, int]]] = [[] for _ in fill]
    for k, b in zip(order, where, strict=True):
        held[b].append((k, 0, sizes[k]))
    gaps = sorted((b for b in range(len(fill)) if fill[b] < room), key=lambda b: (-fill[b], b))
    done = [held[b] for b in range(len(fill)) if fill[b] == room]
    top, low = 0, len(gaps) - 1
    while top < low:
        b, gap = gaps[top], room - fill[gaps[top]]
        while gap >= min_cut and top < low:
            e = gaps[low]
            k, start, n = held[e].pop()
            part = min(n, gap)
            held[b].append((k, start, part))
            if part < n:
                held[e].append((k, start + part, n - part))
            fill[e] -= part
            gap -= part
            if not fill[e]:
                low -= 1
        if gap >= min_cut:  # it is the last one
            break
        done.append(held[b])
        top += 1
    if top == low:
        done += _powers(held[gaps[low]], room)
    return done


def _powers(pieces: list[tuple[int, int, int]], room: int) -> list[list[tuple[int, int, int]]]:
    """The pieces cut into sequences whose lengths are falling powers of two."""
    out, left = [], sum(n for _, _, n in pieces)
    pieces = pieces[::-1]
    while left:
        size = min(room, 1 << (left.bit_length() - 1))
        left -= size
        own = []
        while size:
            k, start, n = pieces.pop()
            part = min(n, size)
            own.append((k, start, part))
            size -= part
            if part < n:
                pieces.append((k, start + part, n - part))
        out.append(own)
    return out


def packed(docs: DataFrame, tokenizer: Tokenizer, end_id: int = 1, sequence: int = SEQUENCE, group_docs: int = GROUP_DOCS, min_cut: int = MIN_CUT) -> DataFrame:
    """One row per piece: its document, place and checksum there, and its sequence and place there."""
    if sequence < 1 or group_docs < 1 or min_cut < 1:
        raise ValueError("sequence, group_docs and min_cut must be positive")
    kind = _tail_kind(tokenizer, end_id)
    rows = staged(encoded(docs, tokenizer, end_id, sequence), "packing")
    groups = max(1, -(-rows.count() // group_docs))

    def pieces_of(group: int, own: list[tuple]) -> Iterator[pa.RecordBatch]:
        own.sort(key=lambda r: r[4])
        tails = [np.frombuffer(r[3], dtype=kind).astype("<u4") for r in own]
        out = []
        number = group << 32
        for doc_id, tokens, crcs, _, _ in own:
            for k, crc in enumerate(crcs):
                out.append((doc_id, k * sequence, sequence, crc, tokens, number, 0))
                number += 1
        for held in pack([len(t) for t in tails], sequence, min_cut):
            offset = 0
            for k, start, n in held:
                doc_id, tokens, crcs = own[k][:3]
                out.append((doc_id, len(crcs) * sequence + start, n, zlib.crc32(tails[k][start : start + n]), tokens, number, offset))
                offset += n
            number += 1
        for i in range(0, len(out), 10_000):
            columns = zip(*out[i : i + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in PIECES.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in batches:
            for group, *row in zip(*(batch.column(c).to_pylist() for c in ("group", "doc_id", "doc_tokens", "crcs", "tail", "row")), strict=True):
                if group != now and own:
                    yield from pieces_of(now, own)
                    own = []
                now = group
                own.append(tuple(row))
        if own:
            yield from pieces_of(now, own)
        give_back()

    dealt = rows.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return dealt.repartition(groups, "group").sortWithinPartitions("group").mapInArrow(run, PIECES)
