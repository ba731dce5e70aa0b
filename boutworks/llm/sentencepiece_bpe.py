"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Texts are cut where no piece of the vocabulary can cross, each distinct segment
of a chunk is encoded once, and the ids are gathered back per document. The
merge rounds work on flat numpy symbol arrays: in each round every segment finds
the pair of its best-ranked merge (segmented minimum), merges it leftmost first,
and the arrays are compacted until no pair remains. Occurrences of that pair in
one segment are merged at once only where no new pair could rank before it.

Segments are also cut where two characters stand side by side in no piece, since no
merge crosses such a place. In long segments, as texts without white space have them,
every pair that ranks first among the ``reach`` symbols on each side is merged in the
same round, where ``reach`` is the length of the longest piece: what is merged before
it further away would have to grow into a longer piece than there is to touch it, and
nothing nearer is merged before it. So the rounds don't grow with the text's length.

Defined cases: a null or empty text encodes to the begin and end ids alone and
decodes to the empty string; a literal U+2581 decodes to a space, as in the
sentencepiece library; bytes that aren't UTF-8 become U+FFFD before encoding;
repeated rows are encoded each; a very long text is a chunk of its own and encoded
whole; of equal merges in a segment the leftmost is first; an empty table has an
empty result. Input columns named like an output are replaced.
"""

from __future__ import annotations

import codecs
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutworks.llm._batches import append_columns, binary_from, codes_of, gather, joined, text_array

MAX_MODEL_BYTES = 64 << 20
#: Encoded segments that a worker keeps for the next chunks.
KNOWN_SEGMENTS = 200_000
#: Text bytes encoded at once.
ENCODE_BYTES = 1 << 20
#: Bytes of the longest segment that is kept for the next chunks.
KNOWN_BYTES = 64
_SPACE = 0x2581
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_NONE = np.iinfo(np.int32).max


def _fields(raw: bytes):
    """(number, wire type, value) of each field of a protobuf message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(raw):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 1:
            value, i = raw[i : i + 8], i + 8
        elif kind == 2:
            size, i = varint(i)
            value, i = raw[i : i + size], i + size
        else:
            value, i = raw[i : i + 4], i + 4
        yield tag >> 3, kind, value


@dataclass
class BpeModel:
    """Lookup arrays of a BPE model file with identity normalisation."""

    pieces: list[bytes]
    kinds: np.ndarray
    chars: np.ndarray  # sorted code points that are pieces
    char_ids: np.ndarray
    pair_keys: np.ndarray  # sorted left id * size + right id
    pair_ids: np.ndarray
    rank: np.ndarray  # of each piece; equal scores share a rank
    alone: np.ndarray  # merging all occurrences of this piece at once could change the order
    bos: int
    eos: int
    unk: int
    byte_ids: np.ndarray | None
    barrier: bool  # a line feed is in no piece of several characters
    beside: np.ndarray  # sorted (left << 21 | right) of characters that stand side by side in a piece
    reach: int  # characters of the longest piece

    @classmethod
    def parse(cls, raw: bytes) -> BpeModel:
        pieces, scores, kinds, normalizer, trainer = [], [], [], {}, {}
        for number, _, value in _fields(raw):
            if number == 1:
                parts = {n: v for n, _, v in _fields(value)}
                pieces.append(bytes(parts.get(1, b"")))
                scores.append(np.frombuffer(parts.get(2, b"\0\0\0\0"), "<f4")[0])
                kinds.append(parts.get(3, _NORMAL))
            elif number == 2:
                trainer = {n: v for n, _, v in _fields(value)}
            elif number == 3:
                normalizer = {n: v for n, _, v in _fields(value)}
        if trainer.get(3, 1) != 2 or normalizer.get(1, b"") != b"identity" or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("a BPE model with identity normalisation, a dummy prefix and kept white space is needed")
        kinds = np.array(kinds, dtype=np.int8)
        if np.isin(kinds, (_USER, _UNUSED)).any():
            raise ValueError("user-defined or unused pieces aren't supported")
        size = len(pieces)
        text = [p.decode() for p in pieces]
        of = {t: i for i, t in enumerate(text) if kinds[i] == _NORMAL}
        if any("▁" in t.lstrip("▁") for t in of):
            raise ValueError("a piece crosses a word boundary")
        order = {s: r for r, s in enumerate(sorted({float(scores[i]) for i in of.values()}, reverse=True))}
        rank = np.full(size + 1, _NONE, dtype=np.int32)
        for i in of.values():
            rank[i] = order[float(scores[i])]
        pairs = {}
        alone = np.zeros(size, dtype=bool)
        for t, i in of.items():
            for cut in range(1, len(t)):
                left, right = of.get(t[:cut]), of.get(t[cut:])
                if left is not None and right is not None:
                    pairs[left * size + right] = i
                    for part in (left, right):
                        alone[part] |= rank[i] <= rank[part]
        keys = np.array(sorted(pairs), dtype=np.int64)
        chars = sorted((ord(t), i) for t, i in of.items() if len(t) == 1)
        byte_ids = np.flatnonzero(kinds == _BYTE)
        return cls(
            pieces, kinds, np.array([c for c, _ in chars], dtype=np.int64), np.array([i for _, i in chars], dtype=np.int64),
            keys, np.array([pairs[k] for k in keys.tolist()], dtype=np.int64), rank, alone,
            trainer.get(41, 1), trainer.get(42, 2), trainer.get(40, 0), byte_ids if len(byte_ids) == 256 else None,
            not any("\n" in t for t in of if len(t) > 1),
            np.array(sorted({ord(a) << 21 | ord(b) for t in of for a, b in zip(t, t[1:], strict=False)}), dtype=np.int64), max(map(len, of), default=1),
        )

    def encode_segments(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments, flat, and the number of ids of each."""
        flat, offsets = joined(segments)
        points = np.frombuffer(flat.tobytes().decode().encode("utf-32-le"), dtype="<u4").astype(np.int64)
        at = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])[offsets]
        points[points == 0x20] = _SPACE
        where = np.minimum(np.searchsorted(self.chars, points), len(self.chars) - 1)
        sym = np.where(self.chars[where] == points, self.char_ids[where], -1 - points)
        seg = np.repeat(np.arange(len(segments), dtype=np.int32), np.diff(at))
        whole, fresh = seg, np.ones(len(sym), dtype=bool)
        if len(sym) > 1 and len(self.beside):
            pair = points[:-1] << 21 | points[1:]
            near = np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)
            fresh[1:] = (seg[1:] != seg[:-1]) | (self.beside[near] != pair)
        seg = np.cumsum(fresh, dtype=np.int32) - 1  # the pieces of the segments, in the same order
        parent = whole[fresh]
        made = self._pairs(sym, seg, np.arange(len(sym)))
        done_seg, done_sym = [], []
        while len(sym):
            sym, seg, made, over = self._round(sym, seg, made)
            done_seg.append(seg[over])
            done_sym.append(sym[over])
            keep = ~over
            sym, seg, made = sym[keep], seg[keep], made[keep]
        seg = np.concatenate(done_seg) if done_seg else np.zeros(0, np.int32)
        sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
        order = np.argsort(seg, kind="stable")
        return self._spell(sym[order], parent[seg[order]] if len(seg) else seg, len(segments))

    def _pairs(self, sym: np.ndarray, seg: np.ndarray, where: np.ndarray) -> np.ndarray:
        """The piece that each symbol of ``where`` makes with its right neighbour, or -1."""
        made = np.full(len(where), -1, dtype=np.int32)
        right = np.minimum(where + 1, len(sym) - 1)
        able = np.flatnonzero((where + 1 < len(sym)) & (seg[where] == seg[right]) & (sym[where] >= 0) & (sym[right] >= 0))
        if len(able) and len(self.pair_keys):
            key = sym[where[able]] * len(self.pieces) + sym[right[able]]
            near = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            made[able] = np.where(self.pair_keys[near] == key, self.pair_ids[near], -1)
        return made

    def _round(self, sym: np.ndarray, seg: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, ...]:
        """One merge round; the last result marks symbols of finished segments.

        ``made`` holds the piece of each pair; only pairs beside a merge are looked up again.
        """
        rank = self.rank[made]  # -1 picks the sentinel at the end
        heads = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        sizes = np.diff(np.append(heads, len(sym)))
        best = np.repeat(np.minimum.reduceat(rank, heads), sizes)
        over = best == _NONE
        take = (rank == best) & ~over
        at = np.flatnonzero(take)
        if len(at):
            # the first of each segment, and every second one of overlapping runs
            lead = np.concatenate([[True], seg[at[1:]] != seg[at[:-1]]])
            begin = lead | np.concatenate([[True], at[1:] != at[:-1] + 1])
            spot = np.arange(len(at))
            odd = (spot - np.maximum.accumulate(np.where(begin, spot, 0))) % 2 == 1
            first = np.maximum.accumulate(np.where(lead, spot, 0))
            at = at[np.where(self.alone[made[at[first]]], lead, ~odd)]
            if sizes.max() > 4 * self.reach:
                wide = np.flatnonzero(self._firsts(rank) & (np.repeat(sizes, sizes) > 4 * self.reach) & ((rank > best) | self.alone[made]) & ~over)
                at = np.union1d(at, wide)
        sym[at] = made[at]
        stay = np.ones(len(sym), dtype=bool)
        stay[at + 1] = False
        fresh = at - np.arange(len(at))
        sym, seg, made, over = sym[stay], seg[stay], made[stay], over[stay]
        around = np.concatenate([fresh, fresh[fresh > 0] - 1])
        made[around] = self._pairs(sym, seg, around)
        return sym, seg, made, over

    def _firsts(self, rank: np.ndarray) -> np.ndarray:
        """Pairs that rank before all within ``reach`` on their left and not after any on their right."""
        n, padded = len(rank), np.concatenate([np.full(self.reach, _NONE, rank.dtype), rank, np.full(self.reach, _NONE, rank.dtype)])
        # minima of ``reach`` neighbours, by doubling: low[i] is that of padded[i : i + width]
        low, width = padded, 1
        while width < self.reach:
            step = min(width, self.reach - width)
            low = np.minimum(low[: len(low) - step], low[step:])
            width += step
        left, right = low[:n], low[self.reach + 1 :][:n]
        right = np.concatenate([right, np.full(n - len(right), _NONE, rank.dtype)])
        return (rank < left) & (rank <= right) & (rank != _NONE)

    def _spell(self, sym: np.ndarray, seg: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become byte pieces, or the unknown piece."""
        missing = np.flatnonzero(sym < 0)
        if len(missing):
            if self.byte_ids is None:
                sym = np.where(sym < 0, self.unk, sym)
            else:
                raw = [chr(-1 - s).encode("utf-8") for s in sym[missing].tolist()]
                width = np.ones(len(sym), dtype=np.int64)
                width[missing] = [len(r) for r in raw]
                seg, wide = np.repeat(seg, width), np.repeat(sym, width)
                wide[wide < 0] = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
                sym = wide
        return sym, np.bincount(seg, minlength=count)

    def segments(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The texts with their dummy prefix, cut where no piece crosses; the row of each segment."""
        flat, offsets = joined(texts)
        sizes = np.diff(offsets)
        rows = np.flatnonzero(sizes)
        filled = np.full(len(flat) + len(rows), 0x20, dtype=np.uint8)
        heads = np.concatenate([[0], np.cumsum(sizes[rows] + 1)])
        filled[gather(heads[:-1] + 1, sizes[rows])] = flat
        # a literal U+2581 cuts like the space it stands for
        blank = filled == 0x20
        low = np.flatnonzero((filled[:-2] == 0xE2) & (filled[1:-1] == 0x96) & (filled[2:] == 0x81)) if len(filled) > 2 else np.zeros(0, np.int64)
        start, before = blank.copy(), np.concatenate([[False], blank[:-1]])
        start[low] = True
        if len(low):
            after = low + 3
            before[after[after < len(filled)]] = True
        cut = start & ~before
        if self.barrier:
            line = filled == 0x0A
            cut |= line
            cut[1:] |= line[:-1]
        cut[heads[:-1]] = True
        starts = np.flatnonzero(cut)
        row = rows[np.searchsorted(heads, starts, side="right") - 1] if len(rows) else starts
        return binary_from(filled, np.append(starts, len(filled))), row

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts with begin and end ids, flat, and the ends of the rows."""
        texts = _valid(texts)
        pieces, row = self.segments(texts)
        codes, distinct = codes_of(pieces)
        ids, starts, sizes = self._known(distinct)
        starts, own = starts[codes], sizes[codes]
        body = ids[gather(starts, own)]
        counts = np.bincount(row, weights=own, minlength=len(texts)).astype(np.int64) if len(row) else np.zeros(len(texts), np.int64)
        ends = np.cumsum(counts + 2)
        out = np.full(int(ends[-1]) if len(ends) else 0, self.bos, dtype="<u4")
        out[gather(ends - counts - 1, counts)] = body
        out[ends - 1] = self.eos
        return out, ends

    def _known(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts and sizes of the segments; short ones met before in this worker aren't encoded again.

        Long segments rarely come again: nothing of them is kept.
        """
        if not hasattr(self, "_seen") or len(self._seen) > KNOWN_SEGMENTS:
            self._seen, self._ids, self._sizes = {}, np.zeros(0, np.int32), np.zeros(0, np.int64)
        words = distinct.to_pylist()
        spot = np.fromiter((self._seen.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        new = np.flatnonzero(spot < 0)
        long = np.fromiter((len(words[i]) > KNOWN_BYTES for i in new.tolist()), dtype=bool, count=len(new))
        new = np.concatenate([new[~long], new[long]])
        kept = len(new) - int(long.sum())
        ids, sizes = self.encode_segments(distinct.take(pa.array(new)))
        spot[new] = len(self._sizes) + np.arange(len(new))
        self._seen.update((words[i], j) for i, j in zip(new[:kept].tolist(), spot[new[:kept]].tolist(), strict=True))
        known = int(sizes[:kept].sum())
        every, every_sizes = np.concatenate([self._ids, ids.astype(np.int32)]), np.concatenate([self._sizes, sizes])
        self._ids, self._sizes = every[: len(self._ids) + known].copy(), every_sizes[: len(self._sizes) + kept]
        return every, (np.cumsum(every_sizes) - every_sizes)[spot], every_sizes[spot]

    def decode(self, rows: list[bytes]) -> list[str]:
        """Texts of packed ids."""
        table, starts, sizes = self._bytes()
        out = []
        for row in rows:
            ids = np.frombuffer(row, dtype="<u4").astype(np.int64)
            if ((ids >= len(self.pieces)).any()):
                raise ValueError("an id is outside the vocabulary")
            text = table[gather(starts[ids], sizes[ids])].tobytes()
            shown = ids[self.kinds[ids] != _CONTROL]
            if len(shown) and self.pieces[shown[0]].startswith("▁".encode()):
                text = text[1:]
            out.append(text.decode("utf-8", "boutworks_each"))
        return out

    def _bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not hasattr(self, "_table"):
            said = []
            for piece, kind in zip(self.pieces, self.kinds.tolist(), strict=True):
                if kind == _BYTE:
                    said.append(bytes([int(piece[3:5], 16)]))
                elif kind == _CONTROL:
                    said.append(b"")
                elif kind == _UNKNOWN:
                    said.append(" ⁇ ".encode())
                else:
                    said.append(piece.replace("▁".encode(), b" "))
            sizes = np.array([len(s) for s in said], dtype=np.int64)
            self._table = (np.frombuffer(b"".join(said), dtype=np.uint8), np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes)
        return self._table


def _each(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("boutworks_each", _each)


def _valid(texts: pa.Array) -> pa.Array:
    try:
        joined(texts)[0].tobytes().decode()
        return texts
    except UnicodeDecodeError:
        return pa.array([t.decode("utf-8", "boutworks_each").encode() for t in texts.to_pylist()], pa.large_binary())


_models: dict[int, BpeModel] = {}


def _model(shared) -> BpeModel:
    """The parsed model of a broadcast, once per Python worker."""
    if shared.id not in _models:
        _models.clear()
        _models[shared.id] = BpeModel.parse(shared.value)
    return _models[shared.id]


class _Shared:
    """A broadcast with its id, which survives pickling."""

    def __init__(self, spark, raw: bytes):
        self.broadcast = spark.sparkContext.broadcast(raw)
        self.id = hash(raw)

    @property
    def value(self) -> bytes:
        return self.broadcast.value


def _load(spark, path: str) -> _Shared:
    with open(path, "rb") as f:
        raw = f.read()
    if len(raw) > MAX_MODEL_BYTES:
        raise ValueError("the model file is too large to broadcast")
    return _Shared(spark, raw)


def encode(df: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the packed ids of ``text_col``: little-endian unsigned 32-bit, begin and end ids included.

    A column named like ``ids_col`` is replaced.
    """
    shared = _load(df.sparkSession, model_path)

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        ids, ends = _model(shared).encode(text_array(part.column(text_col)))
        offsets = np.concatenate([[0], ends * 4])
        return [binary_from(ids.view(np.uint8), offsets).cast(pa.binary())]

    return append_columns(df, text_col, [T.StructField(ids_col, T.BinaryType())], compute, ENCODE_BYTES)


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of its packed ids; null ids decode to the empty string."""
    shared = _load(df.sparkSession, model_path)

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        rows = [r or b"" for r in part.column(ids_col).to_pylist()]
        return [pa.array(_model(shared).decode(rows), pa.string())]

    return append_columns(df, ids_col, [T.StructField(text_col, T.StringType())], compute, ENCODE_BYTES)


def digests(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``documents``."""
    coded = encode(documents.select("doc_id", "text"), model_path).select("doc_id", "ids")
    read = decode(coded, model_path)
    return read.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
