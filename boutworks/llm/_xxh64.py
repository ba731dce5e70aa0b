"""XXH64 of many byte strings of one buffer, vectorised by length."""

from __future__ import annotations

import numpy as np
import xxhash

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Longer strings, and lengths that few strings have, go through the library call.
_LONGEST, _FEWEST = 512, 8


def _rotate(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotate(acc + lane * _P2, 31) * _P1


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def xxh64(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """Unsigned 64-bit hashes of flat[start : start + length]."""
    out = np.empty(len(starts), dtype=np.uint64)
    padded = np.concatenate([flat, np.zeros(8, dtype=np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, shape=(len(flat) + 1, 8), strides=(1, 1))
    order = np.argsort(lengths, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(lengths[order])) + 1, len(order)) if len(order) else []
    begin = 0
    raw = memoryview(padded)
    with np.errstate(over="ignore"):
        for end in ends:
            own = order[begin:end]
            begin = end
            size = int(lengths[own[0]])
            if size > _LONGEST or len(own) < _FEWEST:
                out[own] = [xxhash.xxh64_intdigest(raw[s : s + size], seed) for s in starts[own].tolist()]
            else:
                out[own] = _equal(words, padded, starts[own], size, np.uint64(seed))
    return out


def _equal(words: np.ndarray, flat: np.ndarray, at: np.ndarray, size: int, seed: np.uint64) -> np.ndarray:
    lane = lambda offset: np.ascontiguousarray(words[at + offset]).view("<u8").ravel()
    done = 0
    if size >= 32:
        acc = [np.full(len(at), v, dtype=np.uint64) for v in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
        while done + 32 <= size:
            acc = [_round(a, lane(done + 8 * k)) for k, a in enumerate(acc)]
            done += 32
        h = _rotate(acc[0], 1) + _rotate(acc[1], 7) + _rotate(acc[2], 12) + _rotate(acc[3], 18)
        for a in acc:
            h = (h ^ _round(np.zeros_like(a), a)) * _P1 + _P4
    else:
        h = np.full(len(at), seed + _P5, dtype=np.uint64)
    h = h + np.uint64(size)
    while done + 8 <= size:
        h = _rotate(h ^ _round(np.zeros_like(h), lane(done)), 27) * _P1 + _P4
        done += 8
    if done + 4 <= size:
        four = lane(done) & np.uint64(0xFFFFFFFF)
        h = _rotate(h ^ (four * _P1), 23) * _P2 + _P3
        done += 4
    while done < size:
        h = _rotate(h ^ (flat[at + done].astype(np.uint64) * _P5), 11) * _P1
        done += 1
    return _finish(h)
