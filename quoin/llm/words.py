"""Hashes of words and of word shingles, taken straight from the bytes of an Arrow text column."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random value for each byte; A-Z have those of a-z.
_VALUE = mix64(np.arange(256, dtype=np.uint64), 3)
_VALUE[65:91] = _VALUE[97:123]
_P = 0x9E3779B97F4A7C15 | 1
_Q = pow(_P, -1, 1 << 64)
#: Bytes of text that are hashed at once: some dozen arrays of eight times the size are held for them.
SLICE = 1 << 18
#: Words of more bytes are hashed one by one: sums of powers modulo 2**64 no longer tell long words of a regular pattern apart.
LONG = 128
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets at which they begin; null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        col, kind = col.cast(pa.string()), np.int32
    if col.null_count:
        col = pc.fill_null(col, "")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def byte_slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `most` bytes together; a longer text is alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_hashes(col: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges lo..hi of the texts: a 64-bit hash per word (A-Z as a-z), and where each text's words begin."""
    for lo, hi, words, at, _ in word_stem_hashes(col, (), most):
        yield lo, hi, words, at


def word_stem_hashes(col: pa.Array, lengths: tuple, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list]]:
    """As word_hashes, and for each length the places of longer words and the hashes of that many first bytes."""
    data, offsets = text_bytes(col)
    for lo, hi in byte_slices(offsets, most):
        seg, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if not len(seg):
            yield lo, hi, np.zeros(0, np.uint64), np.zeros(hi - lo + 1, np.int64), []
            continue
        inside = ~_SPACE[seg]
        before = np.empty(len(seg) + 1, bool)
        before[0], before[1:] = False, inside
        before[at[:-1][at[:-1] < len(seg)]] = False
        first = inside & ~before[:-1]
        starts = np.flatnonzero(first)
        going = np.zeros(len(seg) + 1, bool)
        going[:-1] = inside & ~first  # the word goes on here
        ends = np.flatnonzero(inside & ~going[1:]) + 1
        total = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(_VALUE[seg] * _power(_P, len(seg)), out=total[1:])
        back = _power(_Q, len(seg))
        hashes = mix64((total[ends] - total[starts]) * back[starts])
        for i in np.flatnonzero(ends - starts > LONG):
            hashes[i] = int.from_bytes(hashlib.blake2b(seg[starts[i] : ends[i]].tobytes().lower(), digest_size=8).digest(), "little")
        stems = []
        for n in lengths:
            long = np.flatnonzero(ends - starts > n)
            s = starts[long]
            stems.append((long, mix64((total[s + n] - total[s]) * back[s], 40 + n)))
        yield lo, hi, hashes, np.searchsorted(starts, at).astype(np.int64), stems


def shingle_sets(col: pa.Array, k: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """For ranges of the texts: each text's sorted distinct hashes of k words; fewer words are one shingle."""
    for lo, hi, words, at in word_hashes(col):
        grams = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for j in range(k):
            grams += mix64(words[j : j + len(grams)], 20 + j)
        grams = mix64(grams)
        sets = []
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= k:
                sets.append(np.unique(grams[a : b - k + 1]))
            elif b > a:
                whole = sum((mix64(words[a + j : a + j + 1], 20 + j) for j in range(b - a)), np.array([b - a], np.uint64))
                sets.append(mix64(whole, 5))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield lo, hi, sets
