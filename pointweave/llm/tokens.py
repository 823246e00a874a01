"""Hashes of the words of texts, straight from their UTF-8 bytes and for many texts at once.

A word is a run of bytes without ASCII white space.  Its hash is a polynomial of its bytes modulo 2^64, taken from
running sums, and mixed; so no word becomes a Python object and nothing is remembered between texts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes that are hashed at once, so that they stay in a processor's cache.
PIECE = 1 << 16
#: Bytes of text in a slice of a batch, unless one text has more.
SLICE = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S31 = np.uint64(29), np.uint64(31)

_IN_WORD = np.ones(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BACK):
        p = np.full(PIECE, base)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S31)) * _M1
    h = (h ^ (h >> _S29)) * _M2
    return h ^ (h >> _S31)


def _hash_piece(raw: np.ndarray, starts_of_texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of at most PIECE bytes, and each word's first byte; a word ends where another text starts."""
    inside = _IN_WORD[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[starts_of_texts] = inside[starts_of_texts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = starts_of_texts[starts_of_texts > 0] - 1
    last[before] = inside[before]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    powers, back = _powers()
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * back[start]), start


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of some texts, and the position of each text's first one (with the end as last)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    data = texts.buffers()[2] if n else None
    if data is None:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if lower:
        raw = _LOWER[raw]
    text_starts = np.unique(offsets[:-1])
    hashes, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(raw):
        stop = min(at + PIECE, len(raw))
        lo, hi = np.searchsorted(text_starts, [at, stop])
        if stop < len(raw) and _IN_WORD[raw[stop]] and (hi == len(text_starts) or text_starts[hi] != stop):
            blank = np.flatnonzero(~_IN_WORD[raw[at:stop]])
            back = max(int(blank[-1]) + 1 if len(blank) else 0, int(text_starts[hi - 1]) - at if hi > lo else 0)
            if back:
                stop = at + back
                hi = np.searchsorted(text_starts, stop)
            else:  # a word longer than a piece
                blank = np.flatnonzero(~_IN_WORD[raw[stop:]])
                stop = min(stop + int(blank[0]) if len(blank) else len(raw), int(text_starts[hi]) if hi < len(text_starts) else len(raw))
                hashes.append(np.array([xxhash.xxh64_intdigest(raw[at:stop].tobytes())], np.uint64))
                starts.append(np.array([at]))
                at = stop
                continue
        own, first = _hash_piece(raw[at:stop], text_starts[lo:hi] - at)
        hashes.append(own)
        starts.append(first + at)
        at = stop
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts have at most so many bytes together; a longer text is a slice of its own."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop
