"""Word runs of texts interned in an open-addressed NumPy table.

The words of a batch of texts stand in one buffer, joined by one space, so that every run of words is a slice of it.
A run's key is the xxhash64 of its bytes, computed for all runs of one length at once.  The table has one slot for each
different run: linear probing, and a slot is taken for a run only if its key, its length and its bytes agree.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Runs of more bytes are hashed and compared one by one.
LONG = 255
#: Words of more bytes get the checksums of their runs one by one.
LONG_WORD = 64

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


@dataclass
class Words:
    """Lower-cased words of some texts: ``joined`` bytes, each word's place in them, each text's first word (and the end)."""

    joined: np.ndarray
    start: np.ndarray
    end: np.ndarray
    texts: np.ndarray

    @functools.cached_property
    def lanes(self) -> np.ndarray:
        """The eight bytes from each place on, as a number."""
        return np.ndarray((len(self.joined) - 7,), "<u8", self.joined, strides=(1,))

    def bytes_of(self, start: int, size: int) -> bytes:
        return self.joined[start : start + size].tobytes()


def find_words(texts: pa.Array) -> Words:
    """Words are runs of ASCII letters, digits and all characters beyond ASCII; A to Z become small."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n, data = len(texts), texts.buffers()[2] if len(texts) else None
    none = np.zeros(0, np.int64)
    if data is None:
        return Words(np.full(8, 32, np.uint8), none, none, np.zeros(n + 1, np.int64))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = _LOWER[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    inside = _IN_WORD[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = np.unique(offsets[:-1])
    heads = heads[heads < len(raw)]
    first[heads] = inside[heads]  # a word ends where another text starts
    before = heads[heads > 0] - 1
    last[before] = inside[before]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = stop - start
    end = np.cumsum(size + 1) - 1
    joined = np.full((int(end[-1]) if len(end) else 0) + 9, 32, np.uint8)
    at = np.flatnonzero(inside)
    joined[at + np.repeat(end - size - start, size)] = raw[at]
    return Words(joined, end - size, end, np.searchsorted(start, offsets))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _lane(x: np.ndarray) -> np.ndarray:
    return _turn(x * _P2, 31) * _P1


def _hash_equal(lanes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """xxhash64 (seed 0) of the runs of ``size`` bytes at the given places."""
    done = 0
    with np.errstate(over="ignore"):
        if size >= 32:
            v = [np.full(len(at), x, np.uint64) for x in (_P1 + _P2, _P2, np.uint64(0), np.uint64(0) - _P1)]
            while done + 32 <= size:
                v = [_turn(x + lanes[at + (done + 8 * i)] * _P2, 31) * _P1 for i, x in enumerate(v)]
                done += 32
            h = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
            for x in v:
                h = (h ^ _lane(x)) * _P1 + _P4
        else:
            h = np.full(len(at), _P5, np.uint64)
        h += np.uint64(size)
        while done + 8 <= size:
            h = _turn(h ^ _lane(lanes[at + done]), 27) * _P1 + _P4
            done += 8
        if done < size:
            rest = lanes[at + done]
            if done + 4 <= size:
                h = _turn(h ^ (rest & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
                rest = rest >> np.uint64(32)
                done += 4
            while done < size:
                h = _turn(h ^ (rest & np.uint64(255)) * _P5, 11) * _P1
                rest = rest >> np.uint64(8)
                done += 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def _by_length(start: np.ndarray, size: np.ndarray, longest: int, together: Callable, alone: Callable, kind: type) -> np.ndarray:
    """A value of each run: of all runs of one length together, of longer ones one by one."""
    out = np.empty(len(start), kind)
    order = np.argsort(np.minimum(size, longest + 1).astype(np.uint16), kind="stable")
    sizes = size[order]
    cuts = [*np.flatnonzero(np.r_[True, sizes[1:] != sizes[:-1]]).tolist(), len(order)] if len(order) else [0]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        rows = order[lo:hi]
        if sizes[lo] <= longest:
            out[rows] = together(start[rows], int(sizes[lo]))
        else:
            out[rows] = [alone(s, n) for s, n in zip(start[rows].tolist(), size[rows].tolist(), strict=True)]
    return out


def run_hashes(words: Words, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """xxhash64 of the given runs."""
    return _by_length(start, size, LONG, lambda at, n: _hash_equal(words.lanes, at, n), lambda s, n: xxhash.xxh64_intdigest(words.bytes_of(s, n)), np.uint64)


def equal_runs(words: Words, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether runs of equal length have equal bytes."""
    out = np.ones(len(a), bool)
    for i in np.flatnonzero((size > LONG) & (a != b)).tolist():
        out[i] = words.bytes_of(a[i], size[i]) == words.bytes_of(b[i], size[i])
    left, done = np.flatnonzero((size <= LONG) & (a != b)), 0
    while len(left):
        mask = _MASKS[np.minimum(size[left] - done, 8)]
        same = ((words.lanes[a[left] + done] ^ words.lanes[b[left] + done]) & mask) == 0
        out[left[~same]] = False
        done += 8
        left = left[same & (size[left] > done)]
    return out


@functools.cache
def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The byte table of CRC-32, and by length the effect of so many following bytes on each byte of a checksum."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    moved = [np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * b) for b in range(4)])]
    for _ in range(LONG_WORD):
        moved.append(table[moved[-1] & np.uint32(255)] ^ (moved[-1] >> np.uint32(8)))
    return table, np.concatenate(moved)


def _crc_equal(lanes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """CRC-32 of the runs of ``size`` bytes at the given places."""
    table, c = _crc_tables()[0], np.full(len(at), 0xFFFFFFFF, np.uint32)
    for done in range(0, size, 8):
        lane = lanes[at + done]
        for _ in range(min(8, size - done)):
            c = table[(c ^ lane.astype(np.uint32)) & np.uint32(255)] ^ (c >> np.uint32(8))
            lane = lane >> np.uint64(8)
    return ~c


def crc_joined(left: np.ndarray, right: np.ndarray, right_size: np.ndarray) -> np.ndarray:
    """CRC-32 of left, a space and right, from the checksums of both; right has at most LONG_WORD bytes."""
    table, moved = _crc_tables()
    c = ~left
    c = ~(table[(c ^ np.uint32(32)) & np.uint32(255)] ^ (c >> np.uint32(8)))
    at = right_size * 1024
    out = right.copy()
    for b in range(4):
        out ^= moved[at + 256 * b + ((c >> np.uint32(8 * b)) & np.uint32(255))]
    return out


class RunTable:
    """Open addressing with linear probing: one slot for each different run of bytes, with its key, place and length."""

    def __init__(self, words: Words, runs: int):
        self.words = words
        self.capacity = 1 << max(4, (2 * runs).bit_length())
        self.mask = np.uint64(self.capacity - 1)
        self.key = np.zeros(self.capacity, np.uint64)
        self.at = np.full(self.capacity, -1, np.int32)
        self.size = np.zeros(self.capacity, np.int32)

    def intern(self, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each run, and which runs were the first of their kind.  Runs of one call start at different places."""
        keys = run_hashes(self.words, start, size)
        out, made = np.empty(len(keys), np.int64), []
        todo, slot = np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        while len(todo):
            empty = self.at[slot] < 0
            claim, place = todo[empty], slot[empty]
            self.at[place] = start[claim]  # of several that want a slot, one stays
            won = self.at[place] == start[claim]
            new, place = claim[won], place[won]
            self.key[place], self.size[place] = keys[new], size[new]
            made.append(new)
            out[new] = place
            if len(new) == len(todo):
                break
            left = np.ones(len(todo), bool)
            left[np.flatnonzero(empty)[won]] = False
            todo, slot = todo[left], slot[left]
            same = (self.key[slot] == keys[todo]) & (self.size[slot] == size[todo])
            hit = np.flatnonzero(same)
            same[hit] = equal_runs(self.words, self.at[slot[hit]], start[todo[hit]], size[todo[hit]])
            out[todo[same]] = slot[same]
            todo, slot = todo[~same], (slot[~same] + 1) & int(self.mask)
        return out, np.concatenate(made) if made else np.zeros(0, np.int64)


class NgramTable(RunTable):
    """The runs of 1 to ``longest`` words of a batch, each slot with its bucket and count."""

    def __init__(self, words: Words, buckets: int, longest: int = 3):
        super().__init__(words, longest * len(words.start))
        self.buckets, self.longest = buckets, longest
        self.bucket = np.zeros(self.capacity, np.int32)
        self.count = np.zeros(self.capacity, np.int64)
        self._crc = np.zeros(len(words.start), np.uint32)  # by word
        self.occurrences = [self._add(n) for n in range(1, longest + 1)]
        for _, slots in self.occurrences:
            self.count += np.bincount(slots, minlength=self.capacity)

    def _add(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first words of all runs of n words, and the runs' slots."""
        w = self.words
        stop = np.repeat(w.texts[1:], np.diff(w.texts))
        first = np.flatnonzero(np.arange(len(w.start)) + n <= stop)
        start = w.start[first]
        size = w.end[first + n - 1] - start
        slots, made = self.intern(start, size)
        crc = self._crc_of(first[made], n, start[made], size[made])
        self.bucket[slots[made]] = crc.astype(np.int64) % self.buckets
        if n == 1:
            by_slot = np.zeros(len(self.key), np.uint32)
            by_slot[slots[made]] = crc
            self._crc = by_slot[slots]
        return first, slots

    def _crc_of(self, first: np.ndarray, n: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        w = self.words
        if n == 1:
            return _by_length(start, size, LONG_WORD, lambda at, k: _crc_equal(w.lanes, at, k), lambda s, k: zlib.crc32(w.bytes_of(s, k)), np.uint32)
        out, long = self._crc[first], np.zeros(len(first), bool)
        for k in range(1, n):
            length = w.end[first + k] - w.start[first + k]
            long |= length > LONG_WORD
            out = crc_joined(out, self._crc[first + k], np.minimum(length, LONG_WORD))
        for i in np.flatnonzero(long).tolist():
            out[i] = zlib.crc32(w.bytes_of(start[i], size[i]))
        return out

    def histogram(self) -> np.ndarray:
        """Occurrences by bucket."""
        used = np.flatnonzero(self.count)
        out = np.zeros(self.buckets, np.int64)
        np.add.at(out, self.bucket[used], self.count[used])
        return out

    def sums(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By text: the number of its runs and the sum of their buckets' gains."""
        by_slot = gains[self.bucket]
        number, total = np.zeros(len(self.words.start) + 1, np.int64), np.zeros(len(self.words.start) + 1, np.int64)
        for first, slots in self.occurrences:
            number[first + 1] += 1
            total[first + 1] += by_slot[slots]
        return np.diff(np.cumsum(number)[self.words.texts]), np.diff(np.cumsum(total)[self.words.texts])
