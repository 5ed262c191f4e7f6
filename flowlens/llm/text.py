"""Vectorised views of Arrow text columns: bytes, words, shingles and their hashes.

Everything works on whole texts, a few megabytes of them at a time, and uses fixed
constants only, so any worker on any machine gets the same hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
U64 = np.uint64


def _fold_table() -> np.ndarray:
    """Byte to folded byte; 0 where no word can be. Bytes from 128 on belong to words."""
    table = np.zeros(256, np.uint8)
    for b in range(256):
        if b >= 128 or chr(b).isalnum():
            table[b] = ord(chr(b).lower()) if b < 128 else b
    return table


FOLD = _fold_table()


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64; wraps modulo 2**64."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h = h * U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


POWERS = mix(np.arange(1, 4097, dtype=U64)) | U64(1)


def to_binary16(hi: np.ndarray, lo: np.ndarray) -> pa.Array:
    """Pairs of 64-bit hashes as 16-byte values."""
    both = np.empty((len(hi), 2), ">u8")
    both[:, 0], both[:, 1] = hi, lo
    offsets = np.arange(len(hi) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(hi), [None, pa.py_buffer(offsets), pa.py_buffer(both.tobytes())])


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a string column with their bytes: (first, end, bytes, offsets from 0).

    NULL counts as empty. A chunk holds ``most`` bytes or one longer text.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


class Words:
    """The words of some texts: runs of letters and digits, lower-cased in ASCII and Latin-1.

    ``start``/``end`` are byte positions in the chunk, ``doc`` the text's number in
    the chunk, ``count`` the words of each text, ``hash`` a 64-bit hash of each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        folded = FOLD[data]
        if len(data) > 1:  # the capitals of Latin-1 are C3 80 to C3 9E, their small letters 20 higher
            upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
            folded[1:][upper] += 0x20
        inside = folded != 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edge = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[edge] = inside[edge]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | begins[1:]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.offsets = offsets
        bound = np.searchsorted(self.start, offsets)
        self.first = bound[:-1]
        self.count = np.diff(bound)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        if len(self.start):
            length = self.end - self.start
            at = np.flatnonzero(inside)
            first = np.zeros(len(length), np.int64)
            np.cumsum(length[:-1], out=first[1:])
            place = np.arange(len(at)) - np.repeat(first, length)
            value = (folded[at].astype(U64) + U64(1)) * POWERS[place & 4095]
            self.hash = mix(np.add.reduceat(value, first) + length.astype(U64))
            self._sums = (value, place, first)
        else:
            self.hash = np.zeros(0, U64)

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of words longer than ``size`` bytes: their numbers, and a hash of their first bytes and length."""
        if not len(self.hash):
            return np.zeros(0, np.int64), self.hash
        value, place, first = self._sums
        length = self.end - self.start
        at = np.flatnonzero(length > size)
        head = np.add.reduceat(np.where(place < size, value, U64(0)), first)[at]
        return at, mix(head + length[at].astype(U64) * U64(0x9E3779B97F4A7C15) + U64(size))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words and their texts; a shorter text has one, of all its words."""
        if not len(self.hash):
            return self.hash, self.doc
        width = np.minimum(self.count, size)
        left = np.repeat(self.first + self.count, self.count) - np.arange(len(self.hash))
        total = np.zeros(len(self.hash), U64)
        need = np.repeat(width, self.count)
        for k in range(size):
            part = np.zeros(len(self.hash), U64)
            part[: len(part) - k or None] = self.hash[k:]
            total += np.where(need > k, part * POWERS[k], U64(0))
        keep = left >= need
        return mix(total[keep]), self.doc[keep]

    def sequence_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each text's word sequence; 0 where a text has no word."""
        keys = np.zeros((2, len(self.count)), U64)
        if len(self.hash):
            place = (np.arange(len(self.hash)) - np.repeat(self.first, self.count)).astype(U64)
            has = self.count > 0
            for k, step in enumerate((U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))):
                keys[k, has] = mix(np.add.reduceat(mix(self.hash + place * step), self.first[has]) + self.count[has].astype(U64))
        return keys[0], keys[1]


def counted(values: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, value) pairs in order, with how often each occurs."""
    if not len(values):
        return values, docs, np.zeros(0, np.int64)
    order = np.lexsort((values, docs))
    values, docs = values[order], docs[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])
    first = np.flatnonzero(new)
    return values[first], docs[first], np.diff(np.append(first, len(values)))
