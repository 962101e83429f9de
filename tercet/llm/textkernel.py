"""Vectorised word and hash kernels over Arrow string columns (no Python string per word).

A word is a run of bytes outside ``\\x20\\x09-\\x0D``. Words and windows are compared by 64-bit
hashes; below 1e9 distinct values the chance of any collision is under 3 %.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that the kernels look at in one go; a longer document is one go of its own.
BLOCK_BYTES = 1 << 20

_WS = np.zeros(256, bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _P, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(256)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = _powers(2 * n)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about BLOCK_BYTES."""
    data, off = string_buffers(column)
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + BLOCK_BYTES, "right")) - 1)
        to = min(to, n, at + 4096)
        yield at, to, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def segment_hash(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Polynomial hash of each segment of ``values`` (uint8); zero weights where value is 255+1."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = np.diff(np.append(starts, len(values)))
    first = starts[0]
    place = np.arange(first, len(values), dtype=np.int64)
    place -= np.repeat(starts, lengths)
    table = powers(int(lengths.max()) + 1)
    terms = table[place]
    terms *= values[first:]
    return np.add.reduceat(terms, starts - first)


_KEPT = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [_MASK], np.uint64)


def faces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length, first eight and last eight bytes of the pieces from ``starts`` to ``ends``."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    at = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    length = ends - starts
    kept = _KEPT[np.minimum(length, 8)]
    return length, at[starts] & kept, at[np.maximum(ends - 8, starts)] & kept


class Words:
    """The words of a block: hash, document and byte place of each. ``between`` marks the bytes that part words."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False, between: np.ndarray = _WS):
        space = between[data]
        start = ~space
        start[1:] &= space[:-1]
        if len(data):
            edges = off[:-1][off[:-1] < len(data)]
            start[edges] = ~space[edges]
        self.starts = np.flatnonzero(start)
        self.n_docs = len(off) - 1
        self.doc = np.searchsorted(off, self.starts, "right") - 1
        self.per_doc = np.bincount(self.doc, minlength=self.n_docs)
        self.first = np.concatenate(([0], np.cumsum(self.per_doc)))
        self.data, self.off = _LOWER[data] if lower else data, off
        values = self.data.astype(np.uint64)
        values += np.uint64(1)
        values[space] = 0
        self.hash = mix(segment_hash(values, self.starts))
        self.space = space

    def ends(self) -> np.ndarray:
        """The byte after each word."""
        stop = ~self.space
        stop[:-1] &= self.space[1:]
        edges = self.off[1:][self.off[1:] > 0] - 1
        stop[edges] = ~self.space[edges]
        return np.flatnonzero(stop) + 1

    def faces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length, first eight and last eight bytes (as numbers) of each word: all of it, up to sixteen bytes."""
        return faces(self.data, self.starts, self.ends())

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first-word index of every window of k words inside one document."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        total = np.zeros(len(at), np.uint64)
        for j in range(k):
            total *= np.uint64(0xD6E8FEB86659FD93)
            total += self.hash[at + j]
            total = mix(total)
        return total, at


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles (52-bit hashes) by document: values and offsets.

    With fewer than k words the whole sequence is the one shingle; without words the set is empty.
    """
    values, at = words.windows(k)
    doc = words.doc[at]
    short = np.flatnonzero((words.per_doc > 0) & (words.per_doc < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i, d in enumerate(short):
            total = int(words.per_doc[d])
            for h in words.hash[words.first[d] : words.first[d + 1]].tolist():
                total = int(mix(np.array([(total * 0xA24BAED4963EE407 + h) & _MASK], np.uint64))[0])
            extra[i] = total
        values, doc = np.concatenate((values, extra)), np.concatenate((doc, short))
    if words.n_docs > 1 << 12:
        raise ValueError("a block holds 4096 documents at most")
    keys = (doc.astype(np.uint64) << np.uint64(52)) | (values >> np.uint64(12))
    keys.sort()
    if len(keys):
        fresh = np.ones(len(keys), bool)
        np.not_equal(keys[1:], keys[:-1], out=fresh[1:])
        keys = keys[fresh]
    counts = np.bincount((keys >> np.uint64(52)).astype(np.int64), minlength=words.n_docs)
    return (keys & np.uint64((1 << 52) - 1)).astype(np.int64), np.concatenate(([0], np.cumsum(counts)))
