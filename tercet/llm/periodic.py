"""Periodic runs of words in whole documents, exactly, and the texts without their repetitions.

A run is a stretch of consecutive words with smallest period q and length of at least max(6, 4q) that
no neighbouring word extends. Every run with period q holds a multiple g of 2q with q equal words from
g and from g + q on. So the candidates are the pairs (g, g + q) of a harmonic grid, n/2 (1 + 1/2 + 1/3 +
...) for n words, less those whose words differ at once at a few places (which no run could). Extension
queries on the documents' run-length grammar (see ``recompression``) then give the exact ends on both
sides. Stretches found with several periods keep the smallest: with four repetitions the others are
multiples of it.

A block of whole documents, of a bounded number of bytes, shares one grammar; a longer document is a
block of its own. Nothing is shuffled. Words are equal if a 64-bit hash, their length, and their first
and last eight bytes are.

Defined cases: null or empty text has no words, no run, and the hashes of empty strings; a null doc_id
alters nothing in its text; repeated rows are reported each; very long texts are searched whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tercet.llm.common import release_memory, small_batches, table
from tercet.llm.recompression import Grammar
from tercet.llm.textkernel import Words, blocks, mix

LEAST_LENGTH, LEAST_PERIODS = 6, 4
#: Grid pairs that are compared in one go.
GRID = 1 << 21

RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_NAMES = [x.split()[0] for x in RESULT.split(", ")]
_TYPES = [pa.int64()] * 6 + [pa.string()] * 2


def word_ids(words: Words) -> np.ndarray:
    """Equal numbers for equal words."""
    length, head, tail = words.faces()
    key = words.hash
    for part in (length.astype(np.uint64), head, tail):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + part)
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """From which word on (a) a document is replaced by its next p words, again and again; None: not at all."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def sources(doc_ids: list[int | None], first: np.ndarray) -> np.ndarray:
    """The word that stands at each place of the documents, after the replacement."""
    out = np.arange(int(first[-1]))
    for k, doc_id in enumerate(doc_ids):
        low, high = int(first[k]), int(first[k + 1])
        change = planted(doc_id, high - low)
        if change:
            a, p = change
            out[low + a : high] = low + a + np.arange(high - low - a) % p
    return out


def _grid(first: np.ndarray):
    """(g, q) of all documents in arrays of about GRID pairs: g is a multiple of 2q inside the document, with q words from g + q on."""
    sizes = np.diff(first)
    periods = np.maximum(sizes // LEAST_PERIODS, np.where(sizes >= LEAST_LENGTH, 1, 0))
    at, end = 0, int(periods.sum())
    upto = np.cumsum(periods)
    # pairs of (document, q) in turn; of each, places 0, 2q, 4q, ... below n - 2q + 1
    chunk = GRID // 4
    while at < end:
        flat = np.arange(at, min(at + chunk, end))
        doc = np.searchsorted(upto, flat, "right")
        q = flat - (upto[doc] - periods[doc]) + 1
        times = (sizes[doc] - 2 * q) // (2 * q) + 1
        ends = np.cumsum(times)
        low = 0
        while low < len(flat):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + GRID, "right")))
            t, qq = times[low:high], q[low:high]
            which = np.repeat(np.arange(len(t)), t)
            k = np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t)
            q_all = qq[which]
            yield first[:-1][doc[low:high]][which] + 2 * q_all * k, q_all
            low = high
        at += chunk


def runs(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and smallest period of every run; ``first`` has the documents' first places, and the end."""
    found = []
    grammar = None
    for g, q in _grid(first):
        near = np.flatnonzero(ids[g] == ids[g + q])
        g, q = g[near], q[near]
        for part in (1.0, 0.5, 0.25, 0.75):  # other places among the q words
            at = g + (part * (q - 1)).astype(np.int64)
            near = ids[at] == ids[at + q]
            g, q = g[near], q[near]
        if not len(g):
            continue
        if grammar is None:
            grammar = Grammar(ids, first[:-1])
        end = g + q + grammar.extension(g, g + q)
        start = g - grammar.extension(g, g + q, forward=False)
        good = end - start >= np.maximum(LEAST_LENGTH, LEAST_PERIODS * q)
        every = np.stack((start[good], end[good], q[good]))
        every = every[:, np.lexsort(every[::-1])]
        fresh = np.ones(every.shape[1], bool)
        fresh[1:] = (every[:2, 1:] != every[:2, :-1]).any(axis=0)
        found.append(every[:, fresh])
    if not found:
        return (np.zeros(0, np.int64),) * 3
    every = np.concatenate(found, axis=1)
    every = every[:, np.lexsort((every[2], every[1], every[0]))]
    fresh = np.ones(every.shape[1], bool)
    fresh[1:] = (every[:2, 1:] != every[:2, :-1]).any(axis=0)
    every = every[:, fresh]
    every = every[:, np.lexsort((every[2], every[0]))]
    return every[0], every[1], every[2]


def _greatest(start: list[int], length: list[int], period: list[int]) -> int:
    """The run of greatest length over period, exactly; ties to the smaller start, then period."""
    best = 0
    for k in range(1, len(start)):
        mine, theirs = length[k] * period[best], length[best] * period[k]
        if mine > theirs or mine == theirs and (start[k], period[k]) < (start[best], period[best]):
            best = k
    return best


def described(doc_ids: list[int | None], data: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
    """One row a document of a block."""
    words = Words(data, off)
    source = sources(doc_ids, words.first)
    starts, ends, periods = runs(word_ids(words)[source], words.first)
    owner = np.searchsorted(words.first, starts, "right") - 1
    bounds = np.searchsorted(owner, np.arange(len(doc_ids) + 1))
    raw, rows = data.tobytes(), []
    for k, doc_id in enumerate(doc_ids):
        held = raw[off[k] : off[k + 1]].split()  # the same white space
        low, n = int(words.first[k]), len(held)
        some = slice(int(bounds[k]), int(bounds[k + 1]))
        s, e, p = (starts[some] - low), (ends[some] - low), periods[some]
        if planted(doc_id, n):
            held = [held[i] for i in (source[low : low + n] - low).tolist()]
        if not len(s):
            rows.append((doc_id, 0, None, None, None, None, "", b" ".join(held)))
            continue
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, s + p, 1)
        np.add.at(edge, e, -1)
        kept = np.flatnonzero(np.cumsum(edge)[:n] == 0)
        s, length, p = s.tolist(), (e - s).tolist(), p.tolist()
        b = _greatest(s, length, p)
        rows.append((doc_id, len(s), s[b], length[b], p[b], 1000 * length[b] // p[b], "".join(f"{x},{y},{z}\n" for x, y, z in zip(s, length, p, strict=True)), b" ".join([held[i] for i in kept.tolist()])))
    columns = [list(c) for c in zip(*rows, strict=True)]
    columns[6] = [hashlib.sha256(x.encode()).hexdigest() for x in columns[6]]
    columns[7] = [hashlib.sha256(x).hexdigest() for x in columns[7]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, its number of runs, the run of greatest exponent, and hashes of all runs and of the collapsed text."""
    small_batches(docs.sparkSession)

    def search(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for low, high, data, off in blocks(batch.column("text")):
                yield described(ids[low:high], data, off)
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(search, RESULT)


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"))
