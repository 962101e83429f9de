"""Ranked lexical search: the best documents of every item of a query set, by presence masks.

Terms are runs of ASCII letters, digits and bytes beyond ASCII, A-Z lower-cased. The first pass over
the documents writes, in blocks of documents, how often each document holds each term of the items,
and sums document frequencies, documents and their lengths over all of them. The second pass reads
those blocks. A block has one bitmap of documents for each of its terms; the bitmaps of an item's
terms, laid side by side and turned, are the presence masks of the block's documents, and documents
of one mask form a group. The sum of its terms' largest values in the block bounds a group's score,
so groups are scored exactly by descending bound until ten documents are better than every bound
that is left (equal bounds are still scored: ties go to the smaller doc_id). A task carries an item's
ten best from block to block, so that later blocks stop sooner, and hands on ten rows an item.

Items are broadcast to the tasks in blocks of ITEM_TERMS (item, term) pairs at most (one item's terms
stay together), each of which reads the documents anew; the terms of one block of items and their counts
are all that the driver sees. Words meet terms by a 64-bit hash and then by their bytes.

Defined cases: null or empty text has no term and does not count as a document; an item without terms,
or whose terms no document holds, has no rows; items that share an item_id are one item with the terms
of all; a null item_id is an item of its own; rows that share a doc_id are ranked each; a null doc_id
comes after all others of its score; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tercet.llm.common import release_memory, small_batches, table, written
from tercet.llm.textkernel import Words, blocks, faces

BEST = 10
ITEM_TERMS = 500_000
BLOCK_DOCS, BLOCK_POSTINGS = 1024, 1 << 16

PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = np.zeros(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _BETWEEN[_low : _high + 1] = True

BLOCKS = "n_docs int, ids binary, named binary, lengths binary, held binary, terms binary, times binary, term long, n long"
_NAMES = [x.split()[0] for x in BLOCKS.split(", ")]
_TYPES = [pa.int32(), *[pa.binary()] * 6, pa.int64(), pa.int64()]
#: Slots of the counts that are no term's document frequency.
DOCUMENTS, TERMS = -1, -2


class Vocabulary:
    """The distinct terms of a block of items, found by hash and proven by their bytes."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64) if raw else np.zeros(0, np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        off = np.concatenate(([0], ends))
        words = Words(data, off, between=_BETWEEN)
        order = np.argsort(words.hash, kind="stable")
        self.keys, self.term = words.hash[order], order
        self.face = [f[order] for f in faces(data, off[:-1], off[1:])]
        self.raw = [raw[i] for i in order]

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms, and which terms they are."""
        if not len(self.keys) or not len(words.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, words.hash), len(self.keys) - 1)
        met = np.flatnonzero(self.keys[at] == words.hash)
        at = at[met]
        starts, ends = words.starts[met], words.ends()[met]
        same = np.ones(len(met), bool)
        for mine, theirs in zip(faces(words.data, starts, ends), self.face, strict=True):
            same &= mine == theirs[at]
        for i in np.flatnonzero(same & (ends - starts > 16)).tolist():
            same[i] = words.data[starts[i] : ends[i]].tobytes() == self.raw[at[i]]
        return met[same], self.term[at[same]]


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term)."""
    found = F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(f"({PATTERN})"), F.lit(1))
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(found).alias("term")).distinct()


class _Block:
    def __init__(self):
        self.ids, self.lengths, self.held, self.terms, self.times, self.docs, self.postings = [], [], [], [], [], 0, 0

    def add(self, ids: list, lengths, held, terms, times) -> None:
        self.ids += ids
        for mine, more in ((self.lengths, lengths), (self.held, held), (self.terms, terms), (self.times, times)):
            mine.append(more)
        self.docs += len(ids)
        self.postings += len(terms)

    def row(self) -> pa.RecordBatch:
        named = np.array([x is not None for x in self.ids], np.uint8)
        packed = [np.array([x or 0 for x in self.ids], "<i8"), named, *[np.concatenate(x).astype(t) for x, t in ((self.lengths, "<i8"), (self.held, "<i4"), (self.terms, "<i4"), (self.times, "<i8"))]]
        columns = [[self.docs], *([p.tobytes()] for p in packed), [None], [None]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Blocks of documents with their (term, times), and counts by term: the written table of the first pass."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def read(batches):
        known, block = Vocabulary(shared.value), _Block()
        width = max(1, len(shared.value))
        holders, n_docs, n_terms = np.zeros(width, np.int64), 0, 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for low, high, data, off in blocks(batch.column("text")):
                words = Words(data, off, lower=True, between=_BETWEEN)
                met, term = known.find(words)
                pair, times = np.unique(words.doc[met] * width + term, return_counts=True)
                doc, term = pair // width, pair % width
                holders += np.bincount(term, minlength=width)
                n_docs += int((words.per_doc > 0).sum())
                n_terms += len(words.hash)
                held = np.bincount(doc, minlength=words.n_docs)
                some = held > 0  # the others can't be ranked
                block.add([ids[low + i] for i in np.flatnonzero(some)], words.per_doc[some], held[some], term, times)
                if block.docs >= BLOCK_DOCS or block.postings >= BLOCK_POSTINGS:
                    yield block.row()
                    block = _Block()
        if block.docs:
            yield block.row()
        slots = np.flatnonzero(holders)
        slots, sums = np.append(slots, [DOCUMENTS, TERMS]), np.append(holders[slots], [n_docs, n_terms])
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(slots), t) for t in _TYPES[:7]), pa.array(slots), pa.array(sums)], names=_NAMES)
        release_memory()

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(read, BLOCKS), "postings")


def _masks(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct presence masks (0/1 by term) of the documents of ``present`` (terms by documents), and each document's mask."""
    turned = np.packbits(present, axis=0, bitorder="little")
    wide = np.zeros((present.shape[1], -(-len(turned) // 8) * 8), np.uint8)
    wide[:, : len(turned)] = turned.T
    keys = wide.view("<u8")
    if keys.shape[1] == 1:
        distinct, which = np.unique(keys[:, 0], return_inverse=True)
        distinct = distinct[:, None]
    else:
        distinct, which = np.unique(keys, axis=0, return_inverse=True)
    return np.unpackbits(np.ascontiguousarray(distinct).view(np.uint8), axis=1, bitorder="little")[:, : len(present)], which.ravel()


class Searcher:
    """The ten best documents of each item over the blocks that it is shown."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int):
        self.items, self.weights, self.n_docs, self.n_terms = items, weights, n_docs, n_terms
        nothing = np.zeros(0, np.int64)
        self.best = [(nothing, nothing, nothing)] * len(items)  # score, 1 if without doc_id, doc_id
        self.scored = self.grouped = 0

    def show(self, ids, named, lengths, held, terms, times) -> None:
        part = (1_000_000_000 * times) // (1000 * times + 8 * np.repeat(10 + (90 * lengths * self.n_docs) // self.n_terms, held))
        value = part * self.weights[terms]
        doc = np.repeat(np.arange(len(ids)), held)
        begins = np.cumsum(held) - held
        met, local = np.unique(terms, return_inverse=True)
        present = np.zeros((len(met), len(ids)), bool)  # a bitmap of documents for each term
        present[local, doc] = True
        order = np.argsort(local, kind="stable")
        largest = np.maximum.reduceat(value[order], np.searchsorted(local[order], np.arange(len(met)))) if len(met) else value
        wanted = np.zeros(len(met), bool)
        for i, own in enumerate(self.items):
            at = np.minimum(np.searchsorted(met, own), len(met) - 1)
            at = at[met[at] == own]
            if len(at):
                self._item(i, at, present, largest, value, local, begins, held, wanted, ids, named)

    def _item(self, i, at, present, largest, value, local, begins, held, wanted, ids, named) -> None:
        floor = self.best[i][0][BEST - 1] if len(self.best[i][0]) == BEST else 0
        if largest[at].sum() < max(floor, 1):
            return
        rows = present[at]
        some = np.flatnonzero(rows.any(axis=0))
        distinct, which = _masks(rows[:, some])
        bounds = (distinct @ largest[at].astype(np.float64)).astype(np.int64)  # exact: below 2^53
        order = np.argsort(-bounds, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        by_group = np.argsort(rank[which], kind="stable")
        upto = np.cumsum(np.bincount(rank[which], minlength=len(order)))
        bounds, done, step = bounds[order], 0, BEST
        self.grouped += len(order)
        wanted[at] = True
        while done < len(order):
            floor = self.best[i][0][BEST - 1] if len(self.best[i][0]) == BEST else 0
            if bounds[done] < max(floor, 1):
                break
            before = int(upto[done - 1]) if done else 0
            done = min(int(np.searchsorted(upto, before + step)) + 1, len(order))
            chosen = some[by_group[before : int(upto[done - 1])]]
            step *= 2
            self.scored += len(chosen)
            sizes = held[chosen]
            ends = np.cumsum(sizes)
            flat = np.repeat(begins[chosen] - (ends - sizes), sizes) + np.arange(int(ends[-1]))
            score = np.add.reduceat(np.where(wanted[local[flat]], value[flat], 0), ends - sizes)
            good = score > 0
            old = self.best[i]
            new = [np.concatenate((o, n)) for o, n in zip(old, (score[good], 1 - named[chosen][good].astype(np.int64), ids[chosen][good]), strict=True)]
            top = np.lexsort((new[2], new[1], -new[0]))[:BEST]
            self.best[i] = tuple(n[top] for n in new)
        wanted[at] = False


def _ranked_block(docs: DataFrame, pairs: list[tuple[int | None, str]]) -> DataFrame:
    spark = docs.sparkSession
    terms = sorted({t for _, t in pairs})
    place = {t: k for k, t in enumerate(terms)}
    by_item: dict[int | None, list[int]] = {}
    for item, term in pairs:
        by_item.setdefault(item, []).append(place[term])
    found = postings(docs, terms)
    sums = dict(found.filter("term is not null").groupBy("term").agg(F.sum("n")).collect())  # one row a term
    n_docs, n_terms = sums.get(DOCUMENTS, 0), max(1, sums.get(TERMS, 0))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sums.get(k, 0) + 1))) for k in range(len(terms))], np.int64)
    shared = spark.sparkContext.broadcast((list(by_item), [np.array(sorted(v), np.int64) for v in by_item.values()], weights))

    def search(batches):
        names, items, weights = shared.value
        tool = Searcher(items, weights, n_docs, n_terms)
        for batch in batches:
            for raw in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                ids, named, lengths, held, termed, times = (np.frombuffer(r, t) for r, t in zip(raw, ("<i8", "u1", "<i8", "<i4", "<i4", "<i8"), strict=True))
                tool.show(ids, named, lengths, held.astype(np.int64), termed.astype(np.int64), times)
        for name, (score, nameless, ids) in zip(names, tool.best, strict=True):
            n = len(score)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.int64()), pa.array(ids, mask=nameless.astype(bool)), pa.array(score)], names=["item_id", "doc_id", "score"])
        release_memory()

    return found.filter("n_docs is not null").select("ids", "named", "lengths", "held", "terms", "times").mapInArrow(search, "item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the BEST documents of each item."""
    small_batches(docs.sparkSession)
    pairs = written(item_terms(items), "terms")
    parts = -(-pairs.count() // ITEM_TERMS)
    out = None
    for k in range(parts):
        held = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k) if parts > 1 else pairs
        found = _ranked_block(docs, [(r.item_id, r.term) for r in held.toLocalIterator()])
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= BEST).select("item_id", "rank", "doc_id", "score")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_FOUND = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{PATTERN}')"

ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_FOUND} AS t FROM documents), s AS (SELECT r, doc_id, len(t) AS n, t FROM d WHERE len(t) > 0),
every AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM s), q AS (SELECT DISTINCT item_id, unnest({_FOUND}) AS term FROM benchmark),
p AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(t) AS term FROM s) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000*ln(CAST(2*nn + 2 AS DOUBLE)/(2*df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), every),
x AS (SELECT item_id, r, CAST(sum(w*((1000000000*tf)//(1000*tf + 8*(10 + (90*n*nn)//ll)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN s USING (r), every GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x JOIN s USING (r) WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {BEST}"""
