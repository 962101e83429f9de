"""Best-fit packing of token pieces into fixed-length sequences, in bulk-synchronous rounds.

Each round is one distributed successor sweep. Documents and open gaps are range-sorted together,
largest first, gaps before documents of the same size. A document takes the last gap before it that
no other document took: the smallest gap that still fits and that no larger document needs (gaps
open and documents close, as brackets do). Conflicts are thus resolved by rank, every gap takes one
document at most, the gaps shrink, and the next round follows. A task matches its own range first;
what stays open there (documents, then gaps) meets by its level in the whole order, and no level has
more than two such rows of a range, so no level is a hot key. Size classes go from large to small;
what fits nowhere opens sequences.

The driver sees counts by size (at most the capacity) and by range, never rows. A round that neither
places nor opens anything is an error, so the loop always ends.

Defined cases: null text is empty and packs as its end token alone; equal sizes are ordered by a
row number, so ties and repeated rows are all placed; very long texts are cut into pieces of the
capacity, and nothing else is cut; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tercet.llm.common import ARROW_ROWS, delete, looked_up, new_path, release_memory, small_batches, table, written
from tercet.llm.subwords import default_vocabulary, encoder

CAPACITY = 1024
END_ID = 2
#: Classes (capacity/(k+1), capacity/k]; what is smaller goes last, together.
CLASSES = 3
#: Documents and gaps that a task sweeps, on average.
ROWS_PER_SWEEP = 50_000
#: Parts of one size by hash, when only some of its documents open sequences.
EDGE_PARTS = 4096

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: A placed document with its gap; a document (gap null) or a gap (id null) that found nothing.
ROUND = "id long, size int, gap long, gap_free int"
PLACED, DOCUMENT, GAP = 0, 1, 2


def cut_lengths(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole pieces, the first one may be shorter."""
    head = n % capacity or min(n, capacity)
    starts = [0, *range(head, n, capacity)]
    return list(zip(starts, [*starts[1:], n], strict=False))


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Encode whole texts, append the end id, cut what is longer than the capacity."""
    small_batches(docs.sparkSession)

    def pieces(batches):
        tool = encoder(vocabulary)
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            rows = []
            for i, ids in tool.encode_column(batch.column("text")):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, (at, to) in enumerate(cut_lengths(len(ids), capacity)):
                    rows.append((keys[i], k, at, to - at, zlib.crc32(ids[at:to].tobytes())))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, PIECES)


def _pairs(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Brackets of one run (0 opens, 1 closes): places of the pairs' gaps and documents, of lone documents and of lone gaps."""
    level = np.cumsum(1 - 2 * kind) + kind
    order = np.argsort(level, kind="stable")
    hit = (level[order][1:] == level[order][:-1]) & (kind[order][1:] == 1) & (kind[order][:-1] == 0)
    gaps, documents = order[:-1][hit], order[1:][hit]
    alone = np.ones(len(kind), bool)
    alone[gaps] = alone[documents] = False
    return gaps, documents, np.flatnonzero(alone & (kind == 1)), np.flatnonzero(alone & (kind == 0))


class _Range:
    """The open gaps of one range while its rows pass by."""

    def __init__(self, pid: int):
        self.pid, self.lone = pid, 0
        self.ids, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def rows(self, kind: np.ndarray, size: np.ndarray, ids: np.ndarray):
        gaps, documents, lone, fresh = _pairs(kind)
        yield _batch(ids[documents], size[documents], ids[gaps], size[gaps], self.pid, None)
        n = min(len(lone), len(self.ids))
        if n:  # the earliest document takes the latest gap
            yield _batch(ids[lone[:n]], size[lone[:n]], self.ids[::-1][:n], self.sizes[::-1][:n], self.pid, None)
            self.ids, self.sizes = self.ids[: len(self.ids) - n], self.sizes[: len(self.sizes) - n]
        left = lone[n:]
        if len(left):
            yield _batch(ids[left], size[left], None, None, self.pid, -self.lone - np.arange(len(left)))
            self.lone += len(left)
        self.ids, self.sizes = np.concatenate((self.ids, ids[fresh])), np.concatenate((self.sizes, size[fresh]))

    def end(self):
        if len(self.ids):
            yield _batch(None, None, self.ids, self.sizes, self.pid, 1 - self.lone + np.arange(len(self.ids)))


def _batch(ids, sizes, gaps, free, pid: int, level):
    n = len(ids) if ids is not None else len(gaps)
    columns = [(ids, pa.int64()), (sizes, pa.int32()), (gaps, pa.int64()), (free, pa.int32()), (np.full(n, pid), pa.int32()), (level, pa.int64())]
    return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(np.ascontiguousarray(c), t) for c, t in columns], names=["id", "size", "gap", "gap_free", "pid", "level"])


def _in_ranges(rows: DataFrame, n: int) -> DataFrame:
    """Range-sort ``rows(kind, size, id)`` and match inside each range: ROUND, pid, and the level (by range) of what is left."""
    order = [F.col("size").desc(), F.col("kind"), F.col("id")]
    parts = max(1, -(-n // ROWS_PER_SWEEP))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id())

    def match(batches):
        held = None
        for batch in batches:
            pids, kind, size, ids = (batch.column(c).to_numpy() for c in ("pid", "kind", "size", "id"))
            edges = np.flatnonzero(np.diff(pids, prepend=-1, append=-1)) if len(pids) else []
            for low, high in zip(edges[:-1], edges[1:], strict=True):  # a task may hold several ranges, each in one run
                if held is None or held.pid != pids[low]:
                    if held is not None:
                        yield from held.end()
                    held = _Range(int(pids[low]))
                yield from held.rows(kind[low:high].astype(np.int64), size[low:high], ids[low:high])
        if held is not None:
            yield from held.end()

    return ranged.coalesce(parts).mapInArrow(match, ROUND + ", pid int, level long")


def _across_ranges(found: DataFrame, base: dict[int, int]) -> DataFrame:
    """Match what the ranges left, by level in the whole order."""
    left = found.filter("level is not null").withColumn("at_level", F.col("level") + looked_up(base, F.col("pid")))
    w = Window.partitionBy("at_level").orderBy("pid", F.col("id").isNull())
    is_gap = F.col("id").isNull()
    seen = left.select(
        "id", "size", "gap", "gap_free",
        (~is_gap & F.coalesce(F.lag(is_gap).over(w), F.lit(False))).alias("hit"),
        (is_gap & F.coalesce(F.lead(~is_gap).over(w), F.lit(False))).alias("taken"),
        F.lag("gap").over(w).alias("last_gap"), F.lag("gap_free").over(w).alias("last_free"),
    ).filter("not taken")
    matched = seen.select("id", "size", F.when(F.col("hit"), F.col("last_gap")).otherwise(F.col("gap")).alias("gap"), F.when(F.col("hit"), F.col("last_free")).otherwise(F.col("gap_free")).alias("gap_free"))
    return found.filter("level is null").select("id", "size", "gap", "gap_free").unionByName(matched)


#: What a row of ROUND is, and the size that counts: of the document left, or of the gap as it is now.
_KIND = "CASE WHEN id IS NULL THEN 2 WHEN gap IS NULL THEN 1 ELSE 0 END"
_SIZE = "CASE WHEN gap IS NULL THEN size ELSE gap_free - coalesce(size, 0) END"


class _Rounds:
    """The written rounds and what the driver knows of them: counts by size."""

    def __init__(self, spark: SparkSession, capacity: int):
        self.spark, self.capacity, self.paths = spark, capacity, []
        self.gaps: DataFrame | None = None
        self.gap_sizes: dict[int, int] = {}

    def _keep(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, "round")
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def open(self, items: DataFrame, sizes: dict[int, int]) -> None:
        """Every one of the items (``sizes``: rows by size) begins a sequence that carries its id."""
        fresh = items.select((F.lit(self.capacity) - F.col("size")).cast("int").alias("size"), "id")
        self.gaps = fresh if self.gaps is None else self.gaps.unionByName(fresh)
        for size, n in sizes.items():
            self.gap_sizes[self.capacity - size] = self.gap_sizes.get(self.capacity - size, 0) + n

    def sweep(self, items: DataFrame, sizes: dict[int, int], least: int) -> tuple[DataFrame, dict[int, int], int]:
        """One round over ``items(id, size)``: those left, their rows by size, and how many found a place."""
        n = sum(sizes.values()) + sum(k for size, k in self.gap_sizes.items() if size >= least)
        rows = items.select(F.lit(1).alias("kind"), F.col("size").cast("int").alias("size"), "id").unionByName(
            self.gaps.filter(F.col("size") >= least).select(F.lit(0).alias("kind"), F.col("size").cast("int").alias("size"), "id")
        )
        done = self._keep(_in_ranges(rows, n))
        counts = done.select(F.expr(_KIND).alias("kind"), F.expr(_SIZE).alias("value"), F.when(F.col("level").isNotNull(), F.col("pid")).alias("pid"))
        counts = counts.groupingSets([["kind", "pid"], ["kind", "value"]], "kind", "pid", "value").agg(F.count("*").alias("n"), F.grouping("pid").alias("by_value")).collect()
        nets: dict[int, list[int]] = {}
        for r in counts:
            if not r.by_value and r.pid is not None:
                nets.setdefault(r.pid, [0, 0])[r.kind == GAP] += r.n
        base, height, room, meets = {}, 0, 0, False
        for pid in sorted(nets):
            documents, gaps = nets[pid]
            base[pid], meets = height, meets or (room > 0 and documents > 0)
            height, room = height + gaps - documents, max(0, room - documents) + gaps
        by_value = [r for r in counts if r.by_value]
        if meets:
            ranges = self.paths.pop()
            done = self._keep(_across_ranges(done, base))
            delete(self.spark, ranges)
            by_value = done.groupBy(F.expr(_KIND).alias("kind"), F.expr(_SIZE).alias("value")).agg(F.count("*").alias("n")).collect()
        self.gaps = done.filter("gap is not null").select(F.expr(_SIZE).cast("int").alias("size"), F.col("gap").alias("id"))
        self.gap_sizes, left = {}, {}
        for r in by_value:
            into = left if r.kind == DOCUMENT else self.gap_sizes
            into[r.value] = into.get(r.value, 0) + r.n
        return done.filter("gap is null").select("id", "size"), left, sum(r.n for r in by_value if r.kind == PLACED)

    def placed(self) -> DataFrame | None:
        """(id, sequence_id, offset) of all documents that found a gap."""
        if not self.paths:
            return None
        done = self.spark.read.schema(ROUND).parquet(*self.paths)
        return done.filter("id is not null and gap is not null").select("id", F.col("gap").alias("sequence_id"), (F.lit(self.capacity) - F.col("gap_free")).cast("long").alias("offset"))


def _largest(items: DataFrame, sizes: dict[int, int], wanted: int) -> tuple[DataFrame, DataFrame, dict[int, int], dict[int, int]]:
    """Split off ``wanted`` of the largest items and at least one: whole sizes, and of the last one as many hash parts as it takes."""
    chosen, left, edge = {}, dict(sizes), None
    for size in sorted(sizes, reverse=True):
        short = wanted - sum(chosen.values())
        if short <= 0:
            break
        if sizes[size] > short:
            edge = size
            break
        chosen[size] = left.pop(size)
    if edge is None:
        low = min(chosen)
        return items.filter(F.col("size") >= low), items.filter(F.col("size") < low), chosen, left
    part = F.pmod(F.xxhash64("id"), F.lit(EDGE_PARTS))
    rows, bound = 0, 0
    for r in sorted(items.filter(F.col("size") == edge).groupBy(part.alias("part")).count().collect()):
        rows, bound = rows + r["count"], r["part"]
        if rows >= short:
            break
    chosen[edge], left[edge] = rows, sizes[edge] - rows
    if not left[edge]:
        del left[edge]
    opens = (F.col("size") > edge) | ((F.col("size") == edge) & (part <= bound))
    return items.filter(opens), items.filter(~opens), chosen, left


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place ``pieces(id long, size int)``, sizes 1 to capacity: (id, sequence_id, offset). ``pieces`` is read more than once."""
    rounds = _Rounds(pieces.sparkSession, capacity)
    every = {r["size"]: r["count"] for r in pieces.groupBy("size").count().collect()}
    least = min(every, default=1)
    of = lambda low, high: {s: n for s, n in every.items() if low < s <= high}
    rounds.open(pieces.filter(F.col("size") > capacity // 2).select("id", "size"), of(capacity // 2, capacity))
    for k in range(2, CLASSES + 2):
        last = k == CLASSES + 1
        low, high = (0 if last else capacity // (k + 1)), capacity // k
        items, sizes, opened = pieces.filter((F.col("size") > low) & (F.col("size") <= high)).select("id", "size"), of(low, high), False
        while sizes:
            before, found = sum(sizes.values()), 0
            if max((s for s, n in rounds.gap_sizes.items() if n), default=0) >= min(sizes):
                items, sizes, found = rounds.sweep(items, sizes, least)
            left = sum(sizes.values())
            if left and (found == 0 or (not opened and not last and found < before // 8)):
                tokens = sum(s * n for s, n in sizes.items())
                first, items, chosen, sizes = _largest(items, sizes, -(-tokens // capacity) if last else -(-left // k))
                if not chosen:
                    raise RuntimeError("a round of packing neither placed nor opened anything")
                rounds.open(first, chosen)
                opened = True
    places = rounds.placed()
    if places is None:
        return pieces.select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.select("id").join(places, "id", "left").select("id", F.coalesce("sequence_id", "id").alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))


def packed_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, vocabulary or default_vocabulary(), capacity, end_id).withColumn("id", F.monotonically_increasing_id()), "pieces")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")  # numbers only from here on
    try:
        places = pack(pieces.select("id", F.col("length").cast("int").alias("size")), capacity)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return pieces.join(places, "id").drop("id")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(table(spark, sf_dir, "documents"))
