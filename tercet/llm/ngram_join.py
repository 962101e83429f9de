"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are classes of documents with equal n-gram sets (copies are never multiplied); its
columns are parts of sets. Sizes are cut into classes so that similar sets lie in one class or in two
neighbouring ones. If the larger one has at most r n-grams, the two differ in at most
h = 2r (1 - t) / (1 + t) of them. N-grams are dealt by hash over h + 1 parts or a few more: at most h parts
can differ, so a set with more than h filled parts shares a whole filled part with every similar one, and the
columns are (size class, part, what the set has there). The few sets with fewer filled parts also have
their empty parts as columns, where they meet only each other. A column asks for several n-grams at
once, so however frequent single n-grams become, columns stay light unless sets are nearly equal, and
the matrix grows with the input.

Every class also carries how many of its n-grams fall into each of COLUMN_BLOCKS hash ranges; the smaller
counts of a pair add up to a bound of its overlap, and pairs below it are discarded. Sets of more than
COUNTED n-grams, for which so few ranges say little, also carry a bit for each of two to four times as many
ranges as they have n-grams: a range that only one of two sets fills is an n-gram that they do not share. What is left is
accumulated exactly over blocks of n-grams; a pair is dropped as soon as its count so far and what
the smaller row still holds cannot reach the bound.

Columns of up to LIGHT rows multiply all their rows. A heavier column never emits its pairs. First
two pivot rows of it meet the others, and links are contracted into components. The columns that
still hold several components are then multiplied in row blocks: rows in order of size, blocks of
ROW_BLOCK, and for every two blocks whose sizes can be similar one group, in which two incidence
matrices are multiplied column block by column block. The same bounds come before the texts: a row gets
its text in a group only if some row of another component may be similar to it there. A group returns the links of a spanning
forest, not all of them, so its output is linear in its rows. Every pair of different components is
examined, so components are exact; nothing is capped or dropped.

Defined cases: null, empty or wordless text has an empty set, links with nothing and is its own
component; fewer words than n make one n-gram; copies and repeated rows are one class; rows that
share a doc_id but not a text are compared by their own texts, and so are rows without a doc_id; very
long texts are compared whole; an empty table gives an empty result; other columns are ignored. Sets
are compared by 52-bit hashes of their n-grams and classes by 63-bit hashes of their sets; a text is
found again by its doc_id and a 64-bit hash of the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tercet.llm.common import forget, looked_up, partitions, release_memory, small_batches, sorted_positions, table, written
from tercet.llm.graphs import components
from tercet.llm.textkernel import Words, blocks, mix, shingle_sets

#: Classes that a task remembers, to write the columns of copies once.
SEEN = 1 << 18
#: Rows of ids that may be broadcast to fetch texts; beyond it they are shuffled.
MAX_IDS = 1_000_000
#: Members of one row block around a pivot.
BLOCK = 64
#: Rows of a column whose pairs are formed at once, at most; heavier ones are multiplied in blocks of rows.
LIGHT, ROW_BLOCK = 48, 512
#: Columns that are accumulated before pairs below the bound are dropped.
COLUMNS = 4096

#: Hash ranges of columns whose counts bound a pair's overlap.
COLUMN_BLOCKS = 256
#: N-grams of a set up to which its counts alone bound its overlaps; larger sets have bits too.
COUNTED = 512

SCAN = "doc_id long, th long, n long, fp long, counts binary, bits binary, grams array<long>"


def set_hash(values: np.ndarray) -> int:
    """63-bit hash of a sorted set."""
    if not len(values):
        return 0
    x = mix(values.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    both = np.array([x.sum(dtype=np.uint64), np.bitwise_xor.reduce(x)], np.uint64)
    total = mix(both[:1] * np.uint64(0x9FB21C651E98DF25) + mix(both[1:] + np.uint64(len(values))))
    return int(total[0] >> np.uint64(1))


def set_hashes(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """:func:`set_hash` of each of a block's sets."""
    sizes = np.diff(off)
    out = np.zeros(len(sizes), np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        x = mix(values.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        total = np.add.reduceat(x, off[:-1][full])
        crossed = np.bitwise_xor.reduceat(x, off[:-1][full])
        out[full] = (mix(total * np.uint64(0x9FB21C651E98DF25) + mix(crossed + sizes[full].astype(np.uint64))) >> np.uint64(1)).astype(np.int64)
    return out


def block_counts(values: np.ndarray, place: np.ndarray) -> list[bytes]:
    """Columns of each set by hash range, a byte each; a set that overflows a byte says 255 everywhere (any count)."""
    n_docs = len(place) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(place))
    counts = np.bincount(doc * COLUMN_BLOCKS + (values >> 44), minlength=n_docs * COLUMN_BLOCKS).reshape(n_docs, COLUMN_BLOCKS)
    counts[(counts > 254).any(axis=1)] = 255
    return [row.tobytes() for row in counts.astype(np.uint8)]


def range_bits(values: np.ndarray) -> bytes | None:
    """A bit for each hash range that a sorted set fills, where it has more than COUNTED n-grams; the ranges are a power of two."""
    if len(values) <= COUNTED:
        return None
    filled = np.zeros(1 << int(2 * len(values) - 1).bit_length(), bool)
    filled[values >> (52 - int(len(filled) - 1).bit_length())] = True
    return np.packbits(filled).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Packed bits as those of ``size`` bytes: ranges of fewer and wider cuts."""
    return bits if len(bits) == size else np.packbits(np.unpackbits(bits).reshape(8 * size, -1).any(axis=1))


def _similar(overlap: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * overlap >= percent * (n + m - overlap)


def missed(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` that may be similar by their bits, from ``held(fp, n, bits)``; all whose sets have none."""
    fine = held.filter("bits is not null").select("fp", "n", "bits")
    left = fine.select(F.col("fp").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    right = fine.select(F.col("fp").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))

    def bound(batches):
        for batch in batches:
            kept = np.ones(batch.num_rows, bool)
            n, m = batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist()
            x, y = batch.column("bits_a"), batch.column("bits_b")
            for r in np.flatnonzero(~(x.is_null().to_numpy(zero_copy_only=False) | y.is_null().to_numpy(zero_copy_only=False))).tolist():
                one, other = (np.frombuffer(c[r].as_py(), np.uint8) for c in (x, y))
                size = min(len(one), len(other))
                one, other = folded(one, size), folded(other, size)
                overlap = min(n[r] - int(np.bitwise_count(one & ~other).sum(dtype=np.int64)), m[r] - int(np.bitwise_count(other & ~one).sum(dtype=np.int64)))
                kept[r] = _similar(overlap, n[r], m[r], percent)
            mask = pa.array(kept)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return pairs.join(left, "a", "left").join(right, "b", "left").mapInArrow(bound, "a long, b long")


def may_link(n: np.ndarray, counts: np.ndarray, bits: list[bytes | None], m: np.ndarray, counts_: np.ndarray, bits_: list[bytes | None], percent: int) -> np.ndarray:
    """Whether each set of one row block (sizes, counts, bits) may be similar to each of another, by both bounds."""
    unknown, unknown_ = (counts == 255).all(axis=1), (counts_ == 255).all(axis=1)
    one, other = np.where(unknown[:, None], 0, counts), np.where(unknown_[:, None], 0, counts_)
    shared = np.zeros((len(n), len(m)), np.float32)
    for least in range(1, min(int(one.max(initial=0)), int(other.max(initial=0))) + 1):
        shared += (one >= least).astype(np.float32) @ (other >= least).astype(np.float32).T
    smaller = np.minimum(n[:, None], m[None, :])
    overlap = np.where(unknown[:, None] | unknown_[None, :], smaller, np.minimum(shared.astype(np.int64), smaller))
    fine, fine_ = (np.array([r for r, x in enumerate(b) if x is not None], np.int64) for b in (bits, bits_))
    if len(fine) and len(fine_):
        size = min(len(b[r]) for b, rows in ((bits, fine), (bits_, fine_)) for r in rows)
        x, y = (np.stack([folded(np.frombuffer(b[r], np.uint8), size) for r in rows]) for b, rows in ((bits, fine), (bits_, fine_)))
        both = np.zeros((len(fine), len(fine_)), np.float32)
        for low in range(0, size, COLUMN_BLOCKS):
            both += np.unpackbits(x[:, low : low + COLUMN_BLOCKS], axis=1).astype(np.float32) @ np.unpackbits(y[:, low : low + COLUMN_BLOCKS], axis=1).astype(np.float32).T
        alone = np.bitwise_count(x).sum(axis=1, dtype=np.int64)[:, None] - both.astype(np.int64)
        alone_ = np.bitwise_count(y).sum(axis=1, dtype=np.int64)[None, :] - both.astype(np.int64)
        at = np.ix_(fine, fine_)
        overlap[at] = np.minimum(overlap[at], np.minimum(n[fine][:, None] - alone, m[fine_][None, :] - alone_))
    return _similar(overlap, n[:, None], m[None, :], percent)


def bounded(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose bound by column blocks, from ``held(fp, n, counts)``, reaches the similarity."""
    left = held.select(F.col("fp").alias("a"), F.col("n").alias("n_a"), F.col("counts").alias("c_a"))
    right = held.select(F.col("fp").alias("b"), F.col("n").alias("n_b"), F.col("counts").alias("c_b"))

    def bound(batches):
        for batch in batches:
            n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COLUMN_BLOCKS) for c in ("c_a", "c_b"))
            shared = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            unknown = (x == 255).all(axis=1) | (y == 255).all(axis=1)
            overlap = np.where(unknown, np.minimum(n, m), np.minimum(shared, np.minimum(n, m)))
            kept = pa.array(_similar(overlap, n, m, percent))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], names=["a", "b"])

    return missed(pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(bound, "a long, b long"), held, percent)


def size_classes(percent: int, largest: int) -> np.ndarray:
    """Last sizes of the classes up to ``largest`` and one beyond: a similar larger set is in the same class or the next."""
    ends, low = [], 1
    while not ends or ends[-1] < largest:
        ends.append(max(low, 100 * low // percent))
        low = ends[-1] + 1
    return np.array([*ends, max(low, 100 * low // percent)], np.int64)


def part_numbers(percent: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By size class of the larger set: how many n-grams may differ, and into how many parts sets are cut (some more where parts would be empty)."""
    differ = 2 * ends * (100 - percent) // (100 + percent)
    parts = differ + 1
    lowest = np.concatenate(([0], ends[:-1])) + 1
    empty = parts * np.exp(-lowest / parts)
    return differ, parts + np.where(empty < 0.05, 0, np.ceil(2 * empty)).astype(np.int64)


def columns_of(values: np.ndarray, place: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of each of a block's sets, end to end: values and offsets. Similar sets that are not equal share one."""
    sizes = np.diff(place)
    n_docs = len(sizes)
    ends = size_classes(percent, int(sizes.max(initial=1)))
    differ, parts = part_numbers(percent, ends)
    hashed = mix(values.astype(np.uint64) + np.uint64(0x9FB21C651E98DF25))
    doc = np.repeat(np.arange(n_docs), sizes)
    order = np.argsort((doc.astype(np.uint64) << np.uint64(32)) | (hashed >> np.uint64(32)))
    hashed, weight = hashed[order], mix(values[order].astype(np.uint64) ^ np.uint64(0x632BE59BD9B4E019))
    found, owner = [], []
    for step in (0, 1):  # as the larger set of a pair and as the smaller one of the next class
        level = np.searchsorted(ends, sizes) + step
        used = (sizes > 0) & (differ[level] > 0)
        mine = used[doc]
        if not mine.any():
            continue
        of, h, w = doc[mine], hashed[mine], weight[mine]
        part = ((h >> np.uint64(32)) * parts[level[of]].astype(np.uint64)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (part[1:] != part[:-1]))))
        kind = (level[of[first]].astype(np.uint64) << np.uint64(40)) | part[first]
        found.append(mix(np.add.reduceat(w, first) + mix(kind + np.uint64(1))))
        owner.append(of[first])
        filled = np.bincount(of[first], minlength=n_docs)
        for d in np.flatnonzero(used & (filled <= differ[level])).tolist():
            empty = np.setdiff1d(np.arange(parts[level[d]], dtype=np.uint64), part[first][of[first] == d])
            found.append(mix(mix((np.uint64(level[d]) << np.uint64(40)) | empty) ^ np.uint64(0xD6E8FEB86659FD93)))
            owner.append(np.full(len(empty), d))
    if not found:
        return np.zeros(0, np.int64), np.zeros(n_docs + 1, np.int64)
    owners = np.concatenate(owner)
    every = np.concatenate(found).astype(np.int64)[np.argsort(owners, kind="stable")]
    return every, np.concatenate(([0], np.cumsum(np.bincount(owners, minlength=n_docs))))


def scan_sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Size and class of every document's set; with the first of a class in a task also its counts, bits and columns ``grams``."""
    small_batches(docs.sparkSession)

    def scan(batches):
        seen: set[int] = set()
        for batch in batches:
            for low, high, data, off in blocks(batch.column("text")):
                values, place = shingle_sets(Words(data, off, lower=True), n)
                fp = set_hashes(values, place)
                fresh = np.zeros(len(fp), bool)
                for r, key in enumerate(fp.tolist()):
                    if place[r + 1] > place[r] and key not in seen:
                        fresh[r] = True
                        seen.add(key)
                if len(seen) > SEEN:
                    seen = set()
                kept = np.repeat(fresh, np.diff(place))
                own = np.concatenate(([0], np.cumsum(np.where(fresh, np.diff(place), 0))))
                grams, at = columns_of(values[kept], own, percent)
                counts = block_counts(values, place)
                columns = [
                    batch.column("doc_id").slice(low, high - low), batch.column("th").slice(low, high - low), pa.array(np.diff(place)), pa.array(fp),
                    pa.array([c if f else None for c, f in zip(counts, fresh.tolist(), strict=True)], pa.binary()),
                    pa.array([range_bits(values[place[r] : place[r + 1]]) if f else None for r, f in enumerate(fresh.tolist())], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(grams)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[part.split()[0] for part in SCAN.split(", ")])
        release_memory()

    return written(docs.mapInArrow(scan, SCAN), "sets")


def shared_columns(scanned: DataFrame) -> DataFrame:
    """The columns that several classes have: (gram, fp, n). Rows are dealt by column once."""
    postings = scanned.filter("counts is not null").select(F.explode("grams").alias("gram"), "fp", F.col("n").cast("int").alias("n"))
    own = Window.partitionBy("gram")
    met = postings.withColumns({"low": F.min("fp").over(own), "high": F.max("fp").over(own)}).filter("low < high")
    return written(met.select("gram", "fp", "n").dropDuplicates(["gram", "fp"]), "matrix")


def _possible(percent: int, n: Column, m: Column) -> Column:
    """Whether sets of n and m n-grams can be similar."""
    return 100 * F.least(n, m).cast("long") >= percent * F.greatest(n, m)


def _reached(pivot: np.ndarray, row: np.ndarray, needed: int) -> bool:
    """Whether two sorted sets share ``needed`` columns; gives up at the block of columns after which they cannot."""
    common = 0
    for low in range(0, len(row), COLUMNS):
        if common + len(row) - low < needed:
            return False
        part = row[low : low + COLUMNS]
        at = np.searchsorted(pivot, part)
        inside = at < len(pivot)
        common += int((pivot[at[inside]] == part[inside]).sum())
    return common >= needed


def overlaps(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that reach the similarity, by whole sets; ``texts(fp, text)``.

    Pairs are grouped by ``a`` and blocks of about BLOCK members, so a popular pivot spreads
    over tasks; each block has its pivot's text once, before its members'.
    """
    counts = pairs.groupBy("a").agg(F.count("*").alias("members"))
    placed = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("members") / BLOCK)).alias("block"))
    members = placed.join(texts, placed.b == texts.fp).select("a", "block", F.lit(1).alias("role"), "b", "text")
    pivots = placed.select("a", "block").distinct().join(texts, F.col("a") == texts.fp).select("a", "block", F.lit(0).alias("role"), F.col("a").alias("b"), "text")
    together = members.unionByName(pivots).repartition(partitions(pairs.sparkSession), "a", "block").sortWithinPartitions("a", "block", "role")

    def intersect(batches):
        pivot = np.zeros(0, np.int64)
        for batch in batches:
            a, b, role = batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("role").to_pylist()
            found: list[tuple[int, int]] = []
            for low, high, data, off in blocks(batch.column("text")):
                values, place = shingle_sets(Words(data, off, lower=True), n)
                for r in range(low, high):
                    row = values[place[r - low] : place[r - low + 1]]
                    if role[r] == 0:
                        pivot = row
                    elif _reached(pivot, row, -(-percent * (len(pivot) + len(row)) // (100 + percent))):
                        found.append((a[r], b[r]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return together.mapInArrow(intersect, "a long, b long")


class _Rows:
    """One row block: its sets end to end, their sizes, classes and components."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.fp: list[int] = []
        self.component: list[int] = []

    def add(self, values: np.ndarray, fp: int, component: int) -> None:
        self.parts.append(values)
        self.fp.append(fp)
        self.component.append(component)

    def closed(self):
        sizes = np.array([len(p) for p in self.parts], np.int64)
        return np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64), sizes, np.array(self.fp, np.int64), np.array(self.component, np.int64)


def _incidence(values: np.ndarray, sizes: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column number of the entries that fall into the sorted ``columns``."""
    at = np.searchsorted(columns, values)
    inside = at < len(columns)
    inside[inside] = columns[at[inside]] == values[inside]
    return np.repeat(np.arange(len(sizes)), sizes)[inside], at[inside]


def product_links(first: _Rows, second: _Rows | None, percent: int) -> list[tuple[int, int]]:
    """Multiply two row blocks (or one with itself); returns links that connect what the product connects."""
    values, sizes, fp, component = first.closed()
    values_, sizes_, fp_, component_ = (first if second is None else second).closed()
    if not len(values) or not len(values_):
        return []
    needed = -(-percent * (sizes[:, None] + sizes_[None, :]) // (100 + percent))
    open_ = (component[:, None] != component_[None, :]) & (needed <= np.minimum(sizes[:, None], sizes_[None, :]))
    columns = np.intersect1d(values, values_)
    (row, col), (row_, col_) = _incidence(values, sizes, columns), _incidence(values_, sizes_, columns)
    rest, rest_ = np.bincount(row, minlength=len(sizes)), np.bincount(row_, minlength=len(sizes_))
    shared = np.zeros(needed.shape, np.float32)
    open_ &= np.minimum(rest[:, None], rest_[None, :]) >= needed
    for low in range(0, len(columns), COLUMNS):
        if not open_.any():
            return []
        width = min(COLUMNS, len(columns) - low)
        here, here_ = (col >= low) & (col < low + width), (col_ >= low) & (col_ < low + width)
        left, right = np.zeros((len(sizes), width), np.float32), np.zeros((len(sizes_), width), np.float32)
        left[row[here], col[here] - low] = 1
        right[row_[here_], col_[here_] - low] = 1
        shared += left @ right.T
        rest, rest_ = rest - np.bincount(row[here], minlength=len(rest)), rest_ - np.bincount(row_[here_], minlength=len(rest_))
        open_ &= shared + np.minimum(rest[:, None], rest_[None, :]) >= needed
    linked = open_
    # labels of rows and columns of the link matrix until they agree; then one link for each row but a component's first
    every = np.concatenate((fp, fp_))
    label = every.copy()
    top = np.iinfo(np.int64).max
    while True:
        mine, other = label[: len(fp)], label[len(fp) :]
        new = np.minimum(mine, np.where(linked, other[None, :], top).min(axis=1))
        new_ = np.minimum(other, np.where(linked, new[:, None], top).min(axis=0))
        both = np.concatenate((new, new_))
        if (both == label).all():
            break
        label = both
    moved = label != every
    return list(set(zip(label[moved].tolist(), every[moved].tolist(), strict=True)))


def block_rows(rows: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Row blocks of ``rows(gram, fp, n, component)`` by couples of them: (gram, block, block_, side, fp, component) of the
    rows that may be similar to one of another component there, by the counts and bits of ``held``."""
    placed, before = sorted_positions(rows, [F.col("gram"), F.col("n"), F.col("fp")], "open-rows")
    blocked = placed.withColumn("block", ((F.col("_row") + looked_up(before, F.col("_pid"))) / ROW_BLOCK).cast("long")).select("gram", "block", "fp", "component", "n")
    spans = blocked.groupBy("gram", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("component").alias("low"), F.max("component").alias("high"))
    other = spans.select("gram", *[F.col(c).alias(f"{c}_") for c in spans.columns if c != "gram"])
    couples = written(
        spans.join(other, "gram").filter((F.col("block") <= F.col("block_")) & (100 * F.col("most") >= percent * F.col("least_")) & ((F.least("low", "low_") < F.greatest("high", "high_"))))
        .select("gram", "block", "block_"),
        "couples",
    )
    left = blocked.join(couples, ["gram", "block"]).select("gram", "block", "block_", F.lit(0).alias("side"), "fp", "component")
    right = blocked.withColumnRenamed("block", "block_").join(couples.filter("block < block_"), ["gram", "block_"]).select("gram", "block", "block_", F.lit(1).alias("side"), "fp", "component")
    both = left.unionByName(right).join(held.select("fp", "n", "counts", "bits"), "fp")
    together = both.repartition(partitions(rows.sparkSession), "gram", "block", "block_").sortWithinPartitions("gram", "block", "block_", "side", "fp")
    names = ["gram", "block", "block_", "side", "fp", "component"]

    def choose(batches):
        now, waiting = None, []

        def done():
            whole = pa.Table.from_batches(waiting)
            first = np.flatnonzero(whole.column("side").to_numpy() == 0)
            second = np.flatnonzero(whole.column("side").to_numpy() == 1) if now[1] != now[2] else first
            n, component = whole.column("n").to_numpy(), whole.column("component").to_numpy()
            counts = np.frombuffer(b"".join(whole.column("counts").to_pylist()), np.uint8).reshape(-1, COLUMN_BLOCKS)
            bits = whole.column("bits").to_pylist()
            met = may_link(n[first], counts[first], [bits[r] for r in first], n[second], counts[second], [bits[r] for r in second], percent)
            met &= component[first][:, None] != component[second][None, :]
            kept = np.zeros(len(n), bool)
            kept[first] |= met.any(axis=1)
            kept[second] |= met.any(axis=0)
            return whole.select(names).filter(pa.array(kept)).combine_chunks().to_batches()

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in names[:3]])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if low == high:
                    continue
                if waiting and tuple(keys[:, low].tolist()) != now:
                    yield from done()
                    waiting = []
                now = tuple(keys[:, low].tolist())
                waiting.append(batch.slice(low, high - low))
        if waiting:
            yield from done()
        release_memory()

    return written(together.mapInArrow(choose, "gram long, block long, block_ long, side int, fp long, component long"), "block-rows")


def block_products(rows: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) that connect what the products of couples of row blocks, ``rows`` of :func:`block_rows`, connect."""
    both = rows.join(texts, "fp").select("gram", "block", "block_", "side", "fp", "component", "text")
    together = both.repartition(partitions(rows.sparkSession), "gram", "block", "block_").sortWithinPartitions("gram", "block", "block_", "side", "fp")

    def multiply(batches):
        now, sides = None, (_Rows(), _Rows())

        def done():
            found = product_links(sides[0], sides[1] if now[1] != now[2] else None, percent) if now else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("gram", "block", "block_")), strict=True))
            side, fp, component = (batch.column(c).to_pylist() for c in ("side", "fp", "component"))
            for low, high, data, off in blocks(batch.column("text")):
                values, place = shingle_sets(Words(data, off, lower=True), n)
                for r in range(low, high):
                    if keys[r] != now:
                        yield done()
                        now, sides = keys[r], (_Rows(), _Rows())
                    sides[side[r]].add(values[place[r - low] : place[r - low + 1]], fp[r], component[r])
        yield done()
        release_memory()

    return together.mapInArrow(multiply, "a long, b long")


def _texts_of(docs: DataFrame, wanted: DataFrame, classes: DataFrame) -> DataFrame:
    """(fp, text) of the classes ``wanted(fp)``, found by the doc_id and text hash of one member each."""
    ids = written(wanted.join(classes, "fp").select("fp", "rep.*"), "wanted")
    held = F.broadcast(ids) if ids.count() <= MAX_IDS else ids
    same = docs.doc_id.eqNullSafe(ids.doc_id) & (docs.th == ids.th)
    return written(docs.join(held, same).select("fp", "text").dropDuplicates(["fp"]), "texts")


def grouped(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Every row of ``docs(doc_id, text)``: doc_id, th (hash of the text), n, component_id, and the component's first document ``first``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    scanned = scan_sets(docs, n, percent)
    member = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th")
    counts_of = scanned.filter("counts is not null").select("fp", "n", "counts", "bits").dropDuplicates(["fp"])
    matrix = shared_columns(scanned)
    held = written(counts_of.join(matrix.select("fp").distinct(), "fp", "left_semi"), "blocks")
    sets = written(scanned.select("doc_id", "th", "n", "fp"), "classes")
    classes = sets.filter("n > 0").groupBy("fp").agg(F.min(member).alias("rep"), F.min("doc_id").alias("smallest"))
    forget(scanned)  # its columns are the largest step, and all of it that is still needed is written
    heavy_grams = written(matrix.groupBy("gram").agg(F.count("*").alias("rows")).filter(F.col("rows") > LIGHT).select("gram"), "heavy-columns")
    light, heavy = matrix.join(heavy_grams, "gram", "left_anti"), matrix.join(heavy_grams, "gram", "left_semi")

    possible = _possible(percent, F.col("n"), F.col("n_"))
    under = light.select("gram", F.col("fp").alias("fp_"), F.col("n").alias("n_"))
    met = light.join(under, "gram").filter((F.col("fp_") < F.col("fp")) & possible).select(F.col("fp_").alias("a"), F.col("fp").alias("b"))
    row = [F.col("fp").alias("fp_"), F.col("n").alias("n_")]
    pivots = heavy.groupBy("gram").agg(F.min(F.struct("n", F.struct(*row).alias("r"))).alias("shortest"), F.min(F.struct(F.xxhash64("fp").alias("h"), F.struct(*row).alias("r"))).alias("any"))
    pivots = pivots.select("gram", F.explode(F.array("shortest.r", "any.r")).alias("r")).select("gram", "r.*")
    turned = heavy.join(pivots, "gram").filter((F.col("fp") != F.col("fp_")) & possible).select(F.col("fp_").alias("a"), F.col("fp").alias("b"))
    pairs = written(bounded(met.unionByName(turned).distinct(), held, percent), "pairs")
    texts = _texts_of(docs, pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct(), classes)
    links = written(overlaps(pairs, texts, n, percent), "links")
    forget(texts)
    joined = components(links)

    named_rows = heavy.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("gram", "fp", "n", F.coalesce("component", "fp").alias("component"))
    several = named_rows.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("gram")
    open_rows = written(named_rows.join(several, "gram", "left_semi"), "open")
    named = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    if not open_rows.isEmpty():
        rows = block_rows(open_rows, held, percent)
        texts = _texts_of(docs, rows.select("fp").distinct(), classes)
        more = written(block_products(rows, texts, n, percent), "links")
        forget(texts)
        # these links join whole components, so only components are labelled anew
        of = joined.select(F.col("node"), F.col("component").alias("label"))
        ends = more.join(of, more.a == of.node, "left").select(F.coalesce("label", "a").alias("a"), "b").join(of, F.col("b") == of.node, "left").select("a", F.coalesce("label", "b").alias("b"))
        above = components(ends.filter("a <> b").distinct()).select(F.col("node").alias("component"), F.col("component").alias("above"))
        named = named.join(above, "component", "left").withColumn("component", F.coalesce("above", "component")).drop("above")

    smallest = named.groupBy("component").agg(F.min("rep").alias("first"), F.min("smallest").alias("component_id"))
    by_class = named.join(smallest, "component").select("fp", "component_id", "first")
    own = F.col("n") == 0
    return sets.join(by_class, "fp", "left").select(
        "doc_id", "th", "n", F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(own, member).otherwise(F.col("first")).alias("first")
    )


def similar_groups(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) for ``docs(doc_id, text)``; similar: Jaccard of ``percent`` or more."""
    return grouped(docs, n, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Documents without near copies: of every group the one with the smallest doc_id stays.

    Rows that repeat both doc_id and text are one document. Rows that share a doc_id but not a text, and
    rows without a doc_id, are documents of their own; named ones come first in a group.
    """
    groups = written(grouped(docs, n, percent), "groups")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    rows = groups.filter(is_first).groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.count("*").alias("rows"))
    stay = written(rows, "stay")
    few, most = stay.agg(F.count("*"), F.coalesce(F.max("rows"), F.lit(0))).first()
    keyed = docs.withColumn("__key", F.xxhash64(F.col("text").cast("string")))
    held = stay.select("__id", "__th")
    kept = keyed.join(F.broadcast(held) if few <= MAX_IDS else held, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__th")), "left_semi")
    if most > 1:
        kept = kept.dropDuplicates(["doc_id", "__key"])
    return kept.select(*docs.columns)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))
