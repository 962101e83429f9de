"""Trees grown from histograms: boosting with offsets, own gradients and columns of one direction, and forests.

Columns are cut into at most ``bins`` bins by approximate quantiles of one pass, which only chooses where a cut may lie. Rows are
written once as bin numbers, targets and margins; rows equal in all of these are written as one cell with the number of its rows that
each round draws, which teaches the same (see ``_gathered``), so that few values make few cells, however many the rows. Each level of the trees in growth is one pass: tasks sum gradient, hessian and
rows by (tree, node, column, bin), the sums meet by slot, and the driver reads at most SLOTS of them a pass to choose the cuts; no
row reaches it. Every BLOCK rounds the margins are written anew, so that a pass applies BLOCK rounds of trees at most.

Null and NaN columns lie below every cut. Rows with a null target, offset or weight, or a weight that is not positive, do not
teach. Without such rows the model is its start. Sampling hashes the row's key, so that it does not depend on files or tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tercet.operators.fitting import row_arrays
from tercet.session import dropped_step, ship_library, written_step

BLOCK, SLOTS = 10, 400_000
#: Bytes of rows that a task looks through at once for equal ones, and cells that it holds.
CHUNK, HELD_CELLS = 32 << 20, 200_000

Gradients = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


# ---- losses: margins (rows x outputs) and targets (rows x targets) to gradients and hessians ------
# A row whose hessian is 0 for an output does not teach it.


def squared_each(m: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A target for every output."""
    return m - t, np.ones_like(m)


def squared(m: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return m - t[:, :1], np.ones_like(m)


def logistic(m: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 0.5 * (1 + np.tanh(m / 2))
    return p - t[:, :1], np.maximum(p * (1 - p), 1e-16)


def logistic_by_arm(arms: int, folds: int = 1) -> Gradients:
    """Outputs fold by fold and arm by arm within: each learns from its arm's rows outside its fold. Targets: y, arm, fold."""

    def gradients(m: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fold, arm = np.divmod(np.arange(m.shape[1]), arms)
        mine = (t[:, 1:2] == arm) & ((t[:, 2:3] != fold) | (folds < 2))
        g, h = logistic(m, t)
        return np.where(mine, g, 0), np.where(mine, h, 0)

    return gradients


def squared_by_fold(values: int, folds: int) -> Gradients:
    """Outputs fold by fold and value by value within: each learns from the rows outside its fold. Targets: the values, then the fold."""

    def gradients(m: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fold, value = np.divmod(np.arange(m.shape[1]), values)
        mine = (t[:, values, None] != fold) | (folds < 2)
        return np.where(mine, m - t[:, value], 0), mine.astype(float)

    return gradients


def softmax(m: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first target is the class number."""
    p = class_shares(m)
    own = t[:, :1] == np.arange(m.shape[1])
    return p - own, np.maximum(2 * p * (1 - p), 1e-16)


def class_shares(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def scalar_flip(m: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buyers' arms under one elasticity softplus(margin). Targets: arm number, then allocation and dose of every arm; Fisher hessian."""
    k = (t.shape[1] - 1) // 2
    pi, z = t[:, 1 : k + 1], t[:, k + 1 :]
    beta, slope = np.logaddexp(0, m), 0.5 * (1 + np.tanh(m / 2))
    r = class_shares(np.log(pi) - beta * z)
    mean = (r * z).sum(1, keepdims=True)
    var = np.maximum((r * z * z).sum(1, keepdims=True) - mean * mean, 0)
    own = np.take_along_axis(z, t[:, :1].astype(int), 1)
    return (own - mean) * slope, np.maximum(var * slope * slope, 1e-8)


# ---- trees --------------------------------------------------------------------------------------


@dataclass
class Tree:
    """A binary tree in heap order: rows with a bin up to ``cut`` go left; ``column`` is -1 at leaves."""

    depth: int
    column: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self):
        size = 2 ** (self.depth + 1) - 1
        self.column, self.cut, self.value = np.full(size, -1, np.int16), np.zeros(size, np.uint8), np.zeros(size)

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        at, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            c = self.column[at]
            at = np.where(c >= 0, 2 * at + 1 + (bins[row, np.maximum(c, 0)] > self.cut[at]), at)
        return at

    def read(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins, self.depth)]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(x.shape, np.uint8)
    for f, e in enumerate(edges):
        out[:, f] = np.where(np.isnan(x[:, f]), 0, 1 + np.searchsorted(e, x[:, f], "left"))
    return out


@dataclass
class Trees:
    """A fitted model: ``rounds`` of trees by output."""

    columns: list[str]
    edges: list[np.ndarray]
    start: np.ndarray
    rounds: list[list[Tree]]

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins, back = binned(x, self.edges), None
        if math.prod(len(e) + 2 for e in self.edges) < 2**62:
            code = np.zeros(len(x), np.int64)
            for f, e in enumerate(self.edges):
                code = code * (len(e) + 2) + bins[:, f]
            _, first, which = np.unique(code, return_index=True, return_inverse=True)
            if 2 * len(first) <= len(x):  # rows of the same bins are read once
                bins, back = bins[first], which
        out = np.tile(self.start, (len(bins), 1))
        for trees in self.rounds:
            for c, tree in enumerate(trees):
                out[:, c] += tree.read(bins)
        return out if back is None else out[back]

    def predict(self, then: Callable[[np.ndarray], np.ndarray] | None = None, columns: list[Column] | None = None) -> Column:
        """The margins, or ``then`` of them, as an array column; ``columns`` stand in for the model's own."""

        def read(m: np.ndarray) -> np.ndarray:
            found = self.margins(m)
            return found if then is None else then(found)

        return row_arrays(read, [c.cast("double") for c in (columns or [F.col(c) for c in self.columns])])


# ---- training rows ------------------------------------------------------------------------------


def _packed(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    x = np.ascontiguousarray(x)
    places = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(places), pa.py_buffer(x)])


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    places = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[places[0] : places[-1]].copy().view(kind).reshape(len(column), width)


def column_edges(df: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """Interior bin edges of every column, ``bins`` - 2 at most: one row."""
    at = [k / (bins - 1) for k in range(1, bins - 1)]
    found = df.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), at, 10_000).alias(f"e{i}") for i, c in enumerate(columns)]).first()
    return [np.unique(np.array(e if e is not None else [], float)) for e in found]


def _uniform(key: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) from hashed keys."""
    with np.errstate(over="ignore"):
        z = key.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)) * 2.0**-53


def _drawn(key: np.ndarray, seed: int, share: float, poisson: bool) -> np.ndarray:
    """How often each row is drawn: a Poisson number of mean ``share``, or 1 with this chance."""
    if poisson:
        u, term, out = _uniform(key, seed), np.exp(-share), np.zeros(len(key))
        below = term
        for k in range(1, 20):
            out += u >= below
            term *= share / k
            below += term
        return out
    return np.ones(len(key)) if share >= 1 else (_uniform(key, seed) < share).astype(float)


@dataclass(frozen=True)
class _Shape:
    columns: int
    targets: int
    outputs: int
    bins: int

    def read(self, batches):
        """Bins, values, keys and draws of rows or of cells: rows have no draws (None), cells no keys."""
        for batch in batches:
            single = pc.is_null(batch.column(3))
            for part, rows in ((batch.filter(single), True), (batch.filter(pc.invert(single)), False)):
                if part.num_rows:
                    draws = None if rows else _matrix(part.column(3), len(part.column(3)[0].as_py()) // 8, np.float64)
                    yield part, _matrix(part.column(0), self.columns, np.uint8), _matrix(part.column(1), 1 + self.targets + self.outputs, np.float64), part.column(2).to_numpy(zero_copy_only=False) if rows else None, draws


def _training_rows(df: DataFrame, columns: list[str], edges: list[np.ndarray], targets: list[Column], start: list[float], offset: list[Column] | None, weight: Column | None, key: Column | None) -> tuple[DataFrame, Callable]:
    """The rows that teach, and what packs their batches in tasks as (b, v, key): bins, and weight, targets and margins."""
    p, rest = len(columns), [F.lit(1.0) if weight is None else weight, *targets, *(offset or [])]
    asked = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], *[c.cast("double").alias(f"v{i}") for i, c in enumerate(rest)], F.xxhash64(F.lit(0) if key is None else key).alias("key"))
    sound, upto, shifted = asked.na.drop(subset=[f"v{i}" for i in range(len(rest))]).filter("v0 > 0"), p + 1 + len(targets), bool(offset)

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                values = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[:-1]]
                own = values[upto:] if shifted else [np.zeros(batch.num_rows)] * len(start)
                margins = [o + float(s) for o, s in zip(own, start, strict=True)]
                yield pa.RecordBatch.from_arrays([_packed(binned(np.column_stack(values[:p]), edges)), _packed(np.column_stack([*values[p:upto], *margins])), batch.columns[-1]], names=["b", "v", "key"])

    return sound, pack


def _equal(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each group of equal rows of a byte matrix, and every row's group."""
    words = np.zeros((len(records), -(-records.shape[1] // 8) * 8), np.uint8)
    words[:, : records.shape[1]] = records
    h = np.zeros(len(records), np.uint64)
    with np.errstate(over="ignore"):
        for w in words.view(np.uint64).T:
            h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    if not np.array_equal(records[first][which], records):  # two groups of one hash
        _, first, which = np.unique(np.ascontiguousarray(records).view(f"V{records.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return first, which


def _gathered(rows: DataFrame, pack: Callable, shape: _Shape, seeds: list[int], share: float, poisson: bool) -> tuple[DataFrame, str]:
    """The training rows as a written table (b, v, key, n): equal rows as cells without a key, whose ``n`` tells how many of them each of
    the ``seeds`` draws. Rows stay single where cells would not take half their bytes. A cell may come in several parts."""
    width, spark = shape.columns + 8 * (1 + shape.targets + shape.outputs), rows.sparkSession

    def batch_of(records, keys=None, n=None):
        packed = [_packed(records[:, : shape.columns]), _packed(records[:, shape.columns :])]
        rest = [pa.array(keys), pa.nulls(len(keys), pa.binary())] if n is None else [pa.nulls(len(n), pa.int64()), _packed(n)]
        return pa.RecordBatch.from_arrays([*packed, *rest], names=["b", "v", "key", "n"])

    def pieces(records, keys=None, n=None):
        for at in range(0, len(records), 50_000):
            part = slice(at, at + 50_000)
            yield batch_of(records[part], None if keys is None else keys[part], None if n is None else n[part])

    def gather(batches):
        cells, counts, waiting, held = np.zeros((0, width), np.uint8), np.zeros((0, len(seeds))), [], 0
        for batch in _with_end(batches):
            if batch is not None and batch.num_rows:
                one = np.column_stack([_matrix(batch.column(0), shape.columns, np.uint8), _matrix(batch.column(1), width - shape.columns, np.uint8)])
                whole = len(batch.schema) > 3
                waiting.append((one, None if whole else batch.column(2).to_numpy(), _matrix(batch.column(3), len(seeds), np.float64) if whole else None))
                held += len(one)
            if not held or (batch is not None and held * width < CHUNK):
                continue
            new = np.concatenate([w[0] for w in waiting])
            first, which = _equal(np.concatenate([cells, new]))
            grown = len(first) - len(cells)
            if waiting[0][2] is None:
                keys = np.concatenate([w[1] for w in waiting])
                if 2 * grown * (width + 8 * len(seeds)) > len(new) * (width + 8):
                    yield from pieces(new, keys)
                    waiting, held = [], 0
                    continue
                more = np.column_stack([_drawn(keys, s, share, poisson) for s in seeds])
            else:
                more = np.concatenate([w[2] for w in waiting])
            every, both = np.concatenate([cells, new]), np.concatenate([counts, more])
            cells, counts = every[first], np.column_stack([np.bincount(which, weights=c, minlength=len(first)) for c in both.T])
            waiting, held = [], 0
            if len(cells) > HELD_CELLS:
                yield from pieces(cells, n=counts)
                cells, counts = cells[:0], counts[:0]
        if len(cells):
            yield from pieces(cells, n=counts)

    table = "b binary, v binary, key long, n binary"
    found, path = written_step(rows.mapInArrow(lambda batches: gather(pack(batches)), table), "boost")
    kinds = found.agg(F.count("key").alias("rows"), F.count("n").alias("cells")).first()
    if kinds.rows or not kinds.cells:
        return found, path
    met, newer = written_step(found.repartition("b", "v").mapInArrow(gather, table), "boost")
    dropped_step(spark, path)
    return met, newer


def _with_end(batches):
    yield from batches
    yield None


def _moved(rows: DataFrame, shape: _Shape, done: list[list[Tree]]) -> DataFrame:
    """The rows with their margins after the trees in ``done``."""

    def move(batches):
        for part, bins, v, _, _ in shape.read(batches):
            for trees in done:
                for c, tree in enumerate(trees):
                    v[:, 1 + shape.targets + c] += tree.read(bins)
            yield pa.RecordBatch.from_arrays([part.column(0), _packed(v), part.column(2), part.column(3)], names=["b", "v", "key", "n"])

    return rows.mapInArrow(move, "b binary, v binary, key long, n binary")


# ---- growth -------------------------------------------------------------------------------------


@dataclass
class _Growing:
    """A tree in growth: the output it explains, how its rows are drawn (``turn``: which of the cells' draws is its own), the columns it may
    use and the bounds of its nodes."""

    tree: Tree
    output: int
    seed: int
    share: float
    poisson: bool
    usable: np.ndarray
    low: np.ndarray
    high: np.ndarray

    turn: int

    def drawn(self, keys: np.ndarray | None, draws: np.ndarray | None) -> np.ndarray:
        return _drawn(keys, self.seed, self.share, self.poisson) if draws is None else draws[:, min(self.turn, draws.shape[1] - 1)]


def _sums(rows: DataFrame, shape: _Shape, gradients: Gradients, done: list[list[Tree]], growing: list[_Growing], level: int) -> np.ndarray:
    """Gradient, hessian and rows by (tree, node of the level, column, bin), summed in tasks: an array of the last axis three."""
    size = (len(growing), 2**level, shape.columns, shape.bins)
    first, per = 2**level - 1, 2**level * shape.bins

    def add(batches):
        total = np.zeros((3, len(growing), shape.columns, per))
        for _, bins, v, keys, draws in shape.read(batches):
            m = v[:, 1 + shape.targets :]
            for trees in done:
                for c, tree in enumerate(trees):
                    m[:, c] += tree.read(bins)
            g, h = gradients(m, v[:, 1 : 1 + shape.targets])
            for k, grown in enumerate(growing):
                node, w = grown.tree.nodes(bins, level) - first, grown.drawn(keys, draws)
                at = np.flatnonzero((node >= 0) & (w > 0) & (h[:, grown.output] > 0))
                w = w[at]
                mine, base = bins[at], node[at] * shape.bins
                parts = (g[at, grown.output] * w * v[at, 0], h[at, grown.output] * w * v[at, 0], w)
                for f in np.flatnonzero(grown.usable).tolist():
                    slot = base + mine[:, f]
                    for i, part in enumerate(parts):
                        total[i, k, f] += np.bincount(slot, weights=part, minlength=per)
        flat = total.reshape(3, -1)
        used = np.flatnonzero(flat[2])
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(flat[i, used]) for i in range(3)]], names=["slot", "g", "h", "n"])

    out = np.zeros((3, len(growing) * shape.columns * per))
    summed = rows.mapInArrow(add, "slot long, g double, h double, n double").groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    found = summed.toArrow()  # SLOTS rows at most
    for i, name in enumerate(("g", "h", "n")):
        out[i, found["slot"].to_numpy()] = found[name].to_numpy()
    return np.moveaxis(out.reshape(3, size[0], size[2], size[1], size[3]), 0, -1).swapaxes(1, 2)


def _split(grown: _Growing, sums: np.ndarray, level: int, signs: np.ndarray, reg: float, min_rows: float, min_weight: float, rate: float, node_columns: np.ndarray | None) -> None:
    """Cut the level's nodes where the loss falls most. ``sums``: nodes x columns x bins x 3. Ties: first column, then lowest cut."""
    tree, first = grown.tree, 2**level - 1
    total = sums[:, np.flatnonzero(grown.usable)[0]].sum(1)
    g, h = total[:, 0], total[:, 1]
    if level == 0:
        tree.value[0] = rate * np.clip(-g[0] / (h[0] + reg), grown.low[0], grown.high[0]) if h[0] + reg > 0 else 0.0
    left = np.cumsum(sums, 2)[:, :, :-1]
    right = total[:, None, None, :] - left
    low, high = (b[first : first + len(g), None, None] for b in (grown.low, grown.high))
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = (np.clip(-s[..., 0] / (s[..., 1] + reg), low, high) for s in (left, right))
        own = np.clip(-g / (h + reg), low[:, 0, 0], high[:, 0, 0])

        def fall(s: np.ndarray, w: np.ndarray) -> np.ndarray:
            return -(s[..., 0] * w + 0.5 * (s[..., 1] + reg) * w * w)

        gain = fall(left, a) + fall(right, b) - fall(total, own)[:, None, None]
        ordered = signs[None, :, None] * (b - a) >= 0
    sound = (left[..., 2] >= min_rows) & (right[..., 2] >= min_rows) & (left[..., 1] >= min_weight) & (right[..., 1] >= min_weight)
    sound &= ordered & grown.usable[None, :, None]
    if node_columns is not None:
        sound &= node_columns[:, :, None]
    gain = np.where(sound & np.isfinite(gain), gain, -np.inf)
    best = gain.reshape(len(g), -1).argmax(1)
    for k in range(len(g)):
        f, cut = divmod(int(best[k]), gain.shape[2])
        if not gain[k, f, cut] > 1e-12:
            continue
        node = first + k
        tree.column[node], tree.cut[node] = f, cut
        middle = (a[k, f, cut] + b[k, f, cut]) / 2
        for child, value, side in ((2 * node + 1, a[k, f, cut], 0), (2 * node + 2, b[k, f, cut], 1)):
            tree.value[child] = rate * value
            grown.low[child], grown.high[child] = grown.low[node], grown.high[node]
            if signs[f] > 0:
                (grown.high if side == 0 else grown.low)[child] = middle
            elif signs[f] < 0:
                (grown.low if side == 0 else grown.high)[child] = middle


def _new(depth: int, output: int, seed: int, share: float, poisson: bool, usable: np.ndarray, turn: int) -> _Growing:
    size = 2 ** (depth + 1) - 1
    return _Growing(Tree(depth), output, seed, share, poisson, usable, np.full(size, -np.inf), np.full(size, np.inf), turn)


def boost(df: DataFrame, columns: list[str], gradients: Gradients, targets: list[Column], start: list[float], *, offset: list[Column] | None = None, weight: Column | None = None,
          key: Column | None = None, monotone: dict[str, int] | None = None, rounds: int = 100, depth: int = 4, rate: float = 0.1, reg: float = 1.0, min_rows: float = 20,
          min_weight: float = 1e-3, subsample: float = 1.0, colsample: float = 1.0, bins: int = 64, seed: int = 0) -> Trees:
    """Gradient-boosted trees by second-order steps.

    ``start`` is the margin of every output before any tree, to which a row's ``offset`` is added in training; predictions leave
    the offset out. ``monotone`` gives columns their direction, +1 or -1: no cut breaks it, and the bounds of its two sides hold below it.
    """
    ship_library(df.sparkSession)
    signs = np.array([(monotone or {}).get(c, 0) for c in columns])
    edges, outputs = column_edges(df, columns, bins), len(start)
    shape = _Shape(len(columns), len(targets), outputs, bins)
    asked = _training_rows(df, columns, edges, targets, start, offset, weight, key)
    seeds = [seed * 1_000_003 + turn for turn in range(max(rounds, 1))]
    rows, path = _gathered(*asked, shape, seeds if subsample < 1 else seeds[:1], subsample, False)
    rng, kept, block = np.random.default_rng(seed), [], []
    for turn in range(rounds):
        usable = np.zeros(len(columns), bool)
        usable[rng.permutation(len(columns))[: max(1, round(colsample * len(columns)))]] = True
        growing = [_new(depth, c, seeds[turn], subsample, False, usable, turn) for c in range(outputs)]
        for level in range(depth):
            per = max(1, SLOTS // (2**level * len(columns) * bins))
            for at in range(0, outputs, per):
                part = growing[at : at + per]
                sums = _sums(rows, shape, gradients, block, part, level)
                for grown, s in zip(part, sums, strict=True):
                    _split(grown, s, level, signs, reg, min_rows, min_weight, rate, None)
            if not any((g.tree.column[2**level - 1 : 2 ** (level + 1) - 1] >= 0).any() for g in growing):
                break
        block.append([g.tree for g in growing])
        if len(block) == BLOCK and turn + 1 < rounds:
            rows, newer = written_step(_moved(rows, shape, block), "boost")
            dropped_step(df.sparkSession, path)
            kept, block, path = kept + block, [], newer
    dropped_step(df.sparkSession, path)
    return Trees(columns, edges, np.array(start, float), kept + block)


def forest(df: DataFrame, columns: list[str], target: Column, *, weight: Column | None = None, key: Column | None = None, trees: int = 50, depth: int = 8, min_share: float = 0.02,
           max_features: float = 0.7, max_samples: float = 0.8, bins: int = 64, seed: int = 0) -> Trees:
    """A forest for a weighted mean: all trees grow together, a level a pass (SLOTS permitting). Bootstrap samples draw each row a
    Poisson number of times; a leaf holds ``min_share`` of a tree's rows at least; every node may use its own random columns."""
    ship_library(df.sparkSession)
    edges = column_edges(df, columns, bins)
    shape = _Shape(len(columns), 1, 1, bins)
    asked = _training_rows(df, columns, edges, [target], [0.0], None, weight, key)
    seeds = [seed * 1_000_003 + k for k in range(trees)]
    rows, path = _gathered(*asked, shape, seeds, max_samples, True)
    usable, signs, rng = np.ones(len(columns), bool), np.zeros(len(columns)), np.random.default_rng(seed)
    growing = [_new(depth, 0, seeds[k], max_samples, True, usable, k) for k in range(trees)]
    least = [0.0] * trees
    for level in range(depth):
        per = max(1, SLOTS // (2**level * len(columns) * bins))
        for at in range(0, trees, per):
            sums = _sums(rows, shape, squared, [], growing[at : at + per], level)
            for k, s in enumerate(sums, at):
                if level == 0:
                    least[k] = max(1.0, min_share * s[0, 0, :, 2].sum())
                some = rng.random((2**level, len(columns))).argsort(1).argsort(1) < max(1, round(max_features * len(columns)))
                _split(growing[k], s, level, signs, 0.0, least[k], 1e-12, 1.0 / trees, some)
    dropped_step(df.sparkSession, path)
    return Trees(columns, edges, np.zeros(1), [[g.tree] for g in growing])
