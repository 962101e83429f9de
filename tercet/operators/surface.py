"""Operating rules of three-class scores: surfaces, volumes, fronts and operating points.

A rule predicts class 0 where d01 >= a and d02 >= b, class 1 where d01 < a and d12 >= b - a, and class 2 elsewhere (d are
differences of log scores). Rows never meet rules: each row falls into one cell of a grid that the rules' own values span, cells are
counted in tasks, and a rule's confusion counts are look-ups in summed-area tables of those counts. Grids, rules, fronts and volumes
depend on the resolution alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tercet.operators import ceilings
from tercet.operators.ceilings import CHANCE, hull_points
from tercet.operators.ordering import quantiles
from tercet.operators.ranking import prepared
from tercet.session import dropped_step, ship_library, written_step

#: Cells of the largest table that one task sums up.
CELLS = 1 << 27
_COUNTS = [f"c{y}{k}" for y in range(3) for k in range(3)]


# ---- rules ------------------------------------------------------------------------------------


def differences(sample: DataFrame) -> DataFrame:
    """y and the rounded differences of the log scores."""
    return prepared(sample).select("y", *[F.round(c, 6).alias(c) for c in ("d01", "d02", "d12")])


def counted(sample: DataFrame) -> tuple[DataFrame, str]:
    """Rows n of each distinct (y, d01, d02, d12), written once, and where they lie.

    The differences are deep expressions: filters pushed below them repeat them inside each other until the code no longer compiles.
    """
    return written_step(differences(sample).groupBy("y", "d01", "d02", "d12").agg(F.count("*").alias("n")), "differences")


def lattice(spark: SparkSession, n: int) -> DataFrame:
    """Barycentric weights (i, j, n-i-j)/n with their log ratios against the first class."""
    i = spark.range(n + 1).select(F.col("id").alias("i"))
    j = spark.range(n + 1).select(F.col("id").alias("j"))
    cells = i.crossJoin(F.broadcast(j)).filter(F.col("i") + F.col("j") <= n)
    w = [F.col("i") / F.lit(float(n)), F.col("j") / F.lit(float(n)), (n - F.col("i") - F.col("j")) / F.lit(float(n))]
    logs = [F.ln(F.greatest(x, F.lit(1e-300))) for x in w]
    return cells.select((F.col("i") * (n + 1) + F.col("j")).alias("rule_id"), w[0].alias("w0"), w[1].alias("w1"), w[2].alias("w2"), (logs[1] - logs[0]).alias("a"), (logs[2] - logs[0]).alias("b"))


def lattice_surface(sample: DataFrame, n: int = 96) -> DataFrame:
    """The surface on an even mesh of weights, log ratios clipped to twice the widest span of the scores (one at least)."""
    points, path = counted(sample)
    span = points.agg(F.greatest(*[F.max(c) - F.min(c) for c in ("d01", "d02", "d12")], F.lit(1.0)).alias("__s"))
    span = sample.sparkSession.createDataFrame(span.collect(), span.schema)
    rules = lattice(sample.sparkSession, n).crossJoin(F.broadcast(span))
    clipped = rules.withColumns({c: F.round(F.greatest(F.least(F.col(c), 2 * F.col("__s")), -2 * F.col("__s")), 9) for c in "ab"}).drop("__s")
    return _surface(points, path, clipped)


def sweep_axis(frame: DataFrame, value: str, resolution: int, pad: float) -> np.ndarray:
    """Cuts between neighbouring distinct values, and one ``pad`` outside either end. Of more than ``resolution`` values, their even quantiles."""
    distinct = frame.select(value).filter(F.col(value).isNotNull()).distinct()
    few = [r[0] for r in distinct.limit(resolution + 1).collect()]
    if not few:
        return np.array([-pad, pad])
    u = np.array(few, float) if len(few) <= resolution else np.array(quantiles(distinct, value, np.linspace(0, 1, resolution).tolist()).first().q)
    u = np.unique(u)
    return np.concatenate(([u[0] - pad], (u[:-1] + u[1:]) / 2, [u[-1] + pad]))


def weights_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weights that sum to one from their log ratios against the first."""
    logs = np.stack([np.zeros_like(a), a, b], axis=1)
    w = np.exp(logs - logs.max(axis=1, keepdims=True))
    return w / w.sum(axis=1, keepdims=True)


def roc_surface(sample: DataFrame, resolution: int = 160) -> DataFrame:
    """The surface on every pair of ``resolution`` cuts of d01 and d02: i, j and what :func:`surface` gives."""
    d, path = counted(sample)
    ends = d.agg(*[(F.max(c) - F.min(c)).alias(c) for c in ("d01", "d02", "d12")]).first()
    pad = max(1.0, 2.0 * max((x or 0.0) for x in ends))
    first, second = (sweep_axis(d, c, resolution, pad) for c in ("d01", "d02"))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(first)), np.arange(len(second)), indexing="ij"))
    w = weights_of(first[i], second[j])
    rules = pd.DataFrame({"rule_id": i * len(second) + j, "i": i, "j": j, "w0": w[:, 0], "w1": w[:, 1], "w2": w[:, 2], "a": first[i], "b": second[j]})
    return _surface(d, path, sample.sparkSession.createDataFrame(rules))


def surface(sample: DataFrame, rules: DataFrame) -> DataFrame:
    """``rules`` with confusion counts c00 to c22 (true, predicted), sensitivities s0 to s2 (null for a class without rows) and accuracy.

    The rules, a parameter, reach the driver. Rows without a difference take no part.
    """
    return _surface(*counted(sample), rules)


def _surface(points: DataFrame, path: str, rules: DataFrame) -> DataFrame:
    """:func:`surface` of written points (:func:`counted`), which are deleted once they are counted into cells."""
    spark = points.sparkSession
    ship_library(spark)
    held = rules.select("rule_id", F.col("a").cast("double"), F.col("b").cast("double")).toPandas()
    ids, a, b = (held[c].to_numpy() for c in ("rule_id", "a", "b"))
    axes = [np.unique(x) for x in (a, b, b - a)]
    place = [np.searchsorted(x, v) for x, v in zip(axes, (a, b, b - a), strict=True)]
    size = [len(x) + 1 for x in axes]
    if max(size[0] * size[1], size[0] * size[2]) > CELLS:
        raise ValueError(f"{len(ids)} rules span more than {CELLS} cells")
    shared = spark.sparkContext.broadcast(axes)

    def count(batches):
        first, second, third = shared.value
        total: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            y, *d, rows = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            p = [np.searchsorted(x, v, "right") for x, v in zip((first, second, third), d, strict=True)]  # cuts at or below
            for kind, other in ((0, p[1]), (1, p[2])):
                key = ((y.astype(np.int64) * 2 + kind) * (len(first) + 1) + p[0]) * (max(len(second), len(third)) + 1) + other
                total.append(_merged([(key, rows)]))
            if sum(len(t[0]) for t in total) > 1 << 22:
                total = [_merged(total)]
        if total:
            key, n = _merged(total)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    width = max(len(axes[1]), len(axes[2])) + 1
    cells, _ = written_step(points.na.drop().mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "cells")
    dropped_step(spark, path)

    def look_up(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        y, kind = divmod(int(key[0]), 2)
        at = part["key"].to_numpy() % (size[0] * width)
        table = np.zeros((size[0], size[1 + kind]), np.int64)
        table[at // width, at % width] = part["n"].to_numpy()
        total = int(table.sum())
        if kind == 0:
            table = table[::-1, ::-1].cumsum(0).cumsum(1)[::-1, ::-1]
            n = table[place[0] + 1, place[1] + 1]
        else:
            table = table.cumsum(0)[:, ::-1].cumsum(1)[:, ::-1]
            n = table[place[0], place[2] + 1]
        return pd.DataFrame({"rule_id": ids, "slot": 2 * y + kind, "n": n, "total": total})

    by_table = F.floor(F.col("key") / (size[0] * width)).cast("int")
    found = cells.groupBy(by_table.alias("table")).applyInPandas(look_up, "rule_id long, slot int, n long, total long")  # six tables
    at = {f"{name}{y}{kind}": F.coalesce(F.max(F.when(F.col("slot") == 2 * y + kind, F.col(name))), F.lit(0)) for y in range(3) for kind in (0, 1) for name in ("n", "total")}
    wide = found.groupBy("rule_id").agg(*[c.alias(f"__{k}") for k, c in at.items()])
    cell = {}
    for y in range(3):
        cell |= {f"c{y}0": F.col(f"__n{y}0"), f"c{y}1": F.col(f"__n{y}1"), f"c{y}2": F.col(f"__total{y}0") - F.col(f"__n{y}0") - F.col(f"__n{y}1")}
    counted = wide.select("rule_id", *[c.alias(k) for k, c in cell.items()])
    rows = [F.col(f"c{y}0") + F.col(f"c{y}1") + F.col(f"c{y}2") for y in range(3)]
    share = {f"s{y}": F.when(rows[y] > 0, F.col(f"c{y}{y}") / rows[y]) for y in range(3)}
    return rules.join(counted, "rule_id").withColumns({**share, "accuracy": (F.col("c00") + F.col("c11") + F.col("c22")) / (rows[0] + rows[1] + rows[2])})


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return key, np.bincount(which, weights=np.concatenate([p[1] for p in parts]), minlength=len(key)).astype(np.int64)


# ---- fronts and volumes -----------------------------------------------------------------------


def iso_slice(surfaced: DataFrame, x: str, y: str, held: str, floor: float) -> DataFrame:
    """Best ``y`` as ``x`` falls, among rules whose ``held`` sensitivity reaches the floor: strict records only (bounded by the rules)."""
    best = surfaced.filter(F.col(held) >= floor).groupBy(x).agg(F.max(y).alias(y))
    before = F.max(y).over(Window.orderBy(F.col(x).desc()).rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("__b", F.coalesce(before, F.lit(-1.0))).filter(F.col(y) > F.col("__b")).drop("__b")


def points(surfaced: DataFrame) -> DataFrame:
    """Distinct (s0, s1) with their best s2: all that volumes and fronts depend on."""
    return surfaced.groupBy(F.round("s0", 9).alias("s0"), F.round("s1", 9).alias("s1")).agg(F.max(F.round("s2", 9)).alias("s2"))


def _gathered(found: DataFrame) -> DataFrame:
    """All points as three arrays of one row (as many as there are rules at most)."""
    every = found.agg(F.collect_list(F.struct("s0", "s1", "s2")).alias("e"))
    return every.select(*[F.col(f"e.s{k}").alias(f"s{k}") for k in range(3)])


def _descending(s: np.ndarray) -> np.ndarray:
    return s[np.lexsort((-s[:, 2], -s[:, 1], -s[:, 0]))]


def swept_front(s: np.ndarray) -> np.ndarray:
    """Points that no other one dominates, by falling s0 over a staircase of the other two; equal points are kept once."""
    s = _descending(np.unique(s, axis=0))
    steps = np.unique(s[:, 1])
    best = np.full(len(steps), -np.inf)  # the largest s2 so far with s1 at or above a step
    keep = np.zeros(len(s), bool)
    for k, j in enumerate(np.searchsorted(steps, s[:, 1])):
        if best[j] < s[k, 2]:
            keep[k] = True
            low = int(np.searchsorted(-best[: j + 1], -s[k, 2]))  # best never rises with the step
            best[low : j + 1] = s[k, 2]
    return s[keep]


def swept_volume(s: np.ndarray, floors: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> float:
    """Exact volume of the union of boxes from ``floors`` to the points."""
    s = _descending(s[(s > np.array(floors)).all(axis=1)])
    if not len(s):
        return 0.0
    steps = np.unique(s[:, 1])
    width, best, volume = np.diff(steps, prepend=floors[1]), np.full(len(steps), float(floors[2])), 0.0
    last = np.append(s[1:, 0], floors[0])
    for k, j in enumerate(np.searchsorted(steps, s[:, 1])):
        best[: j + 1] = np.maximum(best[: j + 1], s[k, 2])
        if s[k, 0] > last[k]:
            volume += (s[k, 0] - last[k]) * float(width @ (best - floors[2]))
    return volume


def pareto_front(surfaced: DataFrame) -> DataFrame:
    """Non-dominated points (bounded by the number of rules), by one sweep."""
    ship_library(surfaced.sparkSession)

    @F.pandas_udf("array<struct<s0:double,s1:double,s2:double>>")
    def front(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("s0", "s1", "s2"), p, strict=True)) for p in swept_front(np.stack(v, axis=1)).tolist()] if len(v[0]) else [] for v in zip(x, y, z, strict=True)])

    return _gathered(points(surfaced).na.drop()).select(F.explode(front("s0", "s1", "s2")).alias("p")).select("p.*")


def _measured(front: DataFrame, measure, name: str) -> DataFrame:
    ship_library(front.sparkSession)

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([measure(np.stack(v, axis=1)) if len(v[0]) else 0.0 for v in zip(x, y, z, strict=True)], dtype=float)

    return _gathered(front).select(of("s0", "s1", "s2").alias(name))


def hypervolume(front: DataFrame, floors: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Exact volume of the union of boxes from ``floors`` to the points: one row, 0 for none."""
    return _measured(front, lambda s: swept_volume(s, floors), "volume")


def hull_volume(front: DataFrame) -> DataFrame:
    """Volume below the convex hull of the points, which mixtures of rules reach. Each task keeps the hull of its own points; those few meet in one."""
    ship_library(front.sparkSession)

    def local(batches):
        every = [np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches]
        if every and sum(map(len, every)):
            kept = hull_points(np.concatenate(every))
            yield pa.RecordBatch.from_arrays([pa.array(kept[:, k]) for k in range(3)], names=["s0", "s1", "s2"])

    return _measured(front.select("s0", "s1", "s2").mapInArrow(local, "s0 double, s1 double, s2 double"), ceilings.hull_volume, "volume")


def hypervolume_mc(front: DataFrame, n_samples: int = 400_000, seed: int = 0) -> DataFrame:
    """The union's volume by seeded points drawn in tasks, with its error: volume, se, n_samples. The front (bounded by the rules) is broadcast."""
    spark = front.sparkSession
    ship_library(spark)
    shared = spark.sparkContext.broadcast(swept_front(np.array([list(r) for r in front.select("s0", "s1", "s2").collect()]).reshape(-1, 3)))

    def hits(batches):
        for batch in batches:
            u = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            inside = np.zeros(len(u), bool)
            for p in shared.value:
                inside |= (u <= p).all(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([int(inside.sum())]), pa.array([len(u)])], names=["hit", "n"])

    drawn = spark.range(n_samples).select(*[(F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 52)) / float(1 << 52)).alias(f"u{k}") for k in range(3)])
    s = drawn.mapInArrow(hits, "hit long, n long").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n"))
    p = F.col("hit") / F.col("n")
    return s.select(p.alias("volume"), F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) / F.col("n")).alias("se"), F.col("n").alias("n_samples"))


def adjusted(volume: Column) -> Column:
    """A volume on a scale from chance (0) to perfect (1)."""
    return (volume - CHANCE) / (1 - CHANCE)


def envelope(front: DataFrame, resolution: int = 201) -> DataFrame:
    """Best s2 given floors on s0 and s1 at cell midpoints; its mean approximates the volume."""
    spark = front.sparkSession
    mid = (F.col("id") + 0.5) / F.lit(float(resolution))
    u = spark.range(resolution).select(F.col("id").alias("i"), mid.alias("u"))
    v = spark.range(resolution).select(F.col("id").alias("j"), mid.alias("v"))
    # a point counts for the cells up to its own; then running maxima from above along both axes
    own = front.select(F.floor(F.col("s0") * resolution - 0.5).alias("i"), F.floor(F.col("s1") * resolution - 0.5).alias("j"), "s2", "s0", "s1")
    for axis, s in (("i", "s0"), ("j", "s1")):  # products may round across a midpoint
        at = F.col(axis)
        at = F.when((at + 1.5) / resolution <= F.col(s), at + 1).otherwise(at)
        own = own.withColumn(axis, at).withColumn(axis, F.when((F.col(axis) + 0.5) / resolution > F.col(s), F.col(axis) - 1).otherwise(F.col(axis)))
    best = own.filter("i >= 0 and j >= 0").groupBy(F.least("i", F.lit(resolution - 1)).alias("i"), F.least("j", F.lit(resolution - 1)).alias("j")).agg(F.max("s2").alias("z"))
    grid = u.crossJoin(F.broadcast(v)).join(best, ["i", "j"], "left")
    along = grid.withColumn("z", F.max("z").over(Window.partitionBy("i").orderBy(F.col("j").desc())))
    return along.withColumn("z", F.max("z").over(Window.partitionBy("j").orderBy(F.col("i").desc()))).select("i", "j", F.coalesce("z", F.lit(0.0)).alias("z"))


# ---- operating points -------------------------------------------------------------------------

CRITERIA = ["youden", "balanced_accuracy", "closest_to_perfection", "maximin", "accuracy", "max_volume"]


def objectives(surfaced: DataFrame, costs: list[list[float]] | None = None, priors: list[float] | None = None) -> DataFrame:
    """The criteria of every rule, higher is better. ``costs`` (true, predicted) add ``expected_cost``; ``priors`` replace the classes' shares."""
    s = [F.col(f"s{k}") for k in range(3)]
    rows = [F.col(f"c{y}0") + F.col(f"c{y}1") + F.col(f"c{y}2") for y in range(3)]
    every = rows[0] + rows[1] + rows[2]
    share = [x / every for x in rows] if priors is None else [F.lit(float(p) / sum(priors)) for p in priors]
    out = {
        "youden": s[0] + s[1] + s[2] - 1,
        "balanced_accuracy": (s[0] + s[1] + s[2]) / 3,
        "closest_to_perfection": -F.sqrt((1 - s[0]) * (1 - s[0]) + (1 - s[1]) * (1 - s[1]) + (1 - s[2]) * (1 - s[2])),
        "maximin": F.least(*s),
        "max_volume": s[0] * s[1] * s[2],
    }
    if priors is not None:
        out["accuracy"] = share[0] * s[0] + share[1] * s[1] + share[2] * s[2]
    if costs is not None:
        terms = [share[y] * (F.col(f"c{y}{k}") / rows[y]) * float(costs[y][k]) for y in range(3) for k in range(3)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        out["expected_cost"] = -total
    return surfaced.withColumns(out)


def select_points(surfaced: DataFrame, floors: dict[str, float] | None = None, costs: list[list[float]] | None = None, priors: list[float] | None = None, strict: bool = False) -> DataFrame:
    """The best rule of each criterion among those that meet the floors.

    Values within 1e-12 of the best tie; then the most balanced rule, then the smallest id, wins. Floors that no rule meets leave no
    row, or raise if ``strict``.
    """
    allowed = objectives(surfaced, costs, priors)
    for name, floor in (floors or {}).items():
        allowed = allowed.filter(F.col(name) >= floor)
    if strict and not allowed.limit(1).count():
        raise ValueError(f"no rule meets {floors}")
    wanted = CRITERIA + ["expected_cost"] * (costs is not None)
    long = allowed.select("rule_id", "s0", "s1", "s2", F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).alias("value")) for c in wanted])).alias("e")).select("rule_id", "s0", "s1", "s2", "e.criterion", "e.value")
    top = F.max("value").over(Window.partitionBy("criterion"))
    tied = long.withColumn("__top", top).filter(F.col("value") >= F.col("__top") - 1e-12)
    best = tied.groupBy("criterion").agg(F.min_by(F.struct("rule_id", "value", "s0", "s1", "s2"), F.struct(-F.least("s0", "s1", "s2"), F.col("rule_id"))).alias("b"))
    return best.select("criterion", "b.*")


#: Floors of a guarantee: 0.600 to 0.975 in steps of 0.025.
FLOORS = [round(0.6 + 0.025 * k, 3) for k in range(16)]


def guarantee_curve(surfaced: DataFrame, floors: list[float] = FLOORS, held: str = "s2") -> DataFrame:
    """The best youden value for every floor on one sensitivity: what a guarantee costs. It ends before the first floor that no rule meets."""
    wanted = surfaced.sparkSession.createDataFrame([(float(f),) for f in floors], "floor double")
    met = objectives(surfaced).crossJoin(F.broadcast(wanted)).filter(F.col(held) >= F.col("floor"))
    return met.groupBy("floor").agg(F.max("youden").alias("best_youden"), F.count("*").alias("n_rules"))


# ---- ordered classes --------------------------------------------------------------------------


def ordinal_surface(sample: DataFrame, marker: str, resolution: int = 200, classes: tuple[int, int, int] = (0, 1, 2), direction: str = "increasing") -> DataFrame:
    """Rules t1 <= t2 on a marker: the first class below t1, the last from t2, the middle one between: rule_id, k1, k2, t1, t2, confusion counts
    c00 to c22 and sensitivities in the given order of the classes, and accuracy. Rows meet the cuts once, as a count by place."""
    if direction not in ("increasing", "decreasing"):
        raise ValueError("the direction is increasing or decreasing")
    spark, sign = sample.sparkSession, -1.0 if direction == "decreasing" else 1.0
    ship_library(spark)
    held = sample.select("y", (F.col(marker) * sign).alias("m")).filter("m is not null")
    span = held.agg((F.max("m") - F.min("m")).alias("s")).first().s or 0.0
    cuts = sweep_axis(held, "m", resolution, 0.05 * max(span, 1.0))
    shared, order = spark.sparkContext.broadcast(cuts), list(classes)

    def place(batches):
        for batch in batches:
            y, m = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            key, n = np.unique(y.astype(np.int64) * (len(shared.value) + 1) + np.searchsorted(shared.value, m, "right"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key // (len(shared.value) + 1)), pa.array(key % (len(shared.value) + 1)), pa.array(n)], names=["y", "bin", "n"])

    counts = held.mapInArrow(place, "y long, bin long, n long").groupBy("y", "bin").agg(F.sum("n").alias("n"))  # classes x cuts rows
    cut = spark.createDataFrame([(k, float(t)) for k, t in enumerate(cuts)], "k long, t double")
    under = [F.coalesce(F.sum(F.when((F.col("y") == c) & (F.col("bin") <= F.col("k")), F.col("n"))), F.lit(0)) for c in order]
    below = cut.crossJoin(F.broadcast(counts)).groupBy("k", "t").agg(*[u.alias(f"b{p}") for p, u in enumerate(under)])
    every = counts.agg(*[F.coalesce(F.sum(F.when(F.col("y") == c, F.col("n"))), F.lit(0)).alias(f"n{p}") for p, c in enumerate(order)])
    low, high = (below.select(*[F.col(c).alias(f"{c}_{side}") for c in below.columns]) for side in ("l", "h"))
    pairs = low.crossJoin(F.broadcast(high)).filter("k_l <= k_h").crossJoin(F.broadcast(every))
    cell = {}
    for p in range(3):
        cell |= {f"c{p}0": F.col(f"b{p}_l"), f"c{p}1": F.col(f"b{p}_h") - F.col(f"b{p}_l"), f"c{p}2": F.col(f"n{p}") - F.col(f"b{p}_h")}
    t1, t2 = (F.col("t_l"), F.col("t_h")) if sign > 0 else (-F.col("t_h"), -F.col("t_l"))
    out = pairs.select((F.col("k_l") * len(cuts) + F.col("k_h")).alias("rule_id"), F.col("k_l").alias("k1"), F.col("k_h").alias("k2"), t1.alias("t1"), t2.alias("t2"), *[F.col(f"n{p}") for p in range(3)], *[c.alias(k) for k, c in cell.items()])
    share = {f"s{p}": F.when(F.col(f"n{p}") > 0, F.col(f"c{p}{p}") / F.col(f"n{p}")) for p in range(3)}
    return out.withColumns({**share, "accuracy": (F.col("c00") + F.col("c11") + F.col("c22")) / (F.col("n0") + F.col("n1") + F.col("n2"))}).drop("n0", "n1", "n2")
