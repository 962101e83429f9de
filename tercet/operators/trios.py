"""Exact volume of three-way forced choice, over all trios of rows, and its U-statistic error.

A trio (one row of each class) is right if its own assignment beats the five others, which is five strict inequalities between
score differences: x.a > y.a, x.b > z.b, y.c > z.c, y.c + x.a > z.b and x.b > y.a + z.c (a, b, c: log scores 0 - 1, 0 - 2 and 1 - 2). Log
scores are whole numbers of 1e-9, so that all of it is exact. Equal points of a class are one point with a count. The points of a
class are cut into at most BOXES^2 boxes by quantiles of both coordinates. Triples of boxes that satisfy all five inequalities are
counted whole, those that break one are left out, and the points of the others meet in tasks by (x box, y box), where boxes
are halved further until they decide, or few points are left. Those are counted as dominance queries: a pair (y, z) asks for the x
beyond two limits in a summed-area table over the ranks of the x. Work is pairs of distinct points at worst, never trios.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tercet.operators.ranking import P, prepared
from tercet.session import ship_library, written_step

#: Boxes along each coordinate, at most; points of a box that are aimed at.
BOXES, BOX_POINTS = 8, 1024
#: Pairs and points that are counted at once.
LEAF_PAIRS, LEAF_POINTS = 1 << 20, 1024
UNIT = 1e9
TASKS = 2048


def score_points(sample: DataFrame, p: list[str] = P) -> DataFrame:
    """Distinct points of each class, y, u, v (whole numbers), with their numbers of rows n."""
    logs = prepared(sample, p).select("y", *[F.round(F.col(f"l{k}") * UNIT).cast("long").alias(f"l{k}") for k in range(3)])
    # written once: the log scores are deep expressions, and filters pushed below them would repeat them inside each other
    whole = written_step(logs.groupBy("y", "l0", "l1", "l2").agg(F.count("*").alias("n")), "points")[0].na.drop()
    a, b, c = F.col("l0") - F.col("l1"), F.col("l0") - F.col("l2"), F.col("l1") - F.col("l2")
    y = F.col("y")
    placed = whole.filter(y.isin(0, 1, 2)).select("y", F.when(y == 2, b).otherwise(a).alias("u"), F.when(y == 0, b).otherwise(c).alias("v"), "n")
    return placed.groupBy("y", "u", "v").agg(F.sum("n").alias("n"))


def boxed(points: DataFrame) -> DataFrame:
    """``points`` with their ``box``; only the boxes' edges reach the driver. Boxes are found in tasks, since as one column
    expression they would swell every filter that Spark derives from the joins."""
    sizes = dict(points.groupBy("y").count().collect())  # three rows
    sides = {y: int(min(BOXES, max(1, np.ceil(np.sqrt(n / BOX_POINTS))))) for y, n in sizes.items()}
    strips, cells = {}, {}

    def placed(use_cells: bool) -> DataFrame:
        def place(batches):
            for batch in batches:
                y, u, v, n = (c.to_numpy() for c in batch.columns)
                box = np.zeros(len(y), np.int32)
                for k in np.unique(y).tolist():
                    own = np.flatnonzero(y == k)
                    strip = np.searchsorted(strips.get(k, []), u[own], "right")
                    for t in np.unique(strip).tolist() if use_cells else ():
                        at = own[strip == t]
                        box[at] = np.searchsorted(cells.get((k, t), []), v[at], "right")
                    box[own] += (strip * BOXES).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(box)], names=["y", "u", "v", "n", "box"])

        return points.select(F.col("y").cast("int"), "u", "v", "n").mapInArrow(place, "y int, u long, v long, n long, box int")

    def edges(frame: DataFrame, value: str, k: int) -> DataFrame:
        return frame.agg(F.percentile_approx(value, F.array(*[F.lit(t / sides[k]) for t in range(1, sides[k])]), F.lit(10_000)).alias("e"))

    wide = [k for k, s in sides.items() if s > 1]
    for k in wide:
        strips[k] = sorted(set(edges(points.filter(F.col("y") == k), "u", k).first().e))
    for k in wide:
        for r in edges(placed(False).filter(F.col("y") == k).groupBy("box"), "v", k).collect():  # a row a strip
            cells[k, r.box // BOXES] = sorted(set(r.e))
    return placed(True)


def _decided(x: tuple, y: tuple, z: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Whether all inequalities hold, and whether all may hold, for boxes given as (u low, u high, v low, v high)."""
    left_low = [x[0], x[2], y[2], y[2] + x[0], x[2]]
    left_high = [x[1], x[3], y[3], y[3] + x[1], x[3]]
    right_low = [y[0], z[0], z[2], z[0], y[0] + z[2]]
    right_high = [y[1], z[1], z[3], z[1], y[1] + z[3]]
    every = [a > b for a, b in zip(left_low, right_high, strict=True)]
    some = [a > b for a, b in zip(left_high, right_low, strict=True)]
    return reduce(lambda a, b: a & b, every), reduce(lambda a, b: a & b, some)


class _Points:
    """Points of one class in a box, and the number of right trios that each one is in."""

    def __init__(self, u: np.ndarray, v: np.ndarray, n: np.ndarray):
        self.u, self.v, self.n, self.m = u, v, n, np.zeros(len(u), np.int64)


def _bounds(p: _Points, at: np.ndarray) -> tuple:
    u, v = p.u[at], p.v[at]
    return u.min(), u.max(), v.min(), v.max()


def _halves(p: _Points, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, v = p.u[at], p.v[at]
    by = u if u.max() - u.min() >= v.max() - v.min() else v
    order = at[np.argsort(by, kind="stable")]
    return order[: len(order) // 2], order[len(order) // 2 :]


def count_trios(x: _Points, y: _Points, z: _Points) -> None:
    """Add to every point's ``m`` the right trios that it is in."""
    waiting = [tuple(np.arange(len(p.u)) for p in (x, y, z))]
    while waiting:
        ix, iy, iz = waiting.pop()
        if not (len(ix) and len(iy) and len(iz)):
            continue
        every, some = _decided(_bounds(x, ix), _bounds(y, iy), _bounds(z, iz))
        if not some:
            continue
        if every:
            nx, ny, nz = (int(p.n[at].sum()) for p, at in ((x, ix), (y, iy), (z, iz)))
            x.m[ix] += ny * nz
            y.m[iy] += nx * nz
            z.m[iz] += nx * ny
        elif len(ix) <= LEAF_POINTS and len(iy) * len(iz) <= LEAF_PAIRS:
            _leaf(x, y, z, ix, iy, iz)
        elif len(ix) > LEAF_POINTS and len(ix) >= max(len(iy), len(iz)):
            waiting += [(h, iy, iz) for h in _halves(x, ix)]
        elif len(iy) >= len(iz):
            waiting += [(ix, h, iz) for h in _halves(y, iy)]
        else:
            waiting += [(ix, iy, h) for h in _halves(z, iz)]


def _leaf(x: _Points, y: _Points, z: _Points, ix: np.ndarray, iy: np.ndarray, iz: np.ndarray) -> None:
    first, ra = np.unique(x.u[ix], return_inverse=True)
    second, rb = np.unique(x.v[ix], return_inverse=True)
    a1, c1, b2, c2 = y.u[iy][:, None], y.v[iy][:, None], z.u[iz][None, :], z.v[iz][None, :]
    j, k = np.nonzero(np.broadcast_to(c1 > c2, (len(iy), len(iz))))
    a1, c1, b2, c2 = a1[j, 0], c1[j, 0], b2[0, k], c2[0, k]
    p = np.searchsorted(first, np.maximum(a1, b2 - c1), "right")
    q = np.searchsorted(second, np.maximum(b2, a1 + c2), "right")
    beyond = np.zeros((len(first) + 1, len(second) + 1), np.int64)
    np.add.at(beyond, (ra, rb), x.n[ix])
    beyond = beyond[::-1, ::-1].cumsum(0).cumsum(1)[::-1, ::-1]
    g = beyond[p, q]
    ny, nz = y.n[iy][j], z.n[iz][k]
    y.m[iy] += np.bincount(j, weights=g * nz, minlength=len(iy)).astype(np.int64)
    z.m[iz] += np.bincount(k, weights=g * ny, minlength=len(iz)).astype(np.int64)
    asked = np.bincount(p * (len(second) + 1) + q, weights=ny * nz, minlength=beyond.size).reshape(beyond.shape).cumsum(0).cumsum(1)
    x.m[ix] += asked[ra, rb].astype(np.int64)


def trio_counts(sample: DataFrame, p: list[str] = P) -> DataFrame:
    """Every distinct point with the number of right trios that one of its rows is in: y, u, v, n, m."""
    spark = sample.sparkSession
    ship_library(spark)
    points = boxed(score_points(sample, p))
    box = points.groupBy("y", "box").agg(F.sum("n").alias("n"), F.min("u").alias("ul"), F.max("u").alias("uh"), F.min("v").alias("vl"), F.max("v").alias("vh")).toPandas()  # 3 x BOXES^2 rows at most
    side = [box[box.y == k].reset_index(drop=True) for k in range(3)]
    ends = [tuple(s[c].to_numpy() for c in ("ul", "uh", "vl", "vh")) for s in side]
    whole, opened = [{} for _ in range(3)], []
    for i in range(len(side[0])):
        every, some = _decided(tuple(e[i] for e in ends[0]), tuple(e[:, None] for e in ends[1]), tuple(e[None, :] for e in ends[2]))
        shape = (len(side[1]), len(side[2]))
        every, some = np.broadcast_to(every, shape), np.broadcast_to(some, shape)
        ny, nz, nx = side[1].n.to_numpy(), side[2].n.to_numpy(), int(side[0].n[i])
        whole[0][int(side[0].box[i])] = int(ny @ every @ nz)
        for t, (k, add) in ((1, ("box", nx * (every @ nz))), (2, ("box", nx * (ny @ every)))):
            for name, value in zip(side[t][k], add.tolist(), strict=True):
                whole[t][int(name)] = whole[t].get(int(name), 0) + value
        for j, k in np.argwhere(some & ~every).tolist():
            opened.append((int(side[0].box[i]), int(side[1].box[j]), int(side[2].box[k])))
    extra = spark.createDataFrame([(t, b, v) for t in range(3) for b, v in whole[t].items()] or [(0, -1, 0)], "y int, box int, extra long")
    out = points.join(F.broadcast(extra), ["y", "box"], "left")
    if opened:
        triples = spark.createDataFrame(opened, "xb int, yb int, zb int")
        pairs = triples.select("xb", "yb").distinct()
        own = points.select(F.col("y").alias("role"), "box", "u", "v", "n")
        roles = [pairs.join(own.filter("role = 0"), F.col("xb") == F.col("box")), pairs.join(own.filter("role = 1"), F.col("yb") == F.col("box")), triples.join(own.filter("role = 2"), F.col("zb") == F.col("box")).drop("zb")]

        def count(part: pd.DataFrame) -> pd.DataFrame:
            def of(rows: pd.DataFrame) -> _Points:
                return _Points(*(rows[c].to_numpy() for c in "uvn"))

            x, y, rest = of(part[part.role == 0]), of(part[part.role == 1]), []
            for _, rows in part[part.role == 2].groupby("box"):
                rest.append(of(rows))
                count_trios(x, y, rest[-1])
            parts = [(0, x), (1, y), *((2, z) for z in rest)]
            return pd.concat([pd.DataFrame({"y": np.full(len(q.u), t, np.int32), "u": q.u, "v": q.v, "m": q.m}) for t, q in parts])

        tasks = min(len({o[:2] for o in opened}), TASKS)  # few bytes and much work: a number that Spark doesn't lower
        met = reduce(DataFrame.unionByName, roles).repartition(tasks, "xb", "yb").groupBy("xb", "yb").applyInPandas(count, "y int, u long, v long, m long")
        out = out.join(met.groupBy("y", "u", "v").agg(F.sum("m").alias("m")), ["y", "u", "v"], "left")
    else:
        out = out.withColumn("m", F.lit(0).cast("long"))
    return out.select("y", "u", "v", "n", (F.coalesce("m", F.lit(0)) + F.coalesce("extra", F.lit(0))).alias("m"))


def exact_volume(sample: DataFrame, p: list[str] = P) -> DataFrame:
    """The share of right trios with the error of its conditional means: vus, se, zeta0 to zeta2, n_trios. Without rows of a class, no volume."""
    per_row = [F.sum(F.when(F.col("y") == k, F.col("n"))).alias(f"n{k}") for k in range(3)]
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    sums = [F.sum(F.when(F.col("y") == k, n * m)).alias(f"s{k}") for k in range(3)] + [F.sum(F.when(F.col("y") == k, n * m * m)).alias(f"q{k}") for k in range(3)]
    s = trio_counts(sample, p).agg(*per_row, *sums)
    every = F.col("n0").cast("double") * F.col("n1") * F.col("n2")
    zeta = []
    for k in range(3):
        rest, size = every / F.col(f"n{k}"), F.col(f"n{k}").cast("double")
        spread = F.greatest(F.col(f"q{k}") - F.col(f"s{k}") * F.col(f"s{k}") / size, F.lit(0.0))
        zeta.append(F.when(size > 1, spread / (size - 1) / rest / rest).otherwise(F.when(size.isNotNull(), 0.0)))
    se = F.sqrt(sum((z / F.col(f"n{k}") for k, z in enumerate(zeta)), F.lit(0.0)))
    return s.select((F.col("s0") / every).alias("vus"), se.alias("se"), *[z.alias(f"zeta{k}") for k, z in enumerate(zeta)], every.cast("decimal(38,0)").cast("double").alias("n_trios"))


def exact_profile(sample: DataFrame, p: list[str] = P) -> DataFrame:
    """The share of trios that each of the six assignments wins strictly: perm, prob. Ties win for none."""
    from tercet.operators.ranking import PERMS

    parts = [exact_volume(sample, [p[k] for k in perm]).select(F.lit("".join(map(str, perm))).alias("perm"), F.col("vus").alias("prob")) for perm in PERMS]
    return reduce(DataFrame.unionByName, parts)
