"""Ceilings that an order of the true posterior puts on three-class rules.

Feasible confusion matrices form a polytope of a few dozen vertices that depends on three class shares only; those are
found once. Whatever is asked of a table (surfaces, audits) is a Spark expression over the polytope's facets.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHANCE = 1.0 / 6.0


def constraints(priors: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """A x <= b over x = (first and second entry of each confusion row): rows are distributions, and the share-weighted
    columns rise over the classes, which is what an ordered posterior implies."""
    pi = np.asarray(priors, float) / sum(priors)
    unit = np.eye(6)
    entry = [[(unit[2 * k], 0.0), (unit[2 * k + 1], 0.0), (-unit[2 * k] - unit[2 * k + 1], 1.0)] for k in range(3)]
    rows = [(-linear, constant) for row in entry for linear, constant in row]
    for low, high in itertools.combinations(range(3), 2):
        for (a, c), (b, d) in zip(entry[low], entry[high], strict=True):
            rows.append((pi[low] * a - pi[high] * b, pi[high] * d - pi[low] * c))
    return np.array([a for a, _ in rows]), np.array([b for _, b in rows])


def achievable(priors: tuple[float, float, float]) -> np.ndarray:
    """Sensitivity triples at the polytope's vertices: all points where six constraints meet inside the others."""
    a, b = constraints(priors)
    sets = np.array(list(itertools.combinations(range(len(a)), 6)))
    system, right = a[sets], b[sets]
    sound = np.abs(np.linalg.det(system)) > 1e-10
    x = np.linalg.solve(system[sound], right[sound][:, :, None])[:, :, 0]
    x = x[(x @ a.T <= b + 1e-9).all(axis=1)]
    s = np.stack([x[:, 0], x[:, 3], 1 - x[:, 4] - x[:, 5]], axis=1)
    return np.unique(np.round(np.clip(s, 0, 1), 9) + 0.0, axis=0)


def _hull(p: np.ndarray) -> np.ndarray | None:
    """Triangles (indices, seen from outside) of the convex hull of points in space; None if they lie in a plane.

    Each point outside waits at one triangle below it; the farthest of a triangle is added, and only points of the triangles that it
    replaces look for new ones.
    """
    low = int(np.lexsort(p.T)[0])
    far = int(np.argmax(((p - p[low]) ** 2).sum(axis=1)))
    line = np.linalg.norm(np.cross(p - p[low], p[far] - p[low]), axis=1)
    third = int(np.argmax(line))
    normal = np.cross(p[far] - p[low], p[third] - p[low])
    height = (p - p[low]) @ normal
    top = int(np.argmax(np.abs(height)))
    scale = float(np.abs(p - p[low]).max())
    if not scale or line[third] <= 1e-12 * scale**2 or abs(height[top]) <= 1e-12 * scale**3:
        return None
    corners = [low, far, third, top]
    inside = p[corners].mean(axis=0)
    eps = 1e-11 * scale

    def planes(triangles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c = (p[triangles[:, k]] for k in range(3))
        n = np.cross(b - a, c - a)
        n /= np.maximum(np.linalg.norm(n, axis=1), 1e-300)[:, None]
        return n, (n * a).sum(axis=1)

    tri = np.array([t for t in itertools.combinations(corners, 3)])
    n, d = planes(tri)
    tri = np.where((n @ inside - d > 0)[:, None], tri[:, ::-1], tri)
    n, d = planes(tri)
    waiting = np.setdiff1d(np.arange(len(p)), corners)
    side = p[waiting] @ n.T - d
    owner = np.where(side.max(axis=1) > eps, side.argmax(axis=1), -1)
    waiting, owner = waiting[owner >= 0], owner[owner >= 0]
    while len(waiting):
        own = waiting[owner == owner[0]]
        new = int(own[np.argmax(p[own] @ n[owner[0]] - d[owner[0]])])
        seen = p[new] @ n.T - d > eps
        seen[owner[0]] = True
        edges = np.concatenate([tri[seen][:, [0, 1]], tri[seen][:, [1, 2]], tri[seen][:, [2, 0]]])
        back = {(b, a) for a, b in edges.tolist()}
        rim = np.array([e for e in edges.tolist() if tuple(e) not in back])
        fresh = np.column_stack((rim, np.full(len(rim), new)))
        fn, fd = planes(fresh)
        freed = seen[owner] & (waiting != new)
        move = waiting[freed]
        stay = ~seen[owner]
        renumber = np.cumsum(~seen) - 1
        kept = int((~seen).sum())
        waiting, owner = waiting[stay], renumber[owner[stay]]
        if len(move):
            side = p[move] @ fn.T - fd
            out = side.max(axis=1) > eps
            waiting, owner = np.concatenate((waiting, move[out])), np.concatenate((owner, kept + side[out].argmax(axis=1)))
        tri, n, d = np.concatenate((tri[~seen], fresh)), np.concatenate((n[~seen], fn)), np.concatenate((d[~seen], fd))
    return tri


def _shadows(points: np.ndarray) -> np.ndarray:
    """The points with their shadows on the axes' planes: corners of the boxes from the origin to them."""
    masks = np.array(list(itertools.product((0.0, 1.0), repeat=3)))
    return np.unique(np.round((points[:, None, :] * masks).reshape(-1, 3), 12), axis=0) + 0.0


def hull_points(points: np.ndarray) -> np.ndarray:
    """Those of the points that the hull of all boxes from the origin to them needs."""
    p = _shadows(points)
    tri = _hull(p)
    if tri is None:
        return np.unique(points, axis=0)
    corner = p[np.unique(tri)]
    return corner[(corner > 0).any(axis=1)]


def hull_volume(points: np.ndarray) -> float:
    """Volume of the down-set of the points' convex hull; 0 where it is flat."""
    p = _shadows(points)
    tri = _hull(p)
    if tri is None:
        return 0.0
    a, b, c = (p[tri[:, k]] for k in range(3))
    return float((np.cross(b - a, c - a) * a).sum() / 6)


def facets(points: np.ndarray) -> tuple[np.ndarray, float]:
    """Facets (n, d) with n.x <= d of the down-set of the points' convex hull, and its volume (0 where it is flat)."""
    p = _shadows(points)
    tri = _hull(p)
    if tri is None:
        return np.zeros((0, 4)), 0.0
    a, b, c = (p[tri[:, k]] for k in range(3))
    n = np.cross(b - a, c - a)
    size = np.linalg.norm(n, axis=1)
    n = n[size > 1e-13] / size[size > 1e-13, None]
    planes = np.column_stack((n, (n * a[size > 1e-13]).sum(axis=1)))
    found = np.zeros((0, 4))
    for plane in np.unique(np.round(planes, 8) + 0.0, axis=0):
        if not len(found) or np.abs(found - plane).max(axis=1).min() > 1e-6:
            found = np.concatenate((found, plane[None]))
    return found, hull_volume(points)


def vus_ceiling(priors: tuple[float, float, float]) -> float:
    """Largest volume any rule reaches for class shares in rising order."""
    return facets(achievable(tuple(sorted(priors))))[1]


def pairwise_ceiling(low: Column, high: Column) -> Column:
    """Largest AUC of a class of share ``low`` against one of share ``high``."""
    return 1 - low / (2 * high)


def scalar_ceilings(priors: tuple[float, float, float]) -> dict[str, float]:
    """Largest accuracy, balanced accuracy, worst sensitivity and Youden sum."""
    pi = sorted(np.asarray(priors, float) / sum(priors))
    s = achievable(tuple(pi))
    planes, _ = facets(s)
    reach = [d / sum(n) for *n, d in planes if sum(n) > 1e-12]
    return {"accuracy": float((s @ pi).max()), "balanced_accuracy": float(s.mean(axis=1).max()), "min_sensitivity": float(min(reach)), "youden": float(s.sum(axis=1).max() - 1)}


def ceiling_report(spark: SparkSession, priors: tuple[float, float, float]) -> DataFrame:
    """All ceilings of three class shares as one row."""
    pi = sorted(float(x) / sum(priors) for x in priors)
    cells = {"vus_ceiling": vus_ceiling(tuple(pi)), **scalar_ceilings(tuple(pi))}
    for i, j in ((0, 1), (0, 2), (1, 2)):
        cells[f"auc_ceiling_{i}{j}"] = 1 - pi[i] / (2 * pi[j])
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cells.items()])


def ceiling_surface(spark: SparkSession, priors: tuple[float, float, float], resolution: int = 81) -> DataFrame:
    """Largest third sensitivity with the first two at or above (u, v), at the midpoints of a grid: i, j, z."""
    planes, _ = facets(achievable(tuple(sorted(priors))))
    i, j = (spark.range(resolution).select(F.col("id").alias(n)) for n in "ij")
    u, v = (F.col("i") + 0.5) / resolution, (F.col("j") + 0.5) / resolution
    room = [(F.lit(d) - n0 * u - n1 * v, n2) for n0, n1, n2, d in planes.tolist()]
    outside = [r < -1e-9 for r, n2 in room if abs(n2) <= 1e-9]
    z = F.greatest(F.least(*[r / n2 for r, n2 in room if n2 > 1e-9], F.lit(1.0)), F.lit(0.0))
    off = outside[0] if outside else F.lit(False)
    for c in outside[1:]:
        off = off | c
    return i.crossJoin(F.broadcast(j)).select("i", "j", F.when(off, 0.0).otherwise(z).alias("z"))


def normalised(vus: Column, ceiling: Column) -> Column:
    """Volume on a scale from chance (0) to the ceiling (1)."""
    return F.when(ceiling > CHANCE, (vus - CHANCE) / (ceiling - CHANCE))


def verdict(vus: Column, ceiling: Column, tolerance: float = 0.01) -> Column:
    """Whether a reported volume is possible at all under its ceiling."""
    return F.when(vus > ceiling + tolerance, "impossible").when(vus > ceiling - 1e-12, "suspicious").when(vus <= CHANCE, "at or below chance").otherwise("plausible")
