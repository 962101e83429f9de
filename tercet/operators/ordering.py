"""Exact running sums, ranks and quantiles of a whole table without a window over all of it.

Values are cut into order-preserving buckets at approximate quantiles, so that any task orders one bucket only. The edges are one
row that meets the counts inside the same job (nothing reaches the driver), and bucket totals, at most COARSE rows a group, give what
lies before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets; a power of two.
COARSE = 512


def bucketed(counts: DataFrame, value: str, name: str = "__b") -> DataFrame:
    """``counts`` with a bucket from 0 to COARSE - 1 that never falls as ``value`` rises; a null is in the first.

    The bucket is found by halving, one projection a step, so that the code of a step never contains the last one twice.
    """
    v = F.col(value).cast("double")
    shares = F.expr(f"array({', '.join(f'{k / COARSE!r}D' for k in range(1, COARSE))})")  # one text: building it column by column takes seconds
    edges = counts.agg(F.percentile_approx(v, shares, F.lit(4 * COARSE)).alias("__e"))
    held = counts.crossJoin(F.broadcast(edges)).withColumn(name, F.lit(0))  # one row of COARSE - 1 numbers
    step = COARSE // 2
    while step:
        held = held.withColumn(name, F.col(name) + F.when(F.col("__e").isNotNull() & (v >= F.get("__e", F.col(name) + (step - 1))), step).otherwise(0))
        step //= 2
    return held.drop("__e")


def running(counts: DataFrame, value: str, sums: list[str], by: tuple[str, ...] = (), descending: bool = False) -> DataFrame:
    """``counts`` (one row a group and value) with ``<sum>_before``: the sums over all smaller (or larger) values of the group."""
    held = bucketed(counts, value)
    side = (lambda c: F.col(c).desc()) if descending else F.col
    totals = held.groupBy(*by, "__b").agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    earlier = (Window.partitionBy(*by) if by else Window).orderBy(side("__b")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__b").alias("__ob"), *[F.coalesce(F.sum(f"__t_{s}").over(earlier), F.lit(0)).alias(f"__o_{s}") for s in sums])
    inside = Window.partitionBy(*by, "__b").orderBy(side(value)).rowsBetween(Window.unboundedPreceding, -1)
    met = F.col("__b") == F.col("__ob")
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    placed = held.join(offsets, met).drop("__ob", *[f"__by_{c}" for c in by])
    return placed.withColumns({f"{s}_before": F.col(f"__o_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums}).drop("__b", *[f"__o_{s}" for s in sums])


def average_ranks(frame: DataFrame, value: str) -> DataFrame:
    """One row a distinct value: (value, average rank from 1, n); nulls take no part."""
    counts = frame.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return running(counts, value, ["n"]).select(value, (F.col("n_before") + (F.col("n") + 1) / 2).alias("rank"), "n")


def quantiles(frame: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row with the array ``q`` of exact quantiles, linear between neighbours; nulls take no part."""
    held = frame.select(value).filter(F.col(value).isNotNull())
    counts = held.groupBy(value).agg(F.count("*").alias("n"))
    last = counts.agg((F.sum("n") - 1).alias("last"))
    placed = running(counts, value, ["n"]).crossJoin(F.broadcast(last))
    places = F.array(*[F.lit(float(s)) for s in shares])
    # a value meets the few places that lie in its rows; each share gets its lower and its upper neighbour
    met = placed.select(F.col(value).cast("double").alias("v"), "last", "n_before", (F.col("n_before") + F.col("n")).alias("upto"), F.posexplode(places).alias("k", "s"))
    at = F.col("last") * F.col("s")
    inside = [(p >= F.col("n_before")) & (p < F.col("upto")) for p in (F.floor(at), F.ceil(at))]
    ends = met.filter(inside[0] | inside[1]).groupBy("k").agg(F.max(F.when(inside[0], F.col("v"))).alias("low"), F.max(F.when(inside[1], F.col("v"))).alias("high"), F.first(at - F.floor(at)).alias("part"))
    found = ends.agg(F.sort_array(F.collect_list(F.struct("k", (F.col("low") + F.col("part") * (F.col("high") - F.col("low"))).alias("q")))).alias("a"))
    return found.select(F.when(F.size("a") == len(shares), F.col("a.q")).otherwise(F.array_repeat(F.lit(None).cast("double"), len(shares))).alias("q"))


def spearman(frame: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of the average ranks of two columns: one row (n, spearman)."""
    both = frame.select(x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = both.groupBy(x, y).agg(F.count("*").alias("k"))
    rx = average_ranks(both, x).select(x, F.col("rank").alias("__rx"))
    ry = average_ranks(both, y).select(y, F.col("rank").alias("__ry"))
    k, a, b = F.col("k"), F.col("__rx"), F.col("__ry")
    centre = (both.agg(((F.count("*") + 1) / 2).alias("__c"))).select("__c")
    r = pairs.join(rx, x).join(ry, y).crossJoin(F.broadcast(centre)).withColumns({"__rx": a - F.col("__c"), "__ry": b - F.col("__c")})
    s = r.agg(F.sum(k).alias("n"), F.sum(k * a * b).alias("ab"), F.sum(k * a * a).alias("aa"), F.sum(k * b * b).alias("bb"))
    return s.select("n", (F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("spearman"))


def _number(df: DataFrame, value: str) -> Column:
    """A number that rises with the column: dates and times by their seconds, texts by their first six bytes."""
    kind = dict(df.dtypes)[value]
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.col(value).cast("timestamp").cast("double")
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.col(value).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.col(value).cast("double")


def placed_by_key(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``place``: its place from 0 by the key. Rows whose keys are one number are ranked together."""
    number = df.withColumn("__k", _number(df, key))
    before = running(number.groupBy("__k").agg(F.count("*").alias("__n")), "__k", ["__n"]).select(F.col("__k").alias("__of"), "__n_before")
    tied = F.row_number().over(Window.partitionBy("__k").orderBy(key)) - 1
    return number.join(before, F.col("__k").eqNullSafe(F.col("__of"))).withColumn("place", F.col("__n_before") + tied).drop("__k", "__of", "__n_before")


def placed_in_order(df: DataFrame, value: str, key: str) -> DataFrame:
    """``df`` with ``place``: its place from 0 by (value, key).

    Rows of one value are ranked in buckets of their keys, so that a value that many rows share is no single task's.
    """
    number = df.withColumns({"__v": _number(df, value), "__k": _number(df, key)})
    counts = number.groupBy("__v").agg(F.count("*").alias("__n"))
    before = running(counts, "__v", ["__n"]).select(F.col("__v").alias("__of"), "__n_before")
    inside = number.groupBy("__v", "__k").agg(F.count("*").alias("__m"))
    within = running(inside, "__k", ["__m"], ("__v",)).select(F.col("__v").alias("__v2"), F.col("__k").alias("__k2"), "__m_before")
    tied = F.row_number().over(Window.partitionBy("__v", "__k").orderBy(key)) - 1
    joined = number.join(before, number["__v"].eqNullSafe(F.col("__of"))).join(within, F.col("__v").eqNullSafe(F.col("__v2")) & F.col("__k").eqNullSafe(F.col("__k2")))
    return joined.withColumn("place", F.col("__n_before") + F.col("__m_before") + tied).drop("__v", "__k", "__of", "__n_before", "__v2", "__k2", "__m_before")
