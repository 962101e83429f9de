"""Rank metrics of scored samples, from counts by distinct score and running sums inside buckets of scores. Rows without a score take no part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tercet.operators.ordering import running

P = ["p0", "p1", "p2"]
FLOOR = 1e-300


def prepared(sample: DataFrame, p: list[str] = P) -> DataFrame:
    """Row-normalised log scores with a floor, and their differences; null where a score is missing."""
    total = reduce(lambda a, b: a + b, [F.col(c) for c in p])
    logs = sample.withColumns({f"l{i}": F.when(total.isNotNull(), F.ln(F.greatest(F.col(c) / total, F.lit(FLOOR)))) for i, c in enumerate(p)})
    return logs.withColumns({"d01": F.col("l0") - F.col("l1"), "d02": F.col("l0") - F.col("l2"), "d12": F.col("l1") - F.col("l2")})


def argmax3(a: Column, b: Column, c: Column) -> Column:
    """Index of the largest; ties to the lowest index."""
    return F.when((a >= b) & (a >= c), 0).when(b >= c, 1).otherwise(2)


def auc(labelled: DataFrame, score: str, positive: Column, by: list[str]) -> DataFrame:
    """Mann-Whitney AUC with half ties, by group: counts by distinct score, then a running sum."""
    counts = labelled.groupBy(*by, F.col(score).alias("__s")).agg(F.sum(positive.cast("long")).alias("pos"), F.sum((~positive).cast("long")).alias("neg"))
    held = running(counts.filter(F.col("__s").isNotNull()), "__s", ["neg"], tuple(by))
    wins = held.withColumn("wins", F.col("pos") * (F.col("neg_before") + 0.5 * F.col("neg")))
    agg = [F.sum("wins").alias("w"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")]
    out = wins.groupBy(*by).agg(*agg) if by else wins.agg(*agg)
    return out.select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("w") / F.col("n_pos") / F.col("n_neg")).alias("auc"))


def _class_counts(sample: DataFrame, p: list[str]) -> DataFrame:
    """Rows of each class at every distinct score of every class column, and below it: column, s, n0, n0_before, ..."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("column"), F.col(c).alias("s")) for i, c in enumerate(p)]))
    names = [f"n{k}" for k in range(len(p))]
    long = sample.select("y", each.alias("e")).select("y", "e.column", "e.s").filter("s is not null")
    counts = long.groupBy("column", "s").agg(*[F.sum((F.col("y") == k).cast("long")).alias(n) for k, n in enumerate(names)])
    return running(counts, "s", names, ("column",))


def _wins(positive: Column, below: Column, tied: Column) -> Column:
    return F.sum(positive * (below + 0.5 * tied))


def _auc_rows(sums: DataFrame, cells: list[tuple[dict[str, int], str]]) -> DataFrame:
    """One row a cell (its names and the prefix of its sums w, p, n) of a one-row table."""
    rows = [F.struct(*[F.lit(v).alias(k) for k, v in names.items()], F.col(f"p{at}").alias("n_pos"), F.col(f"n{at}").alias("n_neg"), F.when((F.col(f"p{at}") > 0) & (F.col(f"n{at}") > 0), F.col(f"w{at}") / F.col(f"p{at}") / F.col(f"n{at}")).alias("auc")) for names, at in cells]
    return sums.select(F.explode(F.array(*rows)).alias("e")).select("e.*").filter("n_pos is not null")


def ovr_auc(sample: DataFrame, p: list[str] = P) -> DataFrame:
    """One-vs-rest AUC of every class column."""
    held, classes, aggs, cells = _class_counts(sample, p), range(len(p)), [], []
    for i in classes:
        own = F.col("column") == i
        rest = reduce(lambda a, b: a + b, [F.col(f"n{j}") for j in classes if j != i])
        below = reduce(lambda a, b: a + b, [F.col(f"n{j}_before") for j in classes if j != i])
        aggs += [_wins(F.when(own, F.col(f"n{i}")), below, rest).alias(f"w{i}"), F.sum(F.when(own, F.col(f"n{i}"))).alias(f"p{i}"), F.sum(F.when(own, rest)).alias(f"n{i}")]
        cells.append(({"class": i}, str(i)))
    return _auc_rows(held.agg(*aggs), cells)


def ovo_auc(sample: DataFrame, p: list[str] = P) -> DataFrame:
    """A(i|j): class i's column separates i from j, for all ordered pairs."""
    held, aggs, cells = _class_counts(sample, p), [], []
    for i in range(len(p)):
        for j in range(len(p)):
            if i != j:
                own, at = F.col("column") == i, f"{i}_{j}"
                aggs += [_wins(F.when(own, F.col(f"n{i}")), F.col(f"n{j}_before"), F.col(f"n{j}")).alias(f"w{at}"), F.sum(F.when(own, F.col(f"n{i}"))).alias(f"p{at}"), F.sum(F.when(own, F.col(f"n{j}"))).alias(f"n{at}")]
                cells.append(({"i": i, "j": j}, at))
    return _auc_rows(held.agg(*aggs), cells)


def hand_till(sample: DataFrame, p: list[str] = P) -> DataFrame:
    return ovo_auc(sample, p).agg(F.avg("auc").alias("m"))


def roc_points(sample: DataFrame, score: str, positive: Column) -> DataFrame:
    """Points (fpr, tpr) at every distinct threshold, highest first."""
    counts = sample.groupBy(F.col(score).alias("threshold")).agg(F.sum(positive.cast("long")).alias("pos"), F.sum((~positive).cast("long")).alias("neg"))
    placed = running(counts, "threshold", ["pos", "neg"], descending=True)
    every = counts.agg(F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return placed.select("threshold", (F.col("pos_before") + F.col("pos")).alias("tp"), (F.col("neg_before") + F.col("neg")).alias("fp")).crossJoin(F.broadcast(every)).select("threshold", (F.col("fp") / F.col("nn")).alias("fpr"), (F.col("tp") / F.col("np")).alias("tpr"))


def roc_curve(sample: DataFrame, score: str, positive: Column) -> DataFrame:
    """The curve's points with its origin: fpr, tpr."""
    points = roc_points(sample, score, positive).select("fpr", "tpr")
    return points.unionByName(sample.sparkSession.range(1).select(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))


def confusion(sample: DataFrame, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), p: list[str] = P) -> DataFrame:
    pred = argmax3(*[F.col(c) * w for c, w in zip(p, weights, strict=True)])
    return sample.groupBy("y", pred.alias("pred")).count().withColumnRenamed("count", "n")


def confusion_report(cm: DataFrame) -> DataFrame:
    """Support, sensitivity, precision and F1 by class of a nine-cell table."""
    diag = F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0))
    row = cm.groupBy(F.col("y").alias("class")).agg(F.sum("n").alias("support"), diag.alias("hit"))
    col = cm.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("predicted"))
    both = row.join(col, "class", "left").withColumn("predicted", F.coalesce("predicted", F.lit(0)))
    sens, prec = F.col("hit") / F.col("support"), F.when(F.col("predicted") > 0, F.col("hit") / F.col("predicted")).otherwise(0.0)
    return both.select("class", "support", sens.alias("sensitivity"), prec.alias("precision"), F.when(sens + prec > 0, 2 * sens * prec / (sens + prec)).otherwise(0.0).alias("f1"))


def confusion_summary(report: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy and macro F1 of a report by class."""
    return report.agg((F.sum(F.col("sensitivity") * F.col("support")) / F.sum("support")).alias("accuracy"), F.avg("sensitivity").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"))


def vus_ordinal(sample: DataFrame, marker: str, first: int, middle: int, last: int, direction: str = "increasing") -> DataFrame:
    """P(marker rises over the three classes, or falls if decreasing), half credit for ties, from counts by distinct marker."""
    if direction not in ("increasing", "decreasing"):
        raise ValueError("the direction is increasing or decreasing")
    if direction == "decreasing":
        first, last = last, first
    counts = sample.groupBy(F.col(marker).alias("s")).agg(*[F.sum((F.col("y") == c).cast("long")).alias(n) for c, n in ((first, "a"), (middle, "b"), (last, "c"))])
    every = counts.filter("s is not null").agg(*[F.sum(n).alias(f"n{n}") for n in "abc"])
    placed = running(counts.filter("s is not null"), "s", ["a", "c"])
    held = placed.withColumns({"below": F.col("a_before"), "upto": F.col("c_before") + F.col("c")}).crossJoin(F.broadcast(every))
    left = F.col("below") + 0.5 * F.col("a")
    right = (F.col("nc") - F.col("upto")) + 0.5 * F.col("c")
    return held.agg((F.sum(F.col("b") * left * right) / F.first("na") / F.first("nb") / F.first("nc")).alias("vus"))


#: The six assignments of a trio's rows to the classes.
PERMS = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]


def _nine(c: Column) -> Column:
    """Nine decimals. ``round`` would make a decimal of every sum, which is most of the work on trios."""
    return F.rint(c * 1e9) / 1e9


def sampled_trios(sample: DataFrame, repeats: int = 8, per_class: int = 2, seed: int = 17, p: list[str] = P) -> DataFrame:
    """A seeded random sample of trios (one row per class) of all rows: the six score sums, with the part they were drawn in.

    In each repeat a hash deals every row to one of many parts, so that about ``per_class`` rows of a class
    share a part, and the trios of a part are taken. All trios are equally likely; the work is linear in
    the rows, and no class is broadcast or multiplied with another.
    """
    logs = prepared(sample, p)
    parts = max(1, logs.count() // (3 * per_class))
    dealt = logs.select("y", "row_id", "l0", "l1", "l2", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat")).withColumn("part", F.pmod(F.xxhash64("row_id", "repeat", F.lit(seed)), F.lit(parts)))
    x, y, z = (dealt.filter(F.col("y") == c).select("repeat", "part", *[F.col(f"l{k}").alias(f"{n}{k}") for k in range(3)]) for c, n in ((0, "x"), (1, "y"), (2, "z")))
    trios = x.join(y, ["repeat", "part"]).join(z, ["repeat", "part"])
    return trios.select("repeat", "part", *[_nine(F.col(f"x{a}") + F.col(f"y{b}") + F.col(f"z{c}")).alias(f"s{a}{b}{c}") for a, b, c in PERMS])


def every_trio(sample: DataFrame, p: list[str] = P) -> DataFrame:
    """All trios of a small fixture, in the form of :func:`sampled_trios`; each is a part of its own."""
    logs = prepared(sample, p)
    x, y, z = (logs.filter(F.col("y") == c).select(*[F.col(f"l{k}").alias(f"{n}{k}") for k in range(3)]) for c, n in ((0, "x"), (1, "y"), (2, "z")))
    trios = x.crossJoin(y).crossJoin(z).withColumns({"repeat": F.lit(1), "part": F.monotonically_increasing_id()})
    return trios.select("repeat", "part", *[_nine(F.col(f"x{a}") + F.col(f"y{b}") + F.col(f"z{c}")).alias(f"s{a}{b}{c}") for a, b, c in PERMS])


def _with_error(trios: DataFrame, hits: dict[str, Column]) -> DataFrame:
    """Means of ``hits`` over the trios with the error of a ratio of sums by part: name, prob, se, n_trios."""
    by_part = trios.groupBy("repeat", "part").agg(F.count("*").alias("k"), *[F.sum(hit).alias(name) for name, hit in hits.items()])
    sums = [F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("kk"), F.count("*").alias("parts")]
    for name in hits:
        sums += [F.sum(name).alias(f"h_{name}"), F.sum(F.col(name) * F.col(name)).alias(f"hh_{name}"), F.sum(F.col("k") * F.col(name)).alias(f"kh_{name}")]
    total = by_part.agg(*sums)
    rows = []
    for name in hits:
        mean = F.col(f"h_{name}") / F.col("n")
        rest = F.greatest(F.col(f"hh_{name}") - 2 * mean * F.col(f"kh_{name}") + mean * mean * F.col("kk"), F.lit(0.0))
        rows.append(F.struct(F.lit(name).alias("name"), mean.alias("prob"), (F.sqrt(rest * F.col("parts") / (F.col("parts") - 1)) / F.col("n")).alias("se"), F.col("n").alias("n_trios")))
    return total.select(F.explode(F.array(*rows)).alias("e")).select("e.*")


def trio_profile(trios: DataFrame) -> DataFrame:
    """Probability that each assignment of a trio has the largest score sum (ties share), with its sampling error: perm, prob, se, n_trios."""
    names = [f"s{a}{b}{c}" for a, b, c in PERMS]
    best = F.greatest(*names)
    ties = reduce(lambda u, v: u + v, [(F.col(n) == best).cast("int") for n in names])
    return _with_error(trios, {n[1:]: (F.col(n) == best).cast("int") / ties for n in names}).withColumnRenamed("name", "perm")


def vus_with_error(trios: DataFrame) -> DataFrame:
    """Share of trios classified right by strict inequalities, with its sampling error: vus, se, n_trios."""
    right, *others = [f"s{a}{b}{c}" for a, b, c in PERMS]
    return _with_error(trios, {"vus": (F.col(right) > F.greatest(*others)).cast("double")}).select(F.col("prob").alias("vus"), "se", "n_trios")


def order_check(sample: DataFrame, p: list[str] = P) -> DataFrame:
    """Share of rows whose scores rise over the classes, and the worst margin with its row."""
    margin = F.least(F.col(p[1]) - F.col(p[0]), F.col(p[2]) - F.col(p[1]))
    return sample.select("row_id", margin.alias("margin")).agg(F.avg((F.col("margin") > 0).cast("double")).alias("share_ordered"), F.min("margin").alias("worst_margin"), F.min(F.struct("margin", "row_id")).alias("w")).select("share_ordered", "worst_margin", F.col("w.row_id").alias("worst_row"))


def gauge_normalized(sample: DataFrame, p: list[str] = P) -> DataFrame:
    """Columns divided by their geometric means, rows renormalised."""
    means = sample.agg(*[F.exp(F.avg(F.ln(F.greatest(F.col(c), F.lit(FLOOR))))).alias(f"g{i}") for i, c in enumerate(p)])
    raw = sample.crossJoin(F.broadcast(means)).withColumns({f"r{i}": F.col(c) / F.col(f"g{i}") for i, c in enumerate(p)})
    total = F.col("r0") + F.col("r1") + F.col("r2")
    return raw.select("row_id", "y", *[(F.col(f"r{i}") / total).alias(f"q{i}") for i in range(3)])


def isotonic_decreasing3(v: list[Column]) -> list[Column]:
    """Least-squares projection of three values onto non-increasing order (max-min form)."""
    a, b, c = v
    ab, bc, abc = (a + b) / 2, (b + c) / 2, (a + b + c) / 3
    first = F.greatest(a, ab, abc)
    second = F.least(F.greatest(ab, abc), F.greatest(b, bc))
    last = F.least(c, bc, abc)
    return [first, second, last]
