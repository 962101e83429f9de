"""The letter models of ``charmodel`` as Spark tables, for more grams than a broadcast should hold.

Each order is two tables: the share of every gram and the weight left to the order below by every context,
as maps from a language's number to a value. The probabilities of any set of distinct grams are found by
joins, from single symbols up to four. Documents first meet the most frequent grams inside tasks; what is
left of a document, its distinct other grams with their counts, is joined with those grams' probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tercet.llm.charmodel import BITS, ORDER, Sorted, grams
from tercet.llm.common import release_memory, written
from tercet.llm.textkernel import blocks, mix


def _ending(order: int) -> Column:
    """The last symbols of a gram."""
    return F.col("gram") if order == ORDER else F.col("gram").bitwiseAND(F.lit((1 << (BITS * order)) - 1).cast("long"))


def _context() -> Column:
    return F.shiftrightunsigned("gram", BITS)


class Tables:
    """Models of ``rows(lang, gram, n)`` of distinct four-symbol grams; names and discounts alone (a row a language) reach the driver."""

    def __init__(self, rows: DataFrame):
        self.names = sorted(r.lang for r in rows.select("lang").distinct().collect())
        number = F.create_map(*[F.lit(x) for pair in ((k, i) for i, k in enumerate(self.names)) for x in pair]) if self.names else None
        self.kinds = rows.select(F.col("gram").bitwiseAND(F.lit((1 << BITS) - 1))).distinct().count() + 1
        counts = rows.select((number[F.col("lang")] if self.names else F.lit(0)).alias("at"), "gram", "n")
        self.counts, self.orders = written(counts, "model-counts"), []
        counts = self.counts
        for order in range(ORDER, 0, -1):
            seen = counts.groupBy("at").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect()
            discounts = {r["at"]: r.once / (r.once + 2 * r.twice) if r.once and r.twice else 0.5 for r in seen}
            discount = F.create_map(*[F.lit(x) for pair in discounts.items() for x in pair])[F.col("at")] if discounts else F.lit(0.5)
            contexts = counts.groupBy("at", _context().alias("context")).agg(F.sum("n").alias("total"), (discount * F.count("*") / F.sum("n")).alias("left"))
            shares = counts.withColumn("context", _context()).join(contexts, ["at", "context"]).select("at", "gram", ((F.col("n") - discount) / F.col("total")).alias("share"))
            self.orders.append((order, written(_mapped(shares, "gram", "share"), "shares"), written(_mapped(contexts, "context", "left"), "contexts")))
            if order > 1:  # lower orders count the distinct grams that they end
                counts = written(counts.groupBy("at", _ending(order - 1).alias("gram")).agg(F.count("*").alias("n")), "lower-counts")
        self.orders.reverse()

    def logs(self, needed: DataFrame) -> DataFrame:
        """``gram`` and its ``logs``, log2 probabilities in the order of names, of the distinct grams of ``needed``."""
        below = None
        for order, shares, contexts in self.orders:
            own = needed.select(_ending(order).alias("gram")).distinct() if order < ORDER else needed.select("gram")
            own = own.join(shares, "gram", "left").withColumn("context", _context()).join(contexts, "context", "left").drop("context")
            if below is None:
                own = own.withColumn("below", F.array_repeat(F.lit(1 / self.kinds), len(self.names)))
            else:
                own = own.withColumn("ending", _ending(order - 1)).join(below.select(F.col("gram").alias("ending"), F.col("p").alias("below")), "ending")
            p = F.transform("below", lambda b, i: F.coalesce(F.col("share")[i], F.lit(0.0)) + F.coalesce(F.col("left")[i], F.lit(1.0)) * b)
            below = own.select("gram", p.alias("p"))
        return below.select("gram", F.transform("p", lambda v: F.log2(v).cast("float").cast("double")).alias("logs"))

    def frequent(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``most`` most frequent grams at most, of all that a count has, and their logs."""
        by_gram = self.counts.groupBy("gram").agg(F.sum("n").alias("n"))
        sizes = by_gram.groupBy("n").count().orderBy(F.col("n").desc()).toArrow()  # one row a distinct count
        keep = int(np.searchsorted(np.cumsum(sizes.column("count").to_numpy()), most, "right"))
        if not keep:
            return np.zeros(0, np.uint64), np.zeros((0, len(self.names)))
        got = self.logs(by_gram.filter(F.col("n") >= sizes.column("n")[keep - 1].as_py())).toArrow()
        logs = got.column("logs").combine_chunks().flatten().to_numpy().reshape(got.num_rows, len(self.names))
        return got.column("gram").to_numpy().view(np.uint64), logs


def _mapped(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", value))).alias(value))


def entropies(docs: DataFrame, model: Tables, most: int = 0) -> DataFrame:
    """``docs`` (whose column ``text`` goes) with ``symbols``, how many symbols each has, and ``bits`` a symbol under each language (null: no symbol)."""
    keys, logs = model.frequent(most) if most else (np.zeros(0, np.uint64), np.zeros((0, len(model.names))))
    shared, kept = docs.sparkSession.sparkContext.broadcast((keys, logs.astype(np.float32))), [c for c in docs.columns if c != "text"]
    wide = len(model.names)
    fields = [docs.schema[c] for c in kept]
    schema = StructType([*fields, StructField("row", LongType()), StructField("symbols", LongType()), StructField("sums", ArrayType(DoubleType())), StructField("gram", LongType()), StructField("n", LongType())])

    def meet(batches):
        from pyspark import TaskContext

        keys, logs = shared.value
        found = Sorted(keys)
        logs, at = logs[found.order], TaskContext.get().partitionId() << 33
        for batch in batches:
            for low, high, data, off in blocks(batch.column("text")):
                got, per_doc = grams(data, off)
                n, place = len(per_doc), found.find(mix(got.copy()))
                doc, met = np.repeat(np.arange(n), per_doc), place >= 0
                sums = [np.bincount(doc[met], weights=logs[place[met], k], minlength=n).astype(np.float64) for k in range(wide)]
                sums = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * wide, np.stack(sums, axis=1).ravel() if wide else np.zeros(0))
                row = np.arange(at, at + n)
                own = [batch.column(c).slice(low, n) for c in kept]
                yield pa.RecordBatch.from_arrays([*own, pa.array(row), pa.array(per_doc.astype(np.int64)), sums, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=schema.names)
                rest, doc = got[~met], doc[~met]
                order = np.lexsort((rest, doc))
                rest, doc = rest[order], doc[order]
                first = np.flatnonzero(np.r_[True, (rest[1:] != rest[:-1]) | (doc[1:] != doc[:-1])]) if len(rest) else np.zeros(0, np.int64)
                m, counts = len(first), np.diff(np.append(first, len(rest)))
                yield pa.RecordBatch.from_arrays([*(pa.nulls(m, c.type) for c in own), pa.array(row[doc[first]]), pa.nulls(m, pa.int64()), pa.nulls(m, sums.type), pa.array(rest[first].view(np.int64)), pa.array(counts.astype(np.int64))], names=schema.names)
                at += n
        release_memory()

    parts = written(docs.mapInArrow(meet, schema), "met")
    left = parts.filter("gram is not null").select("row", "gram", "n")
    chances = model.logs(left.select("gram").distinct())
    other = left.join(chances, "gram").groupBy("row").agg(F.array(*[F.sum(F.col("n") * F.col("logs")[k]) for k in range(wide)]).alias("other"))
    whole = parts.filter("symbols is not null").join(other, "row", "left")
    bits = F.transform("sums", lambda v, k: -(v + F.coalesce(F.col("other")[k], F.lit(0.0))) / F.col("symbols"))
    return whole.select(*kept, "symbols", F.when(F.col("symbols") > 0, bits).alias("bits"))
