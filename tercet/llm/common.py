"""Shared helpers of the ``llm`` operators: shared folder, written tables, distributed numbering.

Everything that must outlive a lost executor is written as a table to the folder named by
``spark.checkpoint.dir``; nothing is kept in machine-local folders.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tercet.session import ship_library

#: Rows per Arrow batch: documents can be long, and a batch must fit a small Python worker.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_library(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    ship_library(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def release_memory() -> None:
    """Give what a task has freed back to the system: workers outlive their tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. A temporary one is made only where all runs in one process (tests); elsewhere none is an error."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="tercet-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Rows that a file of a small intermediate table holds, at least.
ROWS_PER_FILE = 100_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder once and read it back.

    With its number of ``rows``, a small table goes to few files.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(2, min(partitions(spark), rows // ROWS_PER_FILE)))
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tercet_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by :func:`written` when nothing lazy refers to it any more."""
    path = getattr(df, "_tercet_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sorted_positions(df: DataFrame, order: list[Column], name: str, parts: int | None = None) -> tuple[DataFrame, dict[int, int]]:
    """Number the rows in one global order without a single-task window.

    Rows are range-partitioned by ``order`` (which should end in a tie-break, so that one hot
    value spreads over partitions), sorted inside each partition and numbered there. Returns the
    written table with ``_pid`` and ``_row`` (from 0 inside the partition) and the number of rows
    before each partition: one entry per partition, never per row.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(parts or partitions(spark), *order).sortWithinPartitions(*order)
    schema = StructType([*ranged.schema.fields, StructField("_pid", IntegerType(), False), StructField("_row", LongType(), False)])

    def number(batches):
        from pyspark import TaskContext

        pid, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, pid, np.int32)), pa.array(np.arange(at, at + n, dtype=np.int64))],
                names=[*batch.schema.names, "_pid", "_row"],
            )
            at += n

    out = written(ranged.mapInArrow(number, schema), name)
    counts = dict(out.groupBy("_pid").count().collect())
    before, total = {}, 0
    for pid in sorted(counts):
        before[pid] = total
        total += counts[pid]
    return out, before


def looked_up(values: dict[int, int], key: Column) -> Column:
    """A literal map from partition to a number, as a column."""
    if not values:
        return F.lit(0).cast("long")
    return F.element_at(F.map_from_arrays(F.array(*[F.lit(int(k)) for k in values]), F.array(*[F.lit(int(v)).cast("long") for v in values.values()])), key)
