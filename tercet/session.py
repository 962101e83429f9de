"""Session helpers: shipping this library to the executors, and tables that cut lineage in the folder all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship_library(spark: SparkSession) -> None:
    """Add the package to the context once, so that Python workers can import it anywhere."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tercet-ship-")) / "tercet_library.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def step_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``. Only a session in one process may be without that setting."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="tercet-")
        spark.conf.set("spark.checkpoint.dir", place)
    return f"{place.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written_step(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written and read again, and where it lies."""
    spark, path = df.sparkSession, step_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.parquet(path), path


def dropped_step(spark: SparkSession, path: str) -> None:
    """Delete a written step that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
