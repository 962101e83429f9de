"""Steps that keep passes from growing with the lines: a written frame, counted rows, cheap rounding."""

import pytest
from pyspark.sql import functions as F

from tercet.operators import fitting as fi
from tercet.operators import ranking as ra
from tercet.plans import decisions as de

SMALL = "/root/testdata/sf0.001"


def test_passes_read_the_written_frame(spark):
    for held in (de.frame(spark, SMALL), de.offers_of(spark, SMALL)):
        assert not any("lineitem" in f for f in held.inputFiles())


def test_equal_rows_are_counted(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 0), (2.0, 1), (None, 1), (float("nan"), 0)], "x double, y int")
    rows, _ = fi.fit_rows(df, [F.col("x"), F.col("y")], counted=True)
    assert sorted(tuple(r) for r in rows.collect()) == [(1.0, 0.0, 2.0), (2.0, 1.0, 1.0)]


def test_nine_decimals(spark):
    df = spark.createDataFrame([(0.1234567894,), (-1.9999999996,), (-41.446531673892822,)], "x double")
    got = df.select(ra._nine(F.col("x")).alias("a"), F.round("x", 9).alias("b")).collect()
    assert all(r.a == pytest.approx(r.b, abs=1e-15) for r in got)
