"""Readers and domain views over the warehouse tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Price multipliers and allocation of the randomised price test; arm 0 is the cheapest.
MULTIPLIERS = (0.9, 1.0, 1.1)
ARM_PROBABILITY = 1.0 / 3.0
#: Allocation of the H/C/L experiment, dearest arm first.
PROPENSITIES = {"H": 0.2, "C": 0.6, "L": 0.2}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_by_suffix(spark: SparkSession, path: str, schema: str | None = None, kind: str | None = None) -> DataFrame:
    """A prediction or experiment table by its suffix, or as the ``kind`` given: parquet, or csv with a header."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv" or path.endswith((".csv", ".csv.gz")):
        return reader.option("header", True).csv(path)
    if kind == "parquet" or path.endswith(".parquet"):
        return reader.parquet(path)
    raise ValueError(f"unknown file type: {path}")


def normalised_headers(df: DataFrame) -> DataFrame:
    """All columns as strings, their names without blanks."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c.replace(" ", "")) for c in df.columns])


def write_report(df: DataFrame, path: str) -> None:
    """A report table as csv files with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_history(df: DataFrame, path: str) -> None:
    """A trial history as parquet."""
    df.write.mode("overwrite").parquet(path)


def cached_table(spark: SparkSession, path: str, params: dict[str, object], build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` gives, kept as parquet under ``path`` by its parameters and read again when it is there."""
    place = "/".join([path.rstrip("/"), *(f"{k}={params[k]}" for k in sorted(params))])
    try:
        return spark.read.parquet(place)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    build().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retail lines: invoice, stock_code, description, quantity, ts, price, customer."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_name")
    return lines.join(orders, "l_orderkey").join(parts, "l_partkey").select(
        F.col("l_orderkey").cast("string").alias("invoice"),
        F.col("p_brand").alias("stock_code"),
        F.col("p_name").alias("description"),
        F.col("l_quantity").cast("long").alias("quantity"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("o_custkey").alias("customer"),
        "l_linenumber",
    )


def wtp() -> Column:
    return F.col("l_extendedprice") / F.col("l_quantity")


def price_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A randomised three-arm price test: row_id, cluster, arm, m, bought, score, gain, posterior p0..p2."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice", "p_brand")
    arm = ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3 + F.col("l_partkey")) % 3).cast("int")
    m = F.when(arm == 0, 0.9).when(arm == 1, 1.0).otherwise(1.1)
    q = F.col("l_quantity")
    # a smooth, monotone stand-in for a model's arm posterior among buyers
    w0, w1, w2 = F.lit(1.0) + q / 50, F.lit(1.0), F.lit(1.0) / (F.lit(1.0) + q / 50)
    total = w0 + w1 + w2
    return lines.join(parts, "l_partkey").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        F.col("l_suppkey").alias("cluster"),
        "p_brand",
        arm.alias("arm"),
        m.alias("m"),
        (wtp() >= F.col("p_retailprice") * m).cast("int").alias("bought"),
        q.alias("score"),
        (F.col("l_discount") * 10).alias("gain"),
        (w0 / total).alias("p0"),
        (w1 / total).alias("p1"),
        (w2 / total).alias("p2"),
    )


def scored_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A three-class scored sample: row_id, y (0, 1, 2), marker, p0, p1, p2."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    s = F.log(wtp() / F.col("p_retailprice"))
    base = lines.join(parts, "l_partkey").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        F.when(F.col("l_quantity") <= 16, 2).when(F.col("l_quantity") <= 33, 1).otherwise(0).alias("y"),
        F.round(s, 4).alias("marker"),
    )
    raw = [F.exp(-F.pow(F.col("marker") - c, 2)) for c in (0.0, 0.5, 1.5)]
    total = raw[0] + raw[1] + raw[2]
    return base.select("*", *[(r / total).alias(f"p{i}") for i, r in enumerate(raw)])


def experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The H/C/L experiment: identifiers, arm, purchase, propensities and contributions."""
    orders = table(spark, sf_dir, "orders")
    arm = F.when(F.col("o_orderpriority") == "1-URGENT", "H").when(F.col("o_orderpriority") == "5-LOW", "L").otherwise("C")
    v = F.col("o_totalprice") / 1000
    return orders.select(
        F.col("o_orderkey").alias("quote_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("quote_timestamp"),
        F.lit(1).alias("eligible"),
        arm.alias("arm"),
        (F.col("o_orderstatus") != "P").cast("int").alias("purchase"),
        *[F.lit(p).alias(f"pi_{a}") for a, p in PROPENSITIES.items()],
        F.col("o_totalprice").alias("base_premium"),
        F.when(arm == "H", 1.1).when(arm == "C", 1.0).otherwise(0.9).alias("assigned_multiplier"),
        (F.col("o_totalprice") * F.when(arm == "H", 1.1).when(arm == "C", 1.0).otherwise(0.9)).alias("displayed_premium"),
        (v * 1.1).alias("contribution_H"),
        v.alias("contribution_C"),
        (v * 0.9).alias("contribution_L"),
        (F.ln(v + 1) / 10).alias("risk"),
    )
