"""The sales line view over a star of lineitem, orders and part tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillwise.fixed_values import SALES_COLUMNS

FROM_ORDERS = {"Date", "Customer_ID"}
FROM_PART = {"Product", "Category", "Cost", "Profit"}

ROW_GROUP = 128 << 20  # bytes: what Parquet writers put into one piece by default, and one task reads a piece


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(table: DataFrame, *keys: str) -> DataFrame:
    """Deal out the rows by their unique keys where the table is too small to give every core a piece of a file.

    Without it, one file of one piece keeps a single core busy up to the first shuffle. A table with pieces for all cores is read
    where it lies. The keys fix the place of every row, so a task that is run again sends the same rows to the same place.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(cores, *keys) if size < cores * ROW_GROUP else table


def sales_lines(spark: SparkSession, folder: str, columns: Iterable[str] = SALES_COLUMNS) -> DataFrame:
    """One row per order line, with the requested sales columns.

    Every line is kept (left joins), so a table that gives none of the requested columns need
    not be joined at all: its key is unique and cannot change the rows. No join is forced to
    broadcast; Spark and AQE choose from the measured sizes, and split skewed keys.

    Money is decimal until the end of each aggregate, which makes sums exact and independent
    of the order in which partitions arrive.
    """
    wanted = [name for name in SALES_COLUMNS if name in set(columns)]
    lines = spread(read_table(spark, folder, "lineitem"), "l_orderkey", "l_linenumber")
    if FROM_ORDERS.intersection(wanted):
        orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if FROM_PART.intersection(wanted):
        parts = read_table(spark, folder, "part").select("p_partkey", "p_name", "p_type", "p_retailprice")
        lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")

    price = F.col("l_extendedprice").cast("decimal(12,2)")
    kept = (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")).cast("decimal(5,2)")
    revenue = (price * kept).cast("decimal(18,4)")
    quantity = F.col("l_quantity").cast("decimal(6,0)")
    cost = lambda: (F.col("p_retailprice").cast("decimal(11,2)") * quantity).cast("decimal(18,2)")
    made = {
        "Date": lambda: F.col("o_orderdate").cast("date"),
        "Order_ID": lambda: F.col("l_orderkey").cast("string"),
        "Customer_ID": lambda: F.col("o_custkey").cast("string"),
        "Product": lambda: F.col("p_name"),
        "Category": lambda: F.col("p_type"),
        "Revenue": lambda: revenue,
        "Cost": cost,
        "Profit": lambda: (revenue - cost()).cast("decimal(18,4)"),
        "Quantity": lambda: F.col("l_quantity").cast("long"),
    }
    return lines.select(*[made[name]().alias(name) for name in wanted])
