"""Inputs of the registered queries: the sales lines, and a raw text version of them with defects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillwise.sources.star_tables import sales_lines

COST_FACTOR = "2.05"  # makes some products lose money, so that the loss rules have something to report


def costly_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The sales lines with costs raised by COST_FACTOR."""
    lines = sales_lines(spark, folder)
    cost = (F.col("Cost") * F.lit(COST_FACTOR).cast("decimal(4,2)")).cast("decimal(18,4)")
    return lines.withColumns({"Cost": cost, "Profit": (F.col("Revenue") - cost).cast("decimal(18,4)")})


def dirty_lines(spark: SparkSession, folder: str) -> DataFrame:
    """All sales lines as raw text, with defects injected by rules on the order key.

    The rules change cells and repeat rows; no line is left out.
    """
    lines = sales_lines(spark, folder)
    key = F.col("Order_ID").cast("long")

    def every(n: int) -> Column:
        return key % n == 0

    copies = F.explode(F.when(every(50), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    money = lambda name: F.col(name).cast("decimal(14,2)").cast("string")
    null = F.lit(None).cast("string")
    return lines.withColumn("copy", copies).select(
        F.when(every(101), "bad-date")
        .when(every(103), null)
        .otherwise(F.date_format("Date", "yyyy-MM-dd"))
        .alias(" date "),
        F.col("Order_ID").alias("order id"),
        F.when(every(67), null).when(every(71), "Unknown").otherwise(F.col("Customer_ID")).alias("Customer-ID"),
        F.when(every(89), F.concat(F.lit("  "), "Product", F.lit(" ")))
        .when(every(97), "")
        .otherwise(F.col("Product"))
        .alias("PRODUCT"),
        F.col("Category"),
        F.when(every(61), null)
        .when(every(37), F.concat(F.lit("$"), money("Revenue")))
        .when(every(41), F.concat(F.lit("-"), money("Revenue")))
        .otherwise(money("Revenue"))
        .alias("Revenue"),
        F.when(every(59), null).otherwise(F.col("Cost").cast("string")).alias("Cost"),
        F.when(every(31), null).otherwise(money("Profit")).alias("Profit"),
        F.when(every(53), "n/a?").otherwise(F.col("Quantity").cast("string")).alias("Quantity"),
    )


def spelled_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The dirty lines, and those of every 50th order once more with their id spelled as a fraction."""
    lines = dirty_lines(spark, folder)
    again = lines.where(F.col("`order id`").cast("long") % 50 == 0)
    return lines.unionByName(again.withColumn("order id", F.concat("`order id`", F.lit(".0"))))


def typed_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Text columns of every type, and mixes of them, from all sales lines."""
    key = F.col("Order_ID").cast("long")
    null = F.lit(None).cast("string")
    iso = F.date_format("Date", "yyyy-MM-dd")
    return sales_lines(spark, folder).select(
        F.col("Order_ID").alias("whole"),
        F.when(key % 3 == 0, F.concat("Order_ID", F.lit(".0"))).when(key % 11 == 0, null).otherwise(F.col("Order_ID")).alias("fraction"),
        F.when(key % 2 == 0, "True").when(key % 5 == 0, null).otherwise("FALSE").alias("truth"),
        iso.alias("day"),
        F.when(key % 7 == 0, F.date_format("Date", "MM/dd/yyyy")).otherwise(iso).alias("days"),
        F.when(key % 97 == 0, "unknown").otherwise(F.col("Order_ID")).alias("mixed"),
        F.col("Product").alias("word"),
        null.alias("nothing"),
        F.col("Quantity").alias("typed"),
    )


def dated_files(spark: SparkSession, folder: str) -> DataFrame:
    """All sales lines as text with a file of six: 0 and 1 month-first, 2 and 3 day-first, 4 ISO, 5 month-first and never after the 12th."""
    lines = sales_lines(spark, folder, ["Date", "Order_ID", "Customer_ID", "Product", "Category", "Revenue", "Cost", "Quantity"])
    file = F.col("Customer_ID").cast("long") % 6
    month_first, day_first = F.date_format("Date", "MM/dd/yyyy"), F.date_format("Date", "d/M/yyyy")
    date = (
        F.when(file <= 1, month_first)
        .when(file <= 3, day_first)
        .when(file == 4, F.date_format("Date", "yyyy-MM-dd"))
        .when(F.dayofmonth("Date") <= 12, month_first)
    )
    texts = [F.col(name).cast("string").alias(name) for name in lines.columns if name != "Date"]
    return lines.select(date.alias("Date"), *texts, F.concat(F.lit("file"), file.cast("string")).alias("file"))
