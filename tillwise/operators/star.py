"""Star schema over the sales lines, and its measures.

The measures follow rules of their own: profit is revenue minus cost, a division by zero
gives 0, and orders are counted with unknown ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillwise.functions.numbers import ratio, total
from tillwise.functions.periods import month_label, month_start
from tillwise.sources.staging import in_parts


def product_key() -> Column:
    """Key made from name and category, so facts get it without a join and every run gives the same one.

    The length stands before each part, so no two pairs make the same text.
    """
    part = lambda name: F.coalesce(F.concat(F.length(name).cast("string"), F.lit("="), F.col(name)), F.lit("-"))
    return F.md5(F.concat(part("Product"), F.lit("|"), part("Category"))).alias("Product_ID")


def dim_products(sales: DataFrame) -> DataFrame:
    distinct = sales.select("Product", "Category").distinct()
    return distinct.select(product_key(), F.col("Product").alias("Product_Name"), "Category")


def dim_customers(sales: DataFrame) -> DataFrame:
    return sales.select("Customer_ID").distinct()


def dim_calendar(sales: DataFrame) -> DataFrame:
    """Every day between the first and the last sale."""
    ends = sales.agg(F.min("Date").alias("first"), F.max("Date").alias("last"))
    days = ends.select(F.explode(F.sequence("first", "last")).alias("Date"))
    return days.select(
        "Date",
        F.year("Date").alias("Year"),
        F.quarter("Date").alias("Quarter"),
        F.month("Date").alias("Month"),
        F.date_format("Date", "MMMM").alias("Month_Name"),
        F.date_format("Date", "EEEE").alias("Day_of_Week"),
    )


def fact_sales(sales: DataFrame) -> DataFrame:
    return sales.select(
        "Order_ID", "Date", "Customer_ID", product_key(), "Revenue", "Cost", "Profit", "Quantity"
    )


def star_measures(facts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Total revenue, cost, profit, margin share, orders and average order value, in total or per group.

    Lines are combined per order first, so the distinct count is a count of rows. Tasks deal with parts of the orders whose
    size does not grow with the table.
    """
    keys = by or []
    revenue, cost = total(F.col("revenue")), total(F.col("cost"))
    orders = F.count("*")
    zero = F.lit(0.0)
    per_order = in_parts(facts, *keys, "Order_ID").groupBy(*keys, "Order_ID").agg(F.sum("Revenue").alias("revenue"), F.sum("Cost").alias("cost"))
    return per_order.groupBy(*keys).agg(
        revenue.cast("double").alias("total_revenue"),
        cost.cast("double").alias("total_cost"),
        (revenue - cost).cast("double").alias("total_profit"),
        F.coalesce(ratio(revenue - cost, revenue), zero).alias("profit_margin"),
        orders.alias("total_orders"),
        F.coalesce(ratio(revenue, orders), zero).alias("average_order_value"),
    )


def mom_growth(sales: DataFrame) -> DataFrame:
    """Revenue per calendar month against the calendar month before; 0 without a base.

    Months without sales between the first and the last one have rows, too.
    """
    in_order = Window.orderBy("start")
    sums = (
        sales.where(F.col("Date").isNotNull())
        .groupBy(month_start(F.col("Date")).alias("start"))
        .agg(total(F.col("Revenue")).cast("double").alias("revenue"))
    )
    until = F.coalesce(F.add_months(F.lead("start").over(in_order), -1), "start")
    spread = sums.withColumn("until", until).select(
        F.col("start").alias("sold"),
        "revenue",
        F.explode(F.sequence("start", "until", F.expr("interval 1 month"))).alias("start"),
    )
    months = spread.select("start", F.when(F.col("start") == F.col("sold"), F.col("revenue")).alias("revenue"))
    prior = F.lag("revenue").over(in_order)
    change = F.coalesce("revenue", F.lit(0.0)) - prior
    return months.select(
        month_label(F.col("start")).alias("Month"),
        "revenue",
        prior.alias("prior_month_revenue"),
        F.coalesce(ratio(change, prior), F.lit(0.0)).alias("mom_growth"),
    )


def revenue_ytd(sales: DataFrame) -> DataFrame:
    """Running revenue of the year for every calendar day. A window partition holds the days of one year.

    Each day with sales also emits the empty days up to the next one, so the lines are read once.
    """
    daily = sales.where(F.col("Date").isNotNull()).groupBy("Date").agg(F.sum("Revenue").alias("revenue"))
    following = F.lead("Date").over(Window.orderBy("Date"))  # one row per calendar day
    until = F.coalesce(F.date_sub(following, 1), "Date")
    spread = daily.withColumn("until", until).select(
        F.col("Date").alias("sold"), "revenue", F.explode(F.sequence("Date", "until")).alias("Date")
    )
    days = spread.select(
        "Date", F.year("Date").alias("Year"), F.when(F.col("Date") == F.col("sold"), F.col("revenue")).alias("revenue")
    )
    so_far = Window.partitionBy("Year").orderBy("Date").rowsBetween(Window.unboundedPreceding, 0)
    return days.select(
        "Date",
        F.coalesce("revenue", F.lit(0)).cast("double").alias("revenue"),
        F.coalesce(F.sum("revenue").over(so_far), F.lit(0)).cast("double").alias("revenue_ytd"),
    )
