"""Named sales reports. Each is a function of the sales lines; null keys stay a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillwise.fixed_values import (
    REPORT_ROWS,
    REPORT_TITLES,
    SEGMENT_OCCASIONAL,
    SEGMENT_REGULAR,
    SEGMENT_REGULAR_RANGE,
    SEGMENT_VIP,
    SEGMENT_VIP_FROM,
    UNKNOWN,
)
from tillwise.functions.numbers import percent
from tillwise.functions.periods import month_label, month_start


def _sum(name: str) -> Column:
    return F.sum(name).cast("double")


def _totals(sales: DataFrame, key: str) -> DataFrame:
    return sales.groupBy(key).agg(
        F.sum("Quantity").cast("long").alias("Total_Quantity"),
        _sum("Revenue").alias("Total_Revenue"),
        _sum("Profit").alias("Total_Profit"),
    )


def top_products(sales: DataFrame, rows: int = REPORT_ROWS) -> DataFrame:
    return _totals(sales, "Product").orderBy(F.desc("Total_Revenue"), "Product").limit(rows)


def top_categories(sales: DataFrame) -> DataFrame:
    return _totals(sales, "Category").orderBy(F.desc("Total_Profit"), "Category")


def monthly_revenue(sales: DataFrame) -> DataFrame:
    return (
        sales.where(F.col("Date").isNotNull())
        .groupBy(month_start(F.col("Date")).alias("start"))
        .agg(_sum("Revenue").alias("Total_Revenue"), _sum("Profit").alias("Total_Profit"))
        .orderBy("start")
        .select(month_label(F.col("start")).alias("Month"), "Total_Revenue", "Total_Profit")
    )


def _by_customer(sales: DataFrame, orders_name: str, *more: Column) -> DataFrame:
    """Spend and distinct orders per known customer.

    Lines are first combined per (customer, order): a customer with a third of all lines is spread over
    all tasks, and counting distinct orders becomes counting rows.
    """
    per_order = (
        sales.where(F.col("Customer_ID") != UNKNOWN)
        .groupBy("Customer_ID", "Order_ID")
        .agg(
            F.sum("Revenue").alias("revenue"),
            F.count("Revenue").alias("lines"),
            *([F.sum("Profit").alias("profit")] if "Profit" in sales.columns else []),
        )
    )
    return per_order.groupBy("Customer_ID").agg(
        F.count("Order_ID").alias(orders_name), _sum("revenue").alias("Total_Spend"), *more
    )


def customer_segments(
    sales: DataFrame,
    vip_from: float = SEGMENT_VIP_FROM,
    regular_range: tuple[float, float] = SEGMENT_REGULAR_RANGE,
) -> DataFrame:
    """Spend tier per customer. ``Avg_Order_Value`` is the mean revenue of a line."""
    spend = F.col("Total_Spend")
    tier = (
        F.when(spend >= vip_from, SEGMENT_VIP)
        .when(spend.between(*regular_range), SEGMENT_REGULAR)
        .otherwise(SEGMENT_OCCASIONAL)
    )
    mean = F.try_divide(_sum("revenue"), F.sum("lines")).alias("Avg_Order_Value")
    customers = _by_customer(sales.select("Customer_ID", "Order_ID", "Revenue"), "Total_Orders", mean)
    return customers.withColumn("Customer_Segment", tier).orderBy(F.desc("Total_Spend"), "Customer_ID")


def best_customers(sales: DataFrame, rows: int = REPORT_ROWS) -> DataFrame:
    customers = _by_customer(sales, "Orders", _sum("profit").alias("Total_Profit"))
    return customers.orderBy(F.desc("Total_Spend"), "Customer_ID").limit(rows)


def worst_products(sales: DataFrame, rows: int = REPORT_ROWS) -> DataFrame:
    """Lowest margins in percent; 0 where there is no revenue."""
    margin = F.when(F.col("Total_Revenue") == 0, 0.0).otherwise(
        F.round(percent(F.col("Total_Profit"), F.col("Total_Revenue")), 2)
    )
    return (
        sales.groupBy("Product")
        .agg(_sum("Revenue").alias("Total_Revenue"), _sum("Profit").alias("Total_Profit"))
        .withColumn("Margin_Pct", margin)
        .orderBy("Margin_Pct", "Product")
        .limit(rows)
    )


REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "top_products": top_products,
    "top_categories": top_categories,
    "monthly_revenue": monthly_revenue,
    "customer_segments": customer_segments,
    "best_customers": best_customers,
    "worst_products": worst_products,
}


def list_reports(spark: SparkSession) -> DataFrame:
    """(report, title) of every named report."""
    return spark.createDataFrame([(name, REPORT_TITLES[name]) for name in REPORTS], "report string, title string")


def run_report(name: str, sales: DataFrame) -> DataFrame:
    if name not in REPORTS:
        raise ValueError(f"Unknown query key: {name}")
    return REPORTS[name](sales)
