"""Rule-based recommendations from sales lines, the KPI row and the cleaning summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tillwise.fixed_values import (
    CUSTOMER_SHARE_HIGH_PCT,
    CUSTOMER_SHARE_PCT,
    LOSS_PRODUCTS_SHOWN,
    LOW_MARGIN,
    PRODUCT_SHARE,
    RULE_TEXTS,
    UNKNOWN,
    URGENT_MARGIN,
)
from tillwise.functions.numbers import percent, ratio, total
from tillwise.functions.text import amount, fill
from tillwise.operators.rollup import RollUp
from tillwise.sources.staging import stage

RECOMMENDATION_TYPE = (
    "rule_no int, rank int, title string, priority string, category string, trigger_reason string, description string"
)


def _advice(rule: str, number: int, rank: Column, priority: Column, **words: Column) -> list[Column]:
    title, category, reason, description = RULE_TEXTS[rule]
    return [
        F.lit(number).alias("rule_no"),
        rank.cast("int").alias("rank"),
        fill(title, **words).alias("title"),
        priority.alias("priority"),
        F.lit(category).alias("category"),
        fill(reason, **words).alias("trigger_reason"),
        fill(description, **words).alias("description"),
    ]


def low_margin(kpis: DataFrame, low: float = LOW_MARGIN, urgent: float = URGENT_MARGIN) -> DataFrame:
    margin = F.col("profit_margin")
    priority = F.when(margin < urgent, "High").otherwise("Medium")
    return kpis.where(margin < low).select(*_advice("margin", 1, F.lit(1), priority, margin=amount(margin, 1)))


def product_totals(sales: DataFrame) -> DataFrame:
    """(member, revenue, profit) per known product."""
    profit = F.sum("Profit") if "Profit" in sales.columns else F.lit(None)
    return (
        sales.where(F.col("Product").isNotNull())
        .groupBy(F.col("Product").alias("member"))
        .agg(total(F.col("Revenue")).cast("double").alias("revenue"), profit.cast("double").alias("profit"))
    )


def customer_totals(sales: DataFrame) -> DataFrame:
    """(member, revenue) per known customer."""
    return (
        sales.where(F.col("Customer_ID") != UNKNOWN)
        .groupBy(F.col("Customer_ID").alias("member"))
        .agg(total(F.col("Revenue")).cast("double").alias("revenue"))
    )


def member_totals(sales: DataFrame) -> DataFrame:
    """Sums per product, per customer and of all lines, from one pass; staged. No lines give no rows.

    ``products_of`` and ``customers_of`` read the members out of it.
    """
    dimensions = [name for name in ("Product", "Customer_ID") if name in sales.columns]
    profit = F.sum("Profit") if "Profit" in sales.columns else F.lit(None)
    sums = [total(F.col("Revenue")).cast("double").alias("revenue"), profit.cast("double").alias("profit")]
    if not dimensions:
        return stage(sales.groupBy().agg(F.count("*").alias("rows"), *sums).where("rows > 0"), "member-totals")
    grouped = sales.groupingSets([*[[name] for name in dimensions], []], *dimensions)
    without = [F.grouping(name).alias(f"without {name}") for name in dimensions]
    return stage(grouped.agg(*without, *sums), "member-totals")


def rolled_totals(rolled: RollUp) -> DataFrame:
    """What ``member_totals`` gives, from sums per month; staged. No row of all lines: none of the rules needs it."""
    profit = F.sum("Profit") if "Profit" in rolled.columns else F.lit(None)
    sums = rolled.members().where(F.col("dimension").isin("Product", "Customer_ID")).groupBy("dimension", "member").agg(
        total(F.col("Revenue")).cast("double").alias("revenue"), profit.cast("double").alias("profit")
    )
    of = lambda name: F.when(F.col("dimension") == name, F.col("member")).alias(name)
    without = lambda name: (F.col("dimension") != name).cast("int").alias(f"without {name}")
    names = ("Product", "Customer_ID")
    return stage(sums.select(*map(of, names), *map(without, names), "revenue", "profit"), "member-totals")


def products_of(totals: DataFrame) -> DataFrame:
    """What ``product_totals`` gives, from ``member_totals``."""
    known = (F.col("without Product") == 0) & F.col("Product").isNotNull()
    return totals.where(known).select(F.col("Product").alias("member"), "revenue", "profit")


def customers_of(totals: DataFrame) -> DataFrame:
    """What ``customer_totals`` gives, from ``member_totals``."""
    known = (F.col("without Customer_ID") == 0) & (F.col("Customer_ID") != UNKNOWN)
    return totals.where(known).select(F.col("Customer_ID").alias("member"), "revenue")


def loss_products(products: DataFrame, shown: int = LOSS_PRODUCTS_SHOWN) -> DataFrame:
    """The worst products with a negative profit."""
    worst = products.where(F.col("profit") < 0).orderBy("profit", "member").limit(shown)
    # At most ``shown`` rows: their rank is the place in the sorted list of themselves.
    listed = worst.agg(F.sort_array(F.collect_list(F.struct("profit", "member", "revenue"))).alias("worst"))
    return listed.select(F.posexplode("worst").alias("place", "row")).select(
        *_advice(
            "loss",
            2,
            F.col("place") + 1,
            F.lit("High"),
            product=F.col("row.member"),
            margin=F.coalesce(amount(percent(F.col("row.profit"), F.col("row.revenue")), 1), F.lit("-inf")),
            loss=amount(F.abs("row.profit")),
        )
    )


def high_share_products(products: DataFrame, kpis: DataFrame, share: float = PRODUCT_SHARE) -> DataFrame:
    """Products with at least ``share`` of the revenue in the KPI row; in name order when sorted by title."""
    part = ratio(F.col("revenue"), kpis.select("revenue").scalar())
    large = products.select("member", part.alias("part")).where(F.col("part") >= share)
    words = {"product": F.col("member"), "share": amount(F.col("part") * 100, 1)}
    return large.select(*_advice("share", 3, F.lit(1), F.lit("Medium"), **words))


def customer_concentration(
    customers: DataFrame,
    kpis: DataFrame,
    share_pct: float = CUSTOMER_SHARE_PCT,
    high_pct: float = CUSTOMER_SHARE_HIGH_PCT,
) -> DataFrame:
    """The customer with the largest revenue (first id on ties) when its share is too large."""
    first = F.min(F.struct((-F.col("revenue")).alias("minus"), "member")).alias("first")
    share = percent(F.col("revenue"), kpis.select("revenue").scalar())
    return (
        customers.agg(first)
        .select(F.col("first.member").alias("customer"), (-F.col("first.minus")).alias("revenue"))
        .withColumn("share", share)
        .where(F.col("share") >= share_pct)
        .select(
            *_advice(
                "customer",
                4,
                F.lit(1),
                F.when(F.col("share") >= high_pct, "High").otherwise("Medium"),
                customer=F.col("customer"),
                share=amount(F.col("share"), 1),
                revenue=amount(F.col("revenue")),
            )
        )
    )


def duplicate_audit(summary: DataFrame) -> DataFrame:
    return _counter_rule(summary, "duplicates", 5, "duplicate_rows_removed")


def date_audit(summary: DataFrame) -> DataFrame:
    return _counter_rule(summary, "dates", 6, "invalid_dates_found")


def _counter_rule(summary: DataFrame, rule: str, number: int, counter: str) -> DataFrame:
    return summary.where(F.col(counter) > 0).select(
        *_advice(rule, number, F.lit(1), F.lit("Low"), rows=F.col(counter))
    )


def generate_recommendations(
    sales: DataFrame,
    kpis: DataFrame,
    summary: DataFrame,
    low_margin_pct: float = LOW_MARGIN,
    urgent_margin_pct: float = URGENT_MARGIN,
    product_share: float = PRODUCT_SHARE,
    customer_share_pct: float = CUSTOMER_SHARE_PCT,
    customer_high_pct: float = CUSTOMER_SHARE_HIGH_PCT,
    rolled: RollUp | None = None,
) -> DataFrame:
    """All triggered rules in rule order; nothing when there are no sales lines.

    The KPI row is computed once; totals per product and customer come from one more pass and are staged. With the
    roll-up of the lines they are not read again.
    """
    has = set(sales.columns).issuperset
    totals = None
    if has({"Revenue"}):
        totals = member_totals(sales) if rolled is None else rolled_totals(rolled)
    if (rolled.rows if rolled else sales if totals is None else totals).isEmpty():
        return sales.sparkSession.createDataFrame([], RECOMMENDATION_TYPE)
    kpis = sales.sparkSession.createDataFrame(kpis.collect(), kpis.schema)  # one row
    parts = [low_margin(kpis, low_margin_pct, urgent_margin_pct)]
    if has({"Product", "Revenue"}):
        products = products_of(totals)
        if has({"Profit"}):
            parts.append(loss_products(products))
        if has({"Quantity"}):
            parts.append(high_share_products(products, kpis, product_share))
    if has({"Customer_ID", "Revenue"}):
        parts.append(customer_concentration(customers_of(totals), kpis, customer_share_pct, customer_high_pct))
    parts += [duplicate_audit(summary), date_audit(summary)]
    return reduce(DataFrame.unionByName, parts).orderBy("rule_no", "rank", "title")
