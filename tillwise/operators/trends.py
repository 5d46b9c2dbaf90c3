"""Monthly, quarterly and yearly trends, best and worst month, fastest category, insight sentences.

All parts start from one small frame: sums per month and category.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillwise.fixed_values import GROWTH_FLOOR, TREND_TEXTS
from tillwise.functions.numbers import growth_percent, total
from tillwise.functions.periods import month_label, month_start, quarter_label, year_label
from tillwise.functions.text import amount, fill
from tillwise.operators.kpis import latest_two
from tillwise.sources.staging import stage

MONTH_TYPE = "month date, Category string, Revenue double, Profit double"


@dataclass
class Trends:
    monthly: DataFrame
    quarterly: DataFrame
    yearly: DataFrame
    best_worst: DataFrame
    fastest_category: DataFrame
    insights: DataFrame


def month_sums(sales: DataFrame) -> DataFrame:
    """(month, Category, Revenue, Profit) sums of the dated lines; the base of every trend.

    At most one row per calendar month and category. Empty without Date or Revenue.
    """
    if not {"Date", "Revenue"} <= set(sales.columns):
        return sales.sparkSession.createDataFrame([], MONTH_TYPE)
    category = F.col("Category") if "Category" in sales.columns else F.lit(None).cast("string")
    return (
        sales.where(F.col("Date").isNotNull())
        .groupBy(month_start(F.col("Date")).alias("month"), category.alias("Category"))
        .agg(total(F.col("Revenue")).alias("Revenue"), total(F.col("Profit")).alias("Profit"))
    )


def _period_trend(base: DataFrame, start: Column, label, name: str, growth: str) -> DataFrame:
    """Sums per period with growth against the previous period present (null without a base).

    The window has no partition: it runs over one row per calendar period.
    """
    in_order = Window.orderBy("start")
    sums = base.groupBy(start.alias("start")).agg(F.sum("Revenue").alias("Revenue"), F.sum("Profit").alias("Profit"))
    return sums.select(
        "start",
        label(F.col("start")).alias(name),
        F.col("Revenue").cast("double").alias("Revenue"),
        F.col("Profit").cast("double").alias("Profit"),
        growth_percent(F.col("Revenue"), F.lag("Revenue").over(in_order)).alias(f"{growth}_Revenue_Growth"),
        growth_percent(F.col("Profit"), F.lag("Profit").over(in_order)).alias(f"{growth}_Profit_Growth"),
    )


def _monthly(base: DataFrame) -> DataFrame:
    return _period_trend(base, F.col("month"), month_label, "Month_Period", "MoM")


def _quarterly(base: DataFrame) -> DataFrame:
    return _period_trend(base, F.trunc("month", "quarter"), quarter_label, "Quarter_Period", "QoQ")


def _yearly(base: DataFrame) -> DataFrame:
    return _period_trend(base, F.trunc("month", "year"), year_label, "Year_Period", "YoY")


def _in_order(trend: DataFrame) -> DataFrame:
    return trend.orderBy("start").drop("start")


def monthly_trend(sales: DataFrame) -> DataFrame:
    return _in_order(_monthly(month_sums(sales)))


def quarterly_trend(sales: DataFrame) -> DataFrame:
    return _in_order(_quarterly(month_sums(sales)))


def yearly_trend(sales: DataFrame) -> DataFrame:
    return _in_order(_yearly(month_sums(sales)))


def best_worst_month(sales: DataFrame) -> DataFrame:
    """One row: best and worst month by revenue, the earliest on ties; no row without dated lines."""
    return _best_worst(month_sums(sales))


def _best_worst(base: DataFrame) -> DataFrame:
    months = base.groupBy("month").agg(F.sum("Revenue").alias("revenue"))
    best = F.min(F.struct((-F.col("revenue")).alias("minus"), "month"))
    worst = F.min(F.struct("revenue", "month"))
    return (
        months.agg(best.alias("best"), worst.alias("worst"))
        .where(F.col("best").isNotNull())
        .select(
            month_label(F.col("best.month")).alias("best_month"),
            (-F.col("best.minus")).cast("double").alias("best_month_revenue"),
            month_label(F.col("worst.month")).alias("worst_month"),
            F.col("worst.revenue").cast("double").alias("worst_month_revenue"),
        )
    )


def fastest_growing_category(sales: DataFrame, floor: float = GROWTH_FLOOR) -> DataFrame:
    """One row: category with the largest growth from the previous to the latest month.

    Categories below ``floor`` revenue in the previous month are left out. First name on ties; no row
    when there are fewer than two months or no category qualifies. The month sums are staged, so the lines are read once.
    """
    return _fastest(stage(month_sums(sales), "months"), floor)


def _fastest(base: DataFrame, floor: float) -> DataFrame:
    months = base.groupBy("month").agg(F.lit(1).alias("one"))
    now, before = latest_two(F.col("months"))
    two = months.agg(F.collect_list(F.struct("month")).alias("months")).select(
        F.struct(now["month"].alias("now"), before["month"].alias("before")).alias("two")
    )
    # A one-row subquery; its value is a struct so that it is planned once.
    pair = two.scalar()
    revenue = F.col("Revenue").cast("double")
    return (
        base.where(F.col("Category").isNotNull() & (F.col("month") >= pair["before"]))
        .groupBy("Category")
        .agg(
            F.sum(F.when(F.col("month") == pair["now"], revenue).otherwise(0.0)).alias("now"),
            F.sum(F.when(F.col("month") == pair["before"], revenue).otherwise(0.0)).alias("before"),
        )
        .where(F.col("before") >= floor)
        .select("Category", growth_percent(F.col("now"), F.col("before")).alias("rate"))
        .agg(F.min(F.struct((-F.col("rate")).alias("minus"), "Category")).alias("first"))
        .where(F.col("first").isNotNull())
        .select(
            F.col("first.Category").alias("fastest_growing_category"),
            (-F.col("first.minus")).alias("fastest_growing_category_rate"),
        )
    )


def trend_insights(sales: DataFrame, floor: float = GROWTH_FLOOR) -> DataFrame:
    """(ord, insight) sentences. The month sums are staged, so the lines are read once."""
    return _insights(stage(month_sums(sales), "months"), floor).orderBy("ord")


def _direction(growth: Column) -> Column:
    return F.when(growth >= 0, "increased").otherwise("decreased")


def _latest_pair(base: DataFrame, period: Column) -> DataFrame:
    """One row with the latest and previous period: now.*, before.*."""
    sums = base.groupBy(period.alias("period")).agg(F.sum("Revenue").alias("revenue"), F.sum("Profit").alias("profit"))
    now, before = latest_two(F.col("periods"))
    return sums.agg(F.collect_list(F.struct("period", "revenue", "profit")).alias("periods")).select(
        now.alias("now"), before.alias("before")
    )


def _insights(base: DataFrame, floor: float) -> DataFrame:
    texts = TREND_TEXTS
    revenue = growth_percent(F.col("now.revenue"), F.col("before.revenue"))
    profit = F.coalesce(growth_percent(F.col("now.profit"), F.col("before.profit")), F.lit(0.0))

    def sentence(place: int, text: Column) -> Column:
        return F.struct(F.lit(place).alias("ord"), text.alias("insight"))

    months = _latest_pair(base, F.col("month")).select(
        F.inline(
            F.array(
                sentence(
                    1,
                    fill(
                        texts["revenue"],
                        direction=_direction(revenue),
                        growth=amount(F.abs(revenue), 1),
                        current=month_label(F.col("now.period")),
                        previous=month_label(F.col("before.period")),
                        now=amount(F.col("now.revenue")),
                        before=amount(F.col("before.revenue")),
                    ),
                ),
                sentence(
                    2,
                    fill(
                        texts["profit"],
                        direction=_direction(profit),
                        growth=amount(F.abs(profit), 1),
                        now=amount(F.col("now.profit")),
                        before=amount(F.col("before.profit")),
                    ),
                ),
            )
        )
    )
    quarters = _latest_pair(base, F.trunc("month", "quarter")).select(
        F.lit(3).alias("ord"),
        fill(
            texts["quarter"],
            direction=_direction(revenue),
            growth=amount(F.abs(revenue), 1),
            current=quarter_label(F.col("now.period")),
            previous=quarter_label(F.col("before.period")),
            now=amount(F.col("now.revenue")),
            before=amount(F.col("before.revenue")),
        ).alias("insight"),
    )
    peak = _best_worst(base).select(
        F.lit(4).alias("ord"),
        fill(
            texts["peak"], month=F.col("best_month"), revenue=amount(F.col("best_month_revenue"))
        ).alias("insight"),
    )
    category = _fastest(base, floor).select(
        F.lit(5).alias("ord"),
        fill(
            texts["category"],
            category=F.col("fastest_growing_category"),
            growth=amount(F.col("fastest_growing_category_rate"), 1),
        ).alias("insight"),
    )
    rows = months.unionByName(quarters).unionByName(peak).unionByName(category)
    return rows.where(F.col("insight").isNotNull())


def calculate_trends(sales: DataFrame, floor: float = GROWTH_FLOOR) -> Trends:
    """All parts, from one pass over the lines: the small month sums are staged."""
    base = stage(month_sums(sales), "months")
    return Trends(
        monthly=_in_order(_monthly(base)),
        quarterly=_in_order(_quarterly(base)),
        yearly=_in_order(_yearly(base)),
        best_worst=_best_worst(base),
        fastest_category=_fastest(base, floor),
        insights=_insights(base, floor).orderBy("ord"),
    )
