"""KPIs: measures usable in any aggregate, the one-row snapshot, and its long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillwise.fixed_values import KPI_COLUMNS, KPI_DEFINITIONS, KPI_ERRORS, KPI_UNITS
from tillwise.functions.numbers import growth_percent, percent, ratio, total
from tillwise.functions.periods import month_label, month_start
from tillwise.functions.text import known, strip

# --- measures: use them in df.agg(...) or df.groupBy(...).agg(...) ------------------


def revenue() -> Column:
    return total(F.col("Revenue")).cast("double").alias("revenue")


def profit() -> Column:
    return total(F.col("Profit")).cast("double").alias("profit")


def profit_margin() -> Column:
    return percent(total(F.col("Profit")), total(F.col("Revenue"))).alias("profit_margin")


def orders(approximate: bool = False) -> Column:
    return _distinct_known("Order_ID", approximate).alias("orders")


def customers(approximate: bool = False) -> Column:
    return _distinct_known("Customer_ID", approximate).alias("customers")


def average_order_value(approximate: bool = False) -> Column:
    """Revenue of all lines, also those of unknown orders, per known order."""
    return ratio(total(F.col("Revenue")), _distinct_known("Order_ID", approximate)).alias("average_order_value")


def _distinct_known(name: str, approximate: bool) -> Column:
    id_text = known(strip(F.col(name).cast("string")))
    return F.approx_count_distinct(id_text) if approximate else F.count_distinct(id_text)


def calculate_revenue(sales: DataFrame) -> DataFrame:
    return sales.agg(revenue())


def calculate_profit(sales: DataFrame) -> DataFrame:
    return sales.agg(profit())


def calculate_profit_margin(sales: DataFrame) -> DataFrame:
    return sales.agg(profit_margin())


def calculate_orders(sales: DataFrame, approximate: bool = False) -> DataFrame:
    return sales.agg(orders(approximate))


def calculate_customers(sales: DataFrame, approximate: bool = False) -> DataFrame:
    return sales.agg(customers(approximate))


def calculate_average_order_value(sales: DataFrame, approximate: bool = False) -> DataFrame:
    return sales.agg(average_order_value(approximate))


# --- growth over the latest two months ---------------------------------------------


def latest_two(months: Column) -> tuple[Column, Column]:
    """Latest and previous entry of an array of (period, ...) structs; null where absent."""
    newest_first = F.sort_array(months, asc=False)
    return F.get(newest_first, F.lit(0)), F.get(newest_first, F.lit(1))


def _growth_columns(months: Column) -> list[Column]:
    now, before = latest_two(months)
    return [
        growth_percent(now["value"], before["value"]).alias("growth_rate"),
        month_label(now["period"]).alias("current_period"),
        month_label(before["period"]).alias("previous_period"),
        now["value"].cast("double").alias("current_revenue"),
        before["value"].cast("double").alias("previous_revenue"),
    ]


def calculate_monthly_growth(sales: DataFrame) -> DataFrame:
    """Revenue of the latest month present against the one present before it (gaps allowed)."""
    if "Date" not in sales.columns:
        sales = sales.withColumn("Date", F.lit(None).cast("date"))
    by_month = (
        sales.where(F.col("Date").isNotNull())
        .groupBy(month_start(F.col("Date")).alias("period"))
        .agg(total(F.col("Revenue")).alias("value"))
    )
    # One entry per calendar month: the array is bounded by the calendar, not by the rows.
    return by_month.agg(F.collect_list(F.struct("period", "value")).alias("months")).select(
        *_growth_columns(F.col("months"))
    )


# --- snapshot ---------------------------------------------------------------------


def validate_kpi_columns(sales: DataFrame) -> None:
    missing = [name for name in KPI_COLUMNS if name not in sales.columns]
    if missing:
        raise ValueError(KPI_ERRORS["columns"] + ", ".join(missing))


def calculate_kpis(sales: DataFrame) -> DataFrame:
    """All KPIs in one row, from one scan and one shuffle.

    Grouping by month, by order and by customer at once gives the sums, the months for the
    growth rate and both exact distinct counts. Each task first combines its own rows, so a
    hot month, order or customer reaches the shuffle as one row per task. The action fails
    when there are no rows.
    """
    validate_kpi_columns(sales)
    date = F.col("Date") if "Date" in sales.columns else F.lit(None).cast("date")
    keyed = sales.select(
        month_start(date).alias("month"),
        strip(F.col("Order_ID").cast("string")).alias("order"),
        strip(F.col("Customer_ID").cast("string")).alias("customer"),
        "Revenue",
        "Profit",
    ).withColumns({"order": known(F.col("order")), "customer": known(F.col("customer"))})
    groups = keyed.groupingSets([["month"], ["order"], ["customer"]], "month", "order", "customer").agg(
        F.grouping("month").alias("no_month"),
        F.grouping("order").alias("no_order"),
        F.grouping("customer").alias("no_customer"),
        F.sum("Revenue").alias("revenue"),
        F.sum("Profit").alias("profit"),
    )
    of_month = F.col("no_month") == 0
    value = F.coalesce("revenue", F.lit(0))
    facts = groups.agg(
        F.count_if(of_month).alias("month_groups"),
        total(F.when(of_month, F.col("revenue"))).alias("revenue"),
        total(F.when(of_month, F.col("profit"))).alias("profit"),
        F.count_if((F.col("no_order") == 0) & F.col("order").isNotNull()).alias("orders"),
        F.count_if((F.col("no_customer") == 0) & F.col("customer").isNotNull()).alias("customers"),
        F.collect_list(
            F.when(of_month & F.col("month").isNotNull(), F.struct(F.col("month").alias("period"), value.alias("value")))
        ).alias("months"),
    )
    checked = F.when(F.col("month_groups") == 0, F.raise_error(F.lit(KPI_ERRORS["empty"]))).otherwise(F.col("revenue"))
    growth = _growth_columns(F.col("months"))
    names = ["growth_rate", "growth_current_period", "growth_previous_period", "growth_current_revenue",
             "growth_previous_revenue"]
    return facts.select(
        checked.cast("double").alias("revenue"),
        F.col("profit").cast("double").alias("profit"),
        percent(F.col("profit"), F.col("revenue")).alias("profit_margin"),
        ratio(F.col("revenue"), F.col("orders")).alias("average_order_value"),
        "orders",
        "customers",
        *[column.alias(name) for column, name in zip(growth, names)],
    )


def kpis_to_dataframe(kpis: DataFrame) -> DataFrame:
    """The snapshot as seven rows (KPI, Value, Unit)."""
    rows = [
        F.struct(
            F.lit(name).alias("KPI"), F.col(field).cast("double").alias("Value"), F.lit(unit).alias("Unit")
        )
        for name, unit, field in KPI_UNITS
    ]
    return kpis.select(F.inline(F.array(*rows)))


def kpi_definitions(spark) -> DataFrame:
    """Formula and meaning of each KPI."""
    return spark.createDataFrame(KPI_DEFINITIONS, "`KPI` string, `Formula` string, `Business Meaning` string")
