"""Daily revenue forecasts: recursive moving average and linear trend, for one or many series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillwise.fixed_values import (
    FORECAST_HORIZON,
    FORECAST_LONG_WINDOW,
    FORECAST_MIN_DAYS,
    FORECAST_SHORT_WINDOW,
    FORECAST_TEXTS,
)
from tillwise.sources.staging import stage


@dataclass
class Forecast:
    """``rows``: history, bridge and forecast; ``metrics``: one row per series; ``status``: why a series has none."""

    rows: DataFrame
    metrics: DataFrame
    status: DataFrame


def daily_revenue(sales: DataFrame, series: str | None = None) -> DataFrame:
    """(series, Date, revenue): revenue per day with sales. Lines without date, revenue or series are left out."""
    key = F.col(series).cast("string") if series else F.lit("all")
    return (
        sales.where(F.col("Date").isNotNull() & F.col("Revenue").isNotNull())
        .select(key.alias("series"), F.col("Date").cast("date").alias("Date"), "Revenue")
        .where(F.col("series").isNotNull())
        .groupBy("series", "Date")
        .agg(F.sum("Revenue").cast("double").alias("revenue"))
    )


def daily_spine(sales: DataFrame, series: str | None = None) -> DataFrame:
    """(series, Date, revenue, x, last, sale_days): every day from first to last sale, 0 where nothing was sold.

    Each day with sales also emits the empty days up to the next one, so no calendar is joined.
    The window holds one row per day of one series, never single lines.
    """
    return _spine(daily_revenue(sales, series))


def _spine(daily: DataFrame) -> DataFrame:
    whole = Window.partitionBy("series")
    following = F.lead("Date").over(whole.orderBy("Date"))
    gaps = daily.select(
        "series",
        "Date",
        "revenue",
        F.coalesce(F.date_sub(following, 1), "Date").alias("until"),
        F.min("Date").over(whole).alias("first"),
        F.max("Date").over(whole).alias("last"),
        F.count("*").over(whole).alias("sale_days"),
    )
    return gaps.select(
        "series",
        F.explode(F.sequence("Date", "until")).alias("day"),
        F.struct("Date", "revenue").alias("sale"),
        "first",
        "last",
        "sale_days",
    ).select(
        "series",
        F.col("day").alias("Date"),
        F.when(F.col("day") == F.col("sale.Date"), F.col("sale.revenue")).otherwise(0.0).alias("revenue"),
        F.datediff("day", "first").alias("x"),
        "last",
        "sale_days",
    )


def trailing_mean(rows: int, value: str = "revenue") -> Column:
    """Mean of this and the preceding rows of a series."""
    return F.avg(value).over(Window.partitionBy("series").orderBy("Date").rowsBetween(1 - rows, 0))


def forecast_models(sales: DataFrame, horizon_days: int = FORECAST_HORIZON, series: str | None = None) -> DataFrame:
    """One row per series: slope, intercept, mean and both forecasts as arrays of ``horizon_days`` values.

    Only the recurrence over the horizon is sequential, inside one row; its seed is at most 14 values.
    """
    return _models(daily_spine(sales, series), horizon_days)


def _models(spine: DataFrame, horizon_days: int) -> DataFrame:
    spine = spine.where(F.col("sale_days") >= FORECAST_MIN_DAYS)
    recent = F.date_diff(F.col("last"), F.col("Date")) < FORECAST_LONG_WINDOW
    fitted = spine.groupBy("series").agg(
        F.max("last").alias("last"),
        F.count("*").alias("days"),
        F.regr_slope("revenue", "x").alias("slope"),
        F.regr_intercept("revenue", "x").alias("intercept"),
        F.avg("revenue").alias("average"),
        F.sort_array(F.collect_list(F.when(recent, F.struct("Date", "revenue")))).alias("tail"),
    )
    if horizon_days < 0:
        raise ValueError("horizon_days must not be negative")
    steps = F.slice(F.sequence(F.lit(1), F.lit(max(1, horizon_days))), 1, horizon_days)  # sequence(1, 0) counts down
    window = F.when(F.col("days") >= FORECAST_LONG_WINDOW, FORECAST_LONG_WINDOW).otherwise(FORECAST_SHORT_WINDOW)
    seed = F.col("seed")

    def next_value(values: Column, _: Column) -> Column:
        size = F.least(F.col("window"), F.size(values))
        last_values = F.slice(values, -size, size)
        mean = F.aggregate(last_values, F.lit(0.0), lambda sofar, value: sofar + value) / size
        return F.concat(values, F.array(mean))

    averaged = F.aggregate(steps, seed, next_value)
    window_days = F.least(F.col("window"), F.size(seed))
    recent_values = F.slice(seed, -window_days, window_days)
    line = F.transform(
        steps, lambda step: F.greatest(F.lit(0.0), F.col("slope") * (F.col("days") - 1 + step) + F.col("intercept"))
    )
    return fitted.withColumns(
        {"seed": F.transform("tail", lambda day: day["revenue"]), "window": window.cast("int")}
    ).select(
        "series",
        "last",
        "days",
        "slope",
        "intercept",
        "average",
        window_days.alias("window_days"),
        (F.aggregate(recent_values, F.lit(0.0), lambda sofar, value: sofar + value) / window_days).alias("window_average"),
        F.slice(averaged, F.size(seed) + 1, F.lit(horizon_days)).alias("moving_average"),
        line.alias("line"),
    )


def _rows(spine: DataFrame, models: DataFrame) -> DataFrame:
    """History, one bridge row that repeats the last day in all three columns, then the forecast."""
    none = F.lit(None).cast("double")
    fields = ["Date", "Actual_Revenue", "Forecast_MA", "Forecast_LR", "Type"]

    def row(*values: Column) -> Column:
        return F.struct(*[value.alias(name) for value, name in zip(values, fields)])

    actual, date = F.col("revenue"), F.col("Date")
    past = row(date, actual, none, none, F.lit("Historical"))
    bridge = row(date, actual, actual, actual, F.lit("Historical"))
    history = spine.where(F.col("sale_days") >= FORECAST_MIN_DAYS).select(
        "series", F.inline(F.when(date == F.col("last"), F.array(past, bridge)).otherwise(F.array(past)))
    )
    future = models.select(
        "series", "last", F.posexplode(F.arrays_zip("moving_average", "line")).alias("step", "value")
    ).select(
        "series",
        F.date_add("last", F.col("step") + 1).alias("Date"),
        none.alias("Actual_Revenue"),
        F.col("value.moving_average").alias("Forecast_MA"),
        F.col("value.line").alias("Forecast_LR"),
        F.lit("Forecast").alias("Type"),
    )
    return history.unionByName(future)


def _metrics(models: DataFrame) -> DataFrame:
    summed = lambda name: F.aggregate(name, F.lit(0.0), lambda sofar, value: sofar + value)
    return models.select(
        "series",
        "slope",
        "intercept",
        F.col("average").alias("average_historical_daily"),
        "window_days",
        "window_average",
        summed("moving_average").alias("horizon_total_ma"),
        summed("line").alias("horizon_total_lr"),
    )


def generate_forecast(
    sales: DataFrame, horizon_days: int = FORECAST_HORIZON, series: str | None = None
) -> Forecast:
    """Forecast the total (``series=None``) or every value of a column, each on its own date range.

    Series with sales on fewer than five days have no rows and no metrics, only a status.
    """
    if not {"Date", "Revenue"} <= set(sales.columns):
        sales = sales.sparkSession.createDataFrame([], "Date date, Revenue double")
        series, reason = None, FORECAST_TEXTS["no_data"]
    else:
        reason = FORECAST_TEXTS["few_days"]
    # One row per series and day: written once, read by history, models and status.
    daily = stage(daily_revenue(sales, series), "daily-revenue")
    spine = _spine(daily)
    models = _models(spine, horizon_days)
    days = daily.groupBy("series").agg(F.count("*").alias("sale_days"))
    if series is None:  # the one series has a status row also when there is no line at all
        days = days.agg(F.lit("all").alias("series"), F.coalesce(F.max("sale_days"), F.lit(0)).alias("sale_days"))
    enough = F.col("sale_days") >= FORECAST_MIN_DAYS
    status = days.select("series", "sale_days", F.when(enough, "ok").otherwise(F.lit(reason)).alias("status"))
    rows, metrics = _rows(spine, models), _metrics(models)
    return Forecast(
        rows=rows if series else rows.drop("series"),
        metrics=metrics if series else metrics.drop("series"),
        status=status if series else status.drop("series"),
    )
