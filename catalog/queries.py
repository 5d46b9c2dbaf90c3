"""One registered query per operator; each reads the tables in the given folder in full."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.inputs import costly_lines, dated_files, dirty_lines, spelled_lines, typed_texts
from tillwise.fixed_values import TEXT_COLUMNS
from tillwise.functions.text import format_currency, format_percent
from tillwise.operators import cleaning, forecast, inference, kpis, profile, recommend, reports, star, trends
from tillwise.operators.adhoc import run_select
from tillwise.operators.numbering import number_rows
from tillwise.operators.rollup import roll_up
from tillwise.operators.root_cause import analyze_rolled_root_cause, analyze_root_cause
from tillwise.session import shared_dir
from tillwise.sources.csv_files import load_data, write_csv
from tillwise.sources.run_store import RunStore, sales_record
from tillwise.sources.staging import in_parts
from tillwise.sources.star_tables import sales_lines

Query = Callable[[SparkSession, str], DataFrame]
HORIZON = 30
SEGMENT_VIP_FROM, SEGMENT_REGULAR_RANGE = 2_500_000, (1_500_000, 2_499_999)
PRODUCT_SHARE, CUSTOMER_SHARE_PCT, CUSTOMER_HIGH_PCT = 0.02, 0.15, 0.16
ADHOC_SQL = (
    "SELECT Category, COUNT(*) AS Transaction_Count, SUM(Revenue) AS Total_Revenue FROM sales_data "
    "WHERE run_id = :run_id GROUP BY Category ORDER BY Total_Revenue DESC"
)

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(frame: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that two engines can be compared by value."""
    return frame.select(
        *[
            F.round(F.col(f"`{name}`"), digits).alias(name) if kind == "double" else F.col(f"`{name}`")
            for name, kind in frame.dtypes
        ]
    )


def over_sales(name: str, operator: Callable[[DataFrame], DataFrame], *columns: str, digits: int = 4) -> None:
    """Register an operator over the sales lines, reading only the named columns (all when none is named)."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        lines = sales_lines(spark, folder, columns) if columns else sales_lines(spark, folder)
        return rounded(operator(lines), digits)

    run.__name__ = name
    query(run)


KPI = ("Date", "Order_ID", "Customer_ID", "Revenue", "Profit")
PERIOD = ("Date", "Revenue", "Profit")
DAILY = ("Date", "Revenue")

# --- KPIs -------------------------------------------------------------------------
over_sales("kpi_snapshot", kpis.calculate_kpis, *KPI)
over_sales("kpi_long", lambda lines: kpis.kpis_to_dataframe(kpis.calculate_kpis(lines)), *KPI)
over_sales("monthly_growth", kpis.calculate_monthly_growth, *DAILY)
over_sales(
    "kpi_by_category",
    lambda lines: in_parts(lines, "Category", "Order_ID", "Customer_ID").groupBy("Category").agg(
        kpis.revenue(),
        kpis.profit(),
        kpis.profit_margin(),
        kpis.orders(),
        kpis.customers(),
        kpis.average_order_value(),
    ),
)
over_sales(
    "kpi_texts",
    lambda lines: kpis.kpis_to_dataframe(kpis.calculate_kpis(lines)).select(
        "KPI",
        F.when(F.col("Unit") == "currency", format_currency(F.col("Value")))
        .when(F.col("Unit") == "percent", format_percent(F.col("Value")))
        .otherwise(F.col("Value").cast("long").cast("string"))
        .alias("Text"),
    ),
    *KPI,
)

# --- reports ----------------------------------------------------------------------
over_sales("top_products", reports.top_products, "Product", "Quantity", "Revenue", "Profit")
over_sales("top_categories", reports.top_categories, "Category", "Quantity", "Revenue", "Profit")
over_sales("monthly_revenue", reports.monthly_revenue, *PERIOD)
over_sales("customer_segments", reports.customer_segments, "Order_ID", "Customer_ID", "Revenue")
over_sales(
    "customer_segments_scaled",
    lambda lines: reports.customer_segments(lines, SEGMENT_VIP_FROM, SEGMENT_REGULAR_RANGE),
    "Order_ID", "Customer_ID", "Revenue",
)
over_sales("best_customers", reports.best_customers, "Order_ID", "Customer_ID", "Revenue", "Profit")
over_sales("worst_products", reports.worst_products, "Product", "Revenue", "Profit")


@query
def adhoc_sql(spark: SparkSession, folder: str) -> DataFrame:
    lines = sales_lines(spark, folder, ["Category", "Revenue"]).withColumn("run_id", F.lit("this-run"))
    rows = run_select({"sales_data": lines}, ADHOC_SQL, "this-run")
    return rounded(rows.withColumn("Total_Revenue", F.col("Total_Revenue").cast("double")))


# --- trends -----------------------------------------------------------------------
over_sales("trend_monthly", trends.monthly_trend, *PERIOD)
over_sales("trend_quarterly", trends.quarterly_trend, *PERIOD)
over_sales("trend_yearly", trends.yearly_trend, *PERIOD)
over_sales("best_worst_month", trends.best_worst_month, *PERIOD)
over_sales("fastest_category", trends.fastest_growing_category, "Date", "Category", "Revenue", "Profit")
over_sales("trend_insights", trends.trend_insights, "Date", "Category", "Revenue", "Profit")

# --- root cause -------------------------------------------------------------------
DRIVERS = ("Date", "Category", "Product", "Customer_ID", "Revenue")
over_sales("rca_summary", lambda lines: analyze_root_cause(lines).summary, *DRIVERS)
over_sales("rca_contributors", lambda lines: analyze_root_cause(lines).contributors, *DRIVERS)
over_sales("rca_top", lambda lines: analyze_root_cause(lines).top, *DRIVERS)
over_sales("rca_explanations", lambda lines: analyze_root_cause(lines).explanations, *DRIVERS)
over_sales(
    "rca_profit_contributors", lambda lines: analyze_root_cause(lines, "Profit").contributors, *DRIVERS, "Profit"
)
over_sales(
    "rca_no_decline",
    lambda lines: analyze_root_cause(lines.withColumn("Revenue", -F.col("Revenue"))).summary,
    *DRIVERS,
)


# --- profile and cleaning of the raw text lines -----------------------------------
def standard_dirty(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.standardize_column_names(dirty_lines(spark, folder))


@query
def null_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.check_missing_values(standard_dirty(spark, folder))


@query
def duplicate_count(spark: SparkSession, folder: str) -> DataFrame:
    return profile.check_duplicates(standard_dirty(spark, folder))


@query
def invalid_dates(spark: SparkSession, folder: str) -> DataFrame:
    return profile.validate_dates(standard_dirty(spark, folder))


@query
def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    return profile.generate_quality_report(standard_dirty(spark, folder))


@query
def quality_score(spark: SparkSession, folder: str) -> DataFrame:
    return profile.quality_score(standard_dirty(spark, folder))


@query
def column_report(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.clean_sales_data(dirty_lines(spark, folder)).column_report


@query
def clean_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = cleaning.clean_sales_data(dirty_lines(spark, folder)).summary
    return summary.withColumn("missing_expected_columns", F.concat_ws(", ", "missing_expected_columns"))


@query
def clean_absent_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaning of lines without two of the expected columns."""
    summary = cleaning.clean_sales_data(dirty_lines(spark, folder).drop("Customer-ID", "Cost")).summary
    missing = F.concat_ws(", ", "missing_expected_columns").alias("missing_expected_columns")
    return summary.select("rows_before", "rows_after", "columns", "duplicate_rows_removed", missing)


@query
def clean_actions(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cleaning.clean_sales_data(dirty_lines(spark, folder)).actions)


@query
def clean_rows(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cleaning.in_date_order(cleaning.clean_data(dirty_lines(spark, folder))))


@query
def clean_kpis(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaning and KPIs in one job. Sums of doubles: fewer digits are compared."""
    return rounded(kpis.calculate_kpis(cleaning.clean_data(dirty_lines(spark, folder))), 3)


@query
def inferred_types(spark: SparkSession, folder: str) -> DataFrame:
    return inference.inferred_types(typed_texts(spark, folder))


@query
def clean_by_type(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that differ in the spelling of their order number only are duplicates by type."""
    result = cleaning.clean_sales_data(spelled_lines(spark, folder), by_type=True)
    return result.summary.select("rows_before", "rows_after", "duplicate_rows_removed")


@query
def date_format_vote(spark: SparkSession, folder: str) -> DataFrame:
    lines = dated_files(spark, folder)
    return inference.date_format_votes(lines, "file", row_order=F.col("Order_ID").cast("long"))


@query
def clean_voted_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned lines and revenue per day, from files that write their dates in different orders."""
    cleaned = cleaning.clean_sales_data(dated_files(spark, folder), file_column="file").cleaned
    revenue = F.sum(F.col("Revenue").cast("decimal(18,4)")).cast("double")
    return rounded(cleaned.groupBy("Date").agg(F.count("*").alias("lines"), revenue.alias("revenue")))


# --- forecast ---------------------------------------------------------------------
over_sales("daily_revenue", lambda lines: forecast.daily_revenue(lines).drop("series"), *DAILY)
over_sales("daily_spine", lambda lines: forecast.daily_spine(lines).select("Date", "revenue", "x"), *DAILY)


def _forecast_only(lines: DataFrame, *columns: str, series: str | None = None) -> DataFrame:
    rows = forecast.generate_forecast(lines, HORIZON, series).rows.where(F.col("Type") == "Forecast")
    return rows.select(*columns)


over_sales("forecast_lr", lambda lines: _forecast_only(lines, "Date", "Forecast_LR"), *DAILY)
over_sales("forecast_ma", lambda lines: _forecast_only(lines, "Date", "Forecast_MA"), *DAILY)
over_sales("rolled_trend_insights", lambda lines: trends.calculate_trends(roll_up(lines).months("Category")).insights, *PERIOD, "Category")
over_sales("rolled_rca_contributors", lambda lines: analyze_rolled_root_cause(roll_up(lines)).contributors, *DRIVERS)
over_sales("rolled_forecast_rows", lambda lines: forecast.generate_forecast(roll_up(lines).days(), HORIZON).rows, *DAILY)
over_sales("forecast_rows", lambda lines: forecast.generate_forecast(lines, HORIZON).rows, *DAILY)
over_sales(
    "forecast_status_of_customers",
    lambda lines: forecast.generate_forecast(lines, HORIZON, "Customer_ID").status,
    *DAILY,
    "Customer_ID",
)
over_sales("forecast_metrics", lambda lines: forecast.generate_forecast(lines, HORIZON).metrics, *DAILY)
over_sales(
    "forecast_by_category",
    lambda lines: _forecast_only(lines, "series", "Date", "Forecast_MA", "Forecast_LR", series="Category"),
    "Date", "Category", "Revenue",
)
over_sales(
    "forecast_status",
    lambda lines: forecast.generate_forecast(lines, HORIZON, "Product").status,
    "Date", "Product", "Revenue",
)
over_sales(
    "trailing_mean",
    lambda lines: forecast.daily_spine(lines).select("Date", forecast.trailing_mean(14).alias("mean_14_days")),
    *DAILY,
    digits=6,
)


# --- recommendations --------------------------------------------------------------
@query
def rec_margin(spark: SparkSession, folder: str) -> DataFrame:
    return recommend.low_margin(kpis.calculate_kpis(costly_lines(spark, folder)))


@query
def rec_loss_products(spark: SparkSession, folder: str) -> DataFrame:
    return recommend.loss_products(recommend.product_totals(costly_lines(spark, folder)))


@query
def rec_share_products(spark: SparkSession, folder: str) -> DataFrame:
    lines = sales_lines(spark, folder, ["Product", "Revenue"])
    return recommend.high_share_products(recommend.product_totals(lines), kpis.calculate_revenue(lines), PRODUCT_SHARE)


@query
def rec_customer_risk(spark: SparkSession, folder: str) -> DataFrame:
    lines = sales_lines(spark, folder, ["Customer_ID", "Revenue"])
    customers = recommend.customer_totals(lines)
    return recommend.customer_concentration(
        customers, kpis.calculate_revenue(lines), CUSTOMER_SHARE_PCT, CUSTOMER_HIGH_PCT
    )


@query
def rec_quality(spark: SparkSession, folder: str) -> DataFrame:
    summary = cleaning.clean_sales_data(dirty_lines(spark, folder)).summary
    return recommend.duplicate_audit(summary).unionByName(recommend.date_audit(summary))


@query
def recommendations_all(spark: SparkSession, folder: str) -> DataFrame:
    lines = costly_lines(spark, folder)
    return recommend.generate_recommendations(
        lines,
        kpis.calculate_kpis(lines),
        cleaning.clean_sales_data(dirty_lines(spark, folder)).summary,
        product_share=PRODUCT_SHARE,
        customer_share_pct=CUSTOMER_SHARE_PCT,
        customer_high_pct=CUSTOMER_HIGH_PCT,
    )


# --- run store and files ----------------------------------------------------------
def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tillwise-{name}-{uuid4()}"


def _stored(spark: SparkSession, folder: str) -> tuple[RunStore, str]:
    lines = sales_lines(spark, folder)
    store = RunStore(spark, _fresh(spark, "store"))
    return store, store.save(lines, kpis.calculate_kpis(lines), "sales lines")


@query
def kpi_history(spark: SparkSession, folder: str) -> DataFrame:
    store, _ = _stored(spark, folder)
    return rounded(store.kpi_history().drop("created_at", "run_id"))


@query
def stored_sales(spark: SparkSession, folder: str) -> DataFrame:
    store, run_id = _stored(spark, folder)
    return rounded(store.table("sales_data", run_id).drop("run_id"))


@query
def stored_report(spark: SparkSession, folder: str) -> DataFrame:
    store, run_id = _stored(spark, folder)
    return rounded(store.run_predefined_query(run_id, "top_products"))


@query
def stored_adhoc(spark: SparkSession, folder: str) -> DataFrame:
    store, run_id = _stored(spark, folder)
    return rounded(store.run_custom_query(run_id, ADHOC_SQL))


@query
def sales_json(spark: SparkSession, folder: str) -> DataFrame:
    lines = sales_lines(spark, folder)
    numbered = number_rows(lines, cleaning.order_keys(lines))
    return numbered.select("row_number", sales_record(lines.columns).alias("sales_record"))


@query
def numbered_rows(spark: SparkSession, folder: str) -> DataFrame:
    lines = sales_lines(spark, folder)
    return number_rows(lines, cleaning.order_keys(lines)).select("row_number", "Date", *TEXT_COLUMNS)


over_sales(
    "preview_rows",
    lambda lines: cleaning.preview(lines).withColumns(
        {name: F.col(name).cast("double") for name in ("Revenue", "Cost", "Profit")}
    ),
)


@query
def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = _fresh(spark, "csv")
    write_csv(sales_lines(spark, folder), path)
    return load_data(spark, path)


@query
def csv_two_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The lines in two folders whose files have their columns in opposite orders, read back together."""
    lines, paths = sales_lines(spark, folder), [_fresh(spark, "csv-odd"), _fresh(spark, "csv-even")]
    for rest, path in enumerate(paths):
        columns = lines.columns if rest else lines.columns[::-1]
        write_csv(lines.where(F.col("Order_ID").cast("long") % 2 == rest).select(*columns), path)
    return load_data(spark, paths)


def noted_lines(spark: SparkSession, folder: str) -> DataFrame:
    """All sales lines with a note that holds line breaks, doubled quotes and commas, by rules on the order key."""
    key = F.col("Order_ID").cast("long")
    note = (
        F.when(key % 7 == 0, F.concat("Product", F.lit('\nsaid "'), "Category", F.lit('",\n'), "Order_ID"))
        .when(key % 7 == 1, F.concat(F.lit('"'), "Category", F.lit('"')))
        .when(key % 7 == 2, F.concat("Category", F.lit("\r\n, \n\n")))
        .when(key % 7 == 3, F.concat("Order_ID", F.lit(", "), "Product"))
        .otherwise(F.col("Product"))
    )
    return sales_lines(spark, folder, ["Order_ID", "Customer_ID", "Product", "Category"]).withColumn("note", note)


@query
def csv_quoted_breaks(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with line breaks in quoted cells, written as CSV and read back in splits."""
    path = _fresh(spark, "csv-breaks")
    write_csv(noted_lines(spark, folder), path)
    return load_data(spark, path)


# --- star schema ------------------------------------------------------------------
over_sales("dim_products", star.dim_products, "Product", "Category")
over_sales("dim_customers", star.dim_customers, "Customer_ID")
over_sales("dim_calendar", star.dim_calendar, "Date")
over_sales(
    "fact_sales",
    lambda lines: star.fact_sales(
        lines.withColumns({name: F.col(name).cast("double") for name in ("Revenue", "Cost", "Profit")})
    ),
)
over_sales("revenue_ytd", star.revenue_ytd, *DAILY)
over_sales("mom_calendar", star.mom_growth, *DAILY)
over_sales("star_measures", lambda lines: star.star_measures(star.fact_sales(lines)))
over_sales(
    "star_measures_by_product", lambda lines: star.star_measures(star.fact_sales(lines), ["Product_ID"])
)
