"""The complete job: read, clean, compute KPIs, store; and all analyses of a stored run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tillwise.fixed_values import DATE_FORMATS, FORECAST_HORIZON
from tillwise.operators.cleaning import CleanResult, clean_sales_data
from tillwise.operators.forecast import Forecast, generate_forecast
from tillwise.operators.kpis import calculate_kpis
from tillwise.operators.recommend import generate_recommendations
from tillwise.operators.root_cause import RootCause, analyze_rolled_root_cause
from tillwise.operators.rollup import roll_up
from tillwise.operators.trends import Trends, calculate_trends
from tillwise.sources.csv_files import load_data
from tillwise.sources.run_store import RunStore
from tillwise.sources.staging import StageArea


@dataclass
class Ingested:
    """A stored run. Its reports read staged tables until ``close``, or the end of a ``with`` block, deletes these."""

    run_id: str
    quality: CleanResult
    kpis: DataFrame
    area: StageArea

    def close(self) -> None:
        self.area.close()

    def __enter__(self) -> Ingested:
        return self

    def __exit__(self, *error) -> None:
        self.close()


@dataclass
class Analyses:
    trends: Trends
    root_cause: RootCause
    forecast: Forecast
    recommendations: DataFrame


def ingest(
    spark: SparkSession,
    csv_path: str,
    store_path: str,
    source_name: str | None = None,
    date_formats: Sequence[str] = DATE_FORMATS,
    by_type: bool = False,
    date_order_per_file: bool = False,
) -> Ingested:
    """CSV files to a stored run. The result owns the staged tables; a failure deletes them.

    ``by_type`` compares cells by the inferred type of their column; ``date_order_per_file`` lets the dates of each file decide
    between month-first and day-first. Both cost one more aggregate over the raw rows.
    """
    area = StageArea(spark)
    file = "source file" if date_order_per_file else None
    with area.collecting():
        quality = clean_sales_data(load_data(spark, csv_path, file_column=file), date_formats, by_type=by_type, file_column=file)
        kpis = calculate_kpis(quality.cleaned)
        store = RunStore(spark, store_path)
        run_id = store.save(quality.cleaned, kpis, source_name or csv_path, written=True)
    return Ingested(run_id, quality, kpis, area)


def analyze(
    sales: DataFrame, kpis: DataFrame, summary: DataFrame, metric: str = "Revenue", horizon_days: int = FORECAST_HORIZON
) -> Analyses:
    """Every analysis of cleaned lines. The lines are read once, for the roll-up that all of them start from."""
    rolled = roll_up(sales)
    return Analyses(
        trends=calculate_trends(rolled.months("Category")),
        root_cause=analyze_rolled_root_cause(rolled, metric),
        forecast=generate_forecast(rolled.days(), horizon_days),
        recommendations=generate_recommendations(sales, kpis, summary, rolled=rolled),
    )
