"""Parquet store of analysis runs: four tables, each with one folder per run.

A run writes its rows first and its ``kpi_runs`` row last. Readers only see runs that are in
``kpi_runs``, so a run that was lost half-way stays invisible. Runs write to folders of their own and do not
disturb each other.
"""

from __future__ import annotations

from datetime import datetime, timezone
from uuid import UUID, uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillwise.fixed_values import SALES_COLUMNS
from tillwise.functions.text import col
from tillwise.operators.adhoc import check_select, run_select
from tillwise.operators.cleaning import order_keys
from tillwise.operators.kpis import kpis_to_dataframe
from tillwise.operators.numbering import number_rows
from tillwise.operators.reports import run_report
from tillwise.sources.staging import stage

TABLES = {
    "kpi_runs": "created_at timestamp, source_name string, row_count long, "
    "growth_current_period string, growth_previous_period string",
    "kpi_results": "kpi_name string, kpi_value double, unit string",
    "cleaned_sales": "row_number long, sales_record string",
    "sales_data": "row_number long, Date date, Order_ID string, Customer_ID string, Product string, "
    "Category string, Revenue double, Cost double, Profit double, Quantity long",
}
SALES_TYPES = {"Date": "date", "Revenue": "double", "Cost": "double", "Profit": "double", "Quantity": "long"}


def sales_record(names: list[str]) -> Column:
    """The row as JSON text: all columns, nulls kept, dates as YYYY-MM-DD."""
    options = {"ignoreNullFields": "false", "dateFormat": "yyyy-MM-dd", "timestampFormat": "yyyy-MM-dd",
               "timestampNTZFormat": "yyyy-MM-dd"}
    return F.to_json(F.struct(*[col(name) for name in names]), options)


def typed_sales(frame: DataFrame) -> list[Column]:
    """The nine sales columns in store types; absent ones null, quantities truncated."""
    return [
        (col(name) if name in frame.columns else F.lit(None)).cast(SALES_TYPES.get(name, "string")).alias(name)
        for name in SALES_COLUMNS
    ]


class RunStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._ready = False

    def initialize(self) -> None:
        """Create the tables that do not exist yet."""
        if self._ready:
            return
        for name, kinds in TABLES.items():
            empty = self.spark.createDataFrame([], f"{kinds}, run_id string")
            empty.write.mode("ignore").partitionBy("run_id").parquet(f"{self.path}/{name}")
        self._ready = True

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"run_id string, {TABLES[name]}").parquet(f"{self.path}/{name}")

    def _write(self, name: str, run_id: str, rows: DataFrame) -> None:
        rows.write.mode("errorifexists").option("compression", "zstd").parquet(f"{self.path}/{name}/run_id={run_id}")

    def _read_run(self, name: str, run_id: str) -> DataFrame:
        """Rows of one run, without listing the folders of the others; none if it has no folder."""
        path, kinds = f"{self.path}/{name}", f"run_id string, {TABLES[name]}"
        try:
            return self.spark.read.schema(kinds).option("basePath", path).parquet(f"{path}/run_id={UUID(run_id)}")
        except ValueError:  # not an id that this store gives
            return self.spark.createDataFrame([], kinds)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], kinds)

    def save(self, cleaned: DataFrame, kpis: DataFrame, source_name: str, written: bool = False) -> str:
        """Store cleaned rows in date order, the KPIs and the run itself; returns the new run id.

        ``written`` says that ``cleaned`` only selects from a written table, as the result of cleaning does.
        """
        self.initialize()
        run_id = str(uuid4())
        kpis = stage(kpis, "kpis")
        numbered = number_rows(cleaned, order_keys(cleaned), written=written)
        self._write("sales_data", run_id, numbered.select("row_number", *typed_sales(numbered)))
        self._write(
            "cleaned_sales", run_id, numbered.select("row_number", sales_record(cleaned.columns).alias("sales_record"))
        )
        results = kpis_to_dataframe(kpis).toDF("kpi_name", "kpi_value", "unit")
        self._write("kpi_results", run_id, results.coalesce(1))
        stored = self._read_run("sales_data", run_id).agg(F.count("*"))
        run = kpis.select(
            F.lit(datetime.now(timezone.utc)).alias("created_at"),
            F.lit(source_name).alias("source_name"),
            stored.scalar().alias("row_count"),
            "growth_current_period",
            "growth_previous_period",
        )
        self._write("kpi_runs", run_id, run.coalesce(1))
        return run_id

    def table(self, name: str, run_id: str | None = None) -> DataFrame:
        """Rows of finished runs, or of one finished run (only its own folders are read)."""
        self.initialize()
        if run_id is not None:
            rows = self._read_run(name, run_id)
            return rows.where(F.lit(False)) if self._read_run("kpi_runs", run_id).isEmpty() else rows
        rows = self._read(name)
        if name == "kpi_runs":
            return rows
        return rows.join(self._read("kpi_runs").select("run_id"), "run_id", "left_semi")

    def kpi_history(self) -> DataFrame:
        """All stored KPI values, the newest run first."""
        joined = self.table("kpi_results").join(self.table("kpi_runs"), "run_id")
        return joined.orderBy(F.desc("created_at"), "run_id", "kpi_name").select(
            "created_at",
            "source_name",
            "row_count",
            "growth_current_period",
            "growth_previous_period",
            "kpi_name",
            "kpi_value",
            "unit",
            "run_id",
        )

    def run_predefined_query(self, run_id: str, query_key: str) -> DataFrame:
        return run_report(query_key, self.table("sales_data", run_id))

    def run_custom_query(self, run_id: str, text: str) -> DataFrame:
        """Ad-hoc SELECT over the four tables, with ``:run_id`` bound."""
        check_select(text)
        return run_select({name: self.table(name) for name in TABLES}, text, run_id)
