import json
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tillwise.operators import kpis as K, star as S
from tillwise.operators.numbering import number_rows
from tillwise.operators.profile import (
    build_column_report,
    check_duplicates,
    check_missing_values,
    generate_quality_report,
    quality_score,
    validate_dates,
)
from tillwise.plans.analysis import analyze, ingest
from tillwise.sources.csv_files import load_data, write_csv
from tillwise.session import shared_dir
from tillwise.sources.run_store import RunStore


def test_store_keeps_runs_apart(spark, sales, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    assert store.kpi_history().count() == 0
    small = spark.createDataFrame(
        [(date(2026, 1, 1), "O-1", "C-1", 100, 20, 1.9), (date(2026, 2, 1), "O-2", "C-2", 150, None, None)],
        "Date date, Order_ID string, Customer_ID string, Revenue long, Profit long, Quantity double",
    )
    first = store.save(small, K.calculate_kpis(small), "small.csv")
    second = store.save(sales, K.calculate_kpis(sales), "sales.csv")
    assert first != second
    assert [store.table(name, first).count() for name in ("cleaned_sales", "sales_data", "kpi_results")] == [2, 2, 7]
    history = store.kpi_history().collect()
    assert len(history) == 14 and history[0]["source_name"] == "sales.csv" and history[0]["row_count"] == 6
    assert [r["kpi_name"] for r in history[:7]] == sorted(r["kpi_name"] for r in history[:7])
    rows = store.table("sales_data", first).orderBy("row_number").collect()
    assert [(r["row_number"], r["Date"], r["Product"], r["Quantity"]) for r in rows] == [
        (1, date(2026, 1, 1), None, 1), (2, date(2026, 2, 1), None, None)
    ]
    record = json.loads(store.table("cleaned_sales", first).orderBy("row_number").collect()[1]["sales_record"])
    assert record == {"Date": "2026-02-01", "Order_ID": "O-2", "Customer_ID": "C-2", "Revenue": 150, "Profit": None,
                      "Quantity": None}
    assert list(record) == small.columns

    top = store.run_predefined_query(second, "top_products").first()
    assert (top["Product"], top["Total_Revenue"]) == ("Laptop", 2700.0)
    text = "SELECT Product, SUM(Revenue) AS Revenue FROM sales_data WHERE run_id = :run_id GROUP BY Product"
    assert store.run_custom_query(second, text).count() == 2
    with pytest.raises(ValueError, match="forbidden"):
        store.run_custom_query(second, "SELECT * FROM sales_data; DROP TABLE sales_data;")

    # A run without its kpi_runs row was never finished.
    store._read("sales_data").where(F.col("run_id") == first).drop("run_id").write.parquet(
        f"{store.path}/sales_data/run_id=lost"
    )
    assert store.table("sales_data").count() == 8 and store.table("sales_data", "lost").count() == 0


def test_numbers_are_gapless_with_a_hot_row(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("a"), F.lit("x").alias("b")
    )
    numbered = number_rows(rows.repartition(5), ["a"]).collect()
    assert sorted(r["row_number"] for r in numbered) == list(range(1, 3001))
    assert [r["a"] for r in sorted(numbered, key=lambda r: r["row_number"])] == sorted(r["a"] for r in rows.collect())


def test_csv_in_and_out(spark, tmp_path):
    text = 'Date,Order ID,revenue,note\n2026-01-01,O1,"$1,000","a ""b"", c"\n2026-01-02,NA,null, \n'
    (tmp_path / "in.csv").write_text(text, encoding="utf-8")
    raw = load_data(spark, str(tmp_path / "in.csv"))
    assert [tuple(r) for r in raw.collect()] == [
        ("2026-01-01", "O1", "$1,000", 'a "b", c'), ("2026-01-02", None, None, " ")
    ]
    (tmp_path / "breaks.csv").write_text('Date,note\n2026-01-01,"a\nb"\n', encoding="utf-8")
    assert load_data(spark, str(tmp_path / "breaks.csv"), line_breaks_in_cells=True).first()["note"] == "a\nb"
    frame = spark.createDataFrame([(date(2026, 1, 1), 100, 'a "b", c', None)], "Date date, Revenue long, t string, e string")
    write_csv(frame.coalesce(1), str(tmp_path / "out"))
    written = next((tmp_path / "out").glob("part-*.csv")).read_text(encoding="utf-8")
    assert written == 'Date,Revenue,t,e\n2026-01-01,100,"a ""b"", c",\n'


def test_csv_lines_that_do_not_fit(spark, tmp_path):
    (tmp_path / "long.csv").write_text("Date,Order_ID,Revenue\n2026-01-01,O1,5\n2026-01-02,O2,1,234.50\n")
    (tmp_path / "quote.csv").write_text('Date,Order_ID,note\n2026-01-01,O1,"a\nb"\n')
    for name in ("long.csv", "quote.csv"):
        frame = load_data(spark, str(tmp_path / name), line_breaks_in_cells=False)
        for act in (frame.collect, frame.count):
            with pytest.raises(Exception, match="more cells than the header"):
                act()
    (tmp_path / "short.csv").write_text('Date,Order_ID,Revenue\n2026-01-01,"O,1"\n2026-01-02,O2,5\n')
    short = load_data(spark, str(tmp_path / "short.csv"))
    assert [tuple(r) for r in short.collect()] == [("2026-01-01", "O,1", None), ("2026-01-02", "O2", "5")]
    assert short.count() == 2


def test_csv_files_with_other_column_orders(spark, tmp_path):
    for name, text in (("a", "Date,Order ID,Revenue,Cost\n2026-01-01,O1,9,4\n"), ("b", "order_id,date,cost,revenue\nO2,2026-01-02,1,2\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.csv").write_text(text)
    rows = load_data(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).orderBy("Order_ID").collect()
    assert [(r["Date"], r["Order_ID"], r["Revenue"], r["Cost"]) for r in rows] == [
        ("2026-01-01", "O1", "9", "4"), ("2026-01-02", "O2", "2", "1")
    ]
    (tmp_path / "a" / "y.csv").write_text("Order ID,Date,Revenue,Cost\nO3,2026-01-03,1,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        load_data(spark, str(tmp_path / "a")).collect()


def test_whole_job(spark, tmp_path):
    (tmp_path / "in.csv").write_text(
        "date,ORDER-ID,Customer Id,product,category,revenue,cost,profit,quantity\n"
        + "".join(f"2026-0{m}-{d:02d},O{m}{d},C{d % 3},P{d % 2},K,{100 - m * 10 + d},50,,1\n" for m in (1, 2) for d in range(1, 9)),
        encoding="utf-8",
    )
    done = ingest(spark, str(tmp_path / "in.csv"), str(tmp_path / "store"), "in.csv")
    sales = RunStore(spark, str(tmp_path / "store")).table("sales_data", done.run_id)
    results = analyze(sales, done.kpis, done.quality.summary, horizon_days=5)
    assert results.trends.monthly.count() == 2
    assert results.root_cause.summary.first()["status"] == "decline"
    assert results.forecast.rows.where("Type = 'Forecast'").count() == 5
    assert [r["rule_no"] for r in results.recommendations.collect()][0] == 3
    staged = Path(done.area.path)
    assert any(staged.iterdir()) and not any(staged.glob("unordered-*"))
    done.close()
    assert not staged.exists() and sales.count() == 16


def test_a_failed_job_leaves_no_staged_tables(spark, tmp_path):
    (tmp_path / "in.csv").write_text("Date,Revenue\n2026-01-01,5\n")
    (tmp_path / "store").write_text("no folder")
    place = Path(shared_dir(spark).removeprefix("file:")) / "tillwise-stage"
    before = set(place.glob("job-*"))
    with pytest.raises(Exception):
        ingest(spark, str(tmp_path / "in.csv"), str(tmp_path / "store"))
    assert set(place.glob("job-*")) == before


def test_unfinished_and_unknown_runs_are_empty(spark, sales, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    run_id = store.save(sales, K.calculate_kpis(sales), "sales.csv")
    half = "00000000-0000-0000-0000-000000000001"
    store._write("sales_data", half, store.table("sales_data", run_id).drop("run_id"))
    for unknown in (half, "00000000-0000-0000-0000-000000000002", "*", ""):
        assert store.table("sales_data", unknown).count() == 0
    assert store.table("sales_data", run_id).count() == store.table("sales_data").count() == 6


def test_profile(spark):
    rows = [("2026-01-01", 1.0), ("2026-01-01", 1.0), ("bad", None), (None, float("nan")), ("bad", None)]
    frame = spark.createDataFrame(rows, "Date string, v double")
    assert [tuple(r) for r in check_missing_values(frame).collect()] == [("Date", 1), ("v", 3)]
    assert check_duplicates(frame).first()[0] == 2
    assert validate_dates(frame).first()[0] == 3 and validate_dates(frame.select("v")).first()[0] == 0
    assert [tuple(r) for r in generate_quality_report(frame).collect()] == [
        ("Total Rows", None, 5), ("Missing Values", "Date", 1), ("Missing Values", "v", 3),
        ("Duplicate Rows", None, 2), ("Invalid Dates", None, 3),
    ]
    assert quality_score(frame).first()[0] == 60.0 and quality_score(frame.limit(0)).first()[0] == 0.0
    report = build_column_report(frame, frame.select("v", F.lit(1).alias("w"))).collect()
    assert [tuple(r) for r in report] == [("Date", "void", 1, 0, 0), ("v", "double", 3, 3, 1), ("w", "int", 0, 0, 1)]


def test_star(spark, sales):
    assert S.dim_products(sales).count() == 2 and S.dim_customers(sales).count() == 3
    joined = S.fact_sales(sales).join(S.dim_products(sales), "Product_ID")
    assert joined.count() == 6
    odd = spark.createDataFrame([("A|=B", "C"), ("A", "B|=C"), (None, "C"), ("-", "C")], "Product string, Category string")
    assert S.dim_products(odd).select("Product_ID").distinct().count() == 4
    calendar = S.dim_calendar(sales).orderBy("Date").collect()
    assert len(calendar) == 74 and tuple(calendar[0])[1:] == (2026, 1, 1, "January", "Thursday")
    row = S.star_measures(S.fact_sales(sales)).first()
    assert (row["total_revenue"], row["total_cost"], row["total_profit"], row["total_orders"]) == (2835, 2175, 660, 6)
    empty = S.star_measures(S.fact_sales(sales.where("Revenue < 0"))).first()
    assert (empty["profit_margin"], empty["average_order_value"], empty["total_orders"]) == (0.0, 0.0, 0)
    gap = sales.where("Date < '2026-02-01' or Date >= '2026-03-01'")
    months = S.mom_growth(gap).orderBy("Month").collect()
    assert [(r["Month"], r["revenue"], r["mom_growth"]) for r in months] == [
        ("2026-01", 1050.0, 0.0), ("2026-02", None, -1.0), ("2026-03", 945.0, 0.0)
    ]
    ytd = {r["Date"]: r["revenue_ytd"] for r in S.revenue_ytd(sales).collect()}
    assert len(ytd) == 74 and ytd[date(2026, 1, 14)] == 1000.0 and ytd[date(2026, 3, 15)] == 2835.0
