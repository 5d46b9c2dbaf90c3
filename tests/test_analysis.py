import math
from datetime import date, timedelta

import pytest
from pyspark.errors import ParseException
from pyspark.sql import functions as F

from tillwise.operators import forecast as FC, kpis as K, recommend as B, reports as R, trends as T
from tillwise.operators.adhoc import check_select, run_select
from tillwise.operators.rollup import roll_up
from tillwise.operators.root_cause import analyze_rolled_root_cause, analyze_root_cause

LINE = "Date date, Order_ID string, Customer_ID string, Product string, Category string, Revenue double, Profit double"


def test_kpis_distinct_orders_and_unknown_customers(spark):
    data = spark.createDataFrame(
        [
            (date(2026, 1, 1), "O-1", "C-1", 100, 20),
            (date(2026, 1, 2), "O-1", "Unknown", 50, 10),
            (date(2026, 2, 1), "O-2", "C-2", 225, 45),
        ],
        "Date date, Order_ID string, Customer_ID string, Revenue long, Profit long",
    )
    row = K.calculate_kpis(data).first()
    assert (row["revenue"], row["profit"], row["profit_margin"], row["average_order_value"]) == (375, 75, 20, 187.5)
    assert (row["orders"], row["customers"], row["growth_rate"]) == (2, 2, 50)
    assert (row["growth_current_period"], row["growth_previous_period"]) == ("2026-02", "2026-01")
    table = [tuple(r) for r in K.kpis_to_dataframe(K.calculate_kpis(data)).collect()]
    assert table[2] == ("Profit Margin", 20.0, "percent") and len(table) == 7


def test_kpis_edge_cases(spark, sales):
    one = spark.createDataFrame([(date(2026, 1, 1), 100)], "Date date, Revenue long")
    growth = K.calculate_monthly_growth(one).first()
    assert (growth["growth_rate"], growth["current_period"], growth["previous_period"]) == (None, "2026-01", None)
    with pytest.raises(ValueError, match="Profit"):
        K.calculate_kpis(spark.createDataFrame([(100,)], "Revenue long"))
    with pytest.raises(Exception, match="at least one cleaned sales row"):
        K.calculate_kpis(sales.where("Revenue < 0")).collect()
    odd = spark.createDataFrame(
        [(None, " o1", None, None, None, 0.0, None), (None, "o1 ", " UNKNOWN ", None, None, None, None)], LINE
    )
    row = K.calculate_kpis(odd).first()
    assert (row["revenue"], row["profit"], row["profit_margin"]) == (0.0, 0.0, None)
    assert (row["orders"], row["customers"], row["growth_current_period"]) == (1, 0, None)
    gap = spark.createDataFrame(
        [(date(2026, 1, 1), "a", "b", "p", "c", 0.0, 1.0), (date(2026, 4, 1), "a", "b", "p", "c", 5.0, 1.0)], LINE
    )
    assert K.calculate_kpis(gap).select("growth_rate", "growth_previous_period").first() == (None, "2026-01")
    assert sales.agg(K.orders(), K.customers()).first() == (6, 3)


def test_kpis_of_the_shop(shop):
    row = K.calculate_kpis(shop).first()
    assert (row["revenue"], row["profit"], row["orders"], row["customers"]) == (76000, 18400, 5, 5)
    assert row["average_order_value"] == 15200 and math.isclose(row["profit_margin"], 18400 / 76000 * 100)
    assert (row["growth_rate"], row["growth_current_period"]) == (None, "2024-01")


def test_reports(spark, sales, shop):
    first = R.top_products(sales).first()
    assert (first["Product"], first["Total_Revenue"], first["Total_Quantity"]) == ("Laptop", 2700.0, 3)
    assert [tuple(r) for r in R.monthly_revenue(sales).collect()][1] == ("2026-02", 840.0, 115.0)
    worst = [(r["Product"], r["Margin_Pct"]) for r in R.worst_products(shop).collect()]
    assert worst == [("Laptop", 20.0), ("Monitor", 25.0), ("Desk", 37.5), ("Chair", 40.0), ("Mouse", 40.0)]
    tiers = {r["Customer_ID"]: r["Customer_Segment"].split()[0] for r in R.customer_segments(shop).collect()}
    assert tiers == {"C001": "VIP", "C002": "Occasional", "C003": "Regular", "C004": "Regular", "C005": "Regular"}
    assert [r["Category"] for r in R.top_categories(shop).collect()] == ["Electronics", "Furniture"]
    assert [r["report"] for r in R.list_reports(spark).collect()] == list(R.REPORTS)
    with pytest.raises(ValueError, match="Unknown query key"):
        R.run_report("nothing", sales)


def test_segment_gap_null_keys_and_unknown(spark):
    rows = [
        (date(2026, 1, 1), "1", "gap", None, None, 14999.5, 0.0),
        (date(2026, 1, 1), "1", "top", None, None, 15000.0, 0.0),
        (date(2026, 1, 1), None, "top", None, None, 10.0, 0.0),
        (date(2026, 1, 1), "1", "Unknown", "p", None, 10.0, 0.0),
        (date(2026, 1, 1), "1", None, "p", None, None, 0.0),
    ]
    lines = spark.createDataFrame(rows, LINE)
    found = {r["Customer_ID"]: r for r in R.customer_segments(lines).collect()}
    assert set(found) == {"gap", "top"}
    assert found["gap"]["Customer_Segment"].startswith("Occasional")
    assert found["top"]["Total_Orders"] == 1 and found["top"]["Avg_Order_Value"] == 7505.0
    assert {r["Product"] for r in R.worst_products(lines).collect()} == {None, "p"}


def test_adhoc_select(spark, sales):
    tables = {"sales_data": sales.withColumn("run_id", F.lit("r1"))}
    text = "SELECT Product, SUM(Revenue) AS Revenue FROM sales_data WHERE run_id = :run_id GROUP BY Product"
    sales.limit(1).createOrReplaceTempView("sales_data")
    assert run_select(tables, text, "r1").count() == 2
    assert run_select(tables, text, "other").count() == 0
    assert spark.table("sales_data").count() == 1, "the caller's view is put back"
    spark.catalog.dropTempView("sales_data")
    nested = "SELECT (SELECT max(Revenue) FROM sales_data) AS m, (SELECT count(*) FROM sales_data) AS n"
    assert run_select(tables, nested, "r1").first()["n"] == sales.count()
    sales.createOrReplaceTempView("foreign_rows")
    for refused in (
        "SELECT * FROM foreign_rows",
        "SELECT (SELECT count(*) FROM foreign_rows) AS n FROM sales_data",
        "SELECT * FROM sales_data WHERE EXISTS (SELECT 1 FROM foreign_rows)",
        "SELECT * FROM text.`/etc/hostname`",
    ):
        with pytest.raises(ValueError, match="not part of the run store"):
            run_select(tables, refused, "r1")
    spark.catalog.dropTempView("foreign_rows")
    with pytest.raises(ValueError, match="forbidden"):
        run_select(tables, "SELECT reflect('java.lang.System', 'getProperty', 'user.dir') FROM sales_data", "r1")
    assert check_select("  select 1 ") == "select 1"
    for refused in ("INSERT INTO sales_data VALUES (1)", "WITH x AS (SELECT 1) SELECT * FROM x"):
        with pytest.raises(ValueError, match="SELECT"):
            check_select(refused)
    for refused in ("SELECT * FROM sales_data; DROP TABLE sales_data;", "SELECT created_at FROM kpi_runs"):
        with pytest.raises(ValueError, match="forbidden"):
            check_select(refused)


@pytest.mark.parametrize(
    "text, rows",
    [
        ("SELECT * FROM (WITH x AS (SELECT * FROM sales_data), y AS (SELECT * FROM x) SELECT * FROM y)", 6),
        ("SELECT Product FROM SALES_DATA UNION ALL SELECT Category FROM sales_data", 12),
        ("SELECT Product, sum(Revenue) r FROM sales_data GROUP BY ALL HAVING r > 1000 ORDER BY r DESC LIMIT 5 OFFSET 0", 1),
        ("SELECT rank() OVER w FROM sales_data WINDOW w AS (PARTITION BY Product ORDER BY Revenue)", 6),
        ("SELECT /*+ BROADCAST(b) */ a.Product FROM sales_data a JOIN sales_data b USING (Order_ID)", 6),
        ("SELECT e FROM sales_data LATERAL VIEW explode(array(1, 2)) t AS e", 12),
        ("SELECT (SELECT count(*) FROM VALUES (1), (2) AS v(k)) AS n, CASE WHEN 1 IN (SELECT 1) THEN 'drops' END", None),
        ("SELECT * FROM sales_data TABLESAMPLE (100 PERCENT) INTERSECT SELECT * FROM sales_data", 6),
    ],
)
def test_gate_allows(spark, sales, text, rows):
    if rows is None:  # the word is refused wherever it stands
        with pytest.raises(ValueError, match="DROP"):
            run_select({"sales_data": sales}, text, "r")
    else:
        assert run_select({"sales_data": sales}, text, "r").count() == rows


@pytest.mark.parametrize(
    "text, reason",
    [
        ("SELECT * FROM range(10)", "not allowed"),
        ("SELECT * FROM sales_data, LATERAL explode(array(1))", "not allowed"),
        ("SELECT * FROM IDENTIFIER('foreign' || '_rows')", "not allowed"),
        ("SELECT IDENTIFIER('ref' || 'lect')('java.lang.System', 'getProperty', 'user.dir')", "not allowed"),
        ("SELECT IDENTIFIER('ref' 'lect')('java.lang.System', 'getProperty', 'user.dir')", "not allowed|forbidden"),
        ("SELECT TRANSFORM(Product) USING 'cat' FROM sales_data", "not allowed"),
        ("SELECT * FROM (WITH x AS (SELECT * FROM x) SELECT * FROM x)", "not part"),
        ("SELECT * FROM (WITH y AS (SELECT * FROM x), x AS (SELECT 1) SELECT * FROM y)", "not part"),
        ("SELECT * FROM (WITH x AS (SELECT 1) SELECT * FROM x) JOIN x", "not part"),
        ("SELECT * FROM (WITH x AS (SELECT (SELECT 1 FROM foreign_rows)) SELECT * FROM x)", "not part"),
        ("SELECT count(*) FROM sales_data ORDER BY (SELECT 1 FROM foreign_rows)", "not part"),
        ("SELECT sum(CASE WHEN 1 IN (SELECT 1 FROM foreign_rows) THEN 1 END) FROM sales_data", "not part"),
        ("SELECT * FROM default.sales_data", "not part"),
        ("SELECT * FROM (TABLE foreign_rows)", "not part"),
        ("SELECT * FROM sales_data; SELECT 1", "."),
    ],
)
def test_gate_refuses(spark, sales, text, reason):
    sales.createOrReplaceTempView("foreign_rows")
    sales.createOrReplaceTempView("x")
    try:
        with pytest.raises((ValueError, ParseException), match=reason):
            run_select({"sales_data": sales}, text, "r")
    finally:
        spark.catalog.dropTempView("foreign_rows")
        spark.catalog.dropTempView("x")


def _rows(frame):
    return sorted(
        (tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in frame.collect()),
        key=repr,
    )


@pytest.mark.parametrize("without", [[], ["Category"], ["Date"], ["Customer_ID", "Product"], ["Revenue"]])
def test_rolled_analyses_equal_those_of_lines(spark, sales, without):
    odd = [
        (None, "O7", "C1", "Laptop", "Electronics", 10.0, 1.0, 9.0, 1.0),
        (date(2026, 3, 2), "O8", None, None, None, 5.0, 9.0, -4.0, 1.0),
        (date(2026, 3, 2), "O9", "Unknown", "Cable", "", None, None, None, None),
        (date(2026, 3, 3), "O9", "C2", "Cable", "Parts", -700.0, 1.0, -701.0, 1.0),
    ]
    lines = sales.unionByName(spark.createDataFrame(odd, sales.schema)).drop(*without)
    rolled = roll_up(lines)
    for metric in ("Revenue", "Profit"):
        plain, summed = analyze_root_cause(lines, metric), analyze_rolled_root_cause(rolled, metric)
        for part in ("summary", "contributors", "top", "explanations"):
            assert _rows(getattr(summed, part)) == _rows(getattr(plain, part)), part
    plain, summed = T.calculate_trends(lines), T.calculate_trends(rolled.months("Category"))
    for part in ("monthly", "quarterly", "yearly", "best_worst", "fastest_category", "insights"):
        assert _rows(getattr(summed, part)) == _rows(getattr(plain, part)), part
    plain, summed = FC.generate_forecast(lines, 3), FC.generate_forecast(rolled.days(), 3)
    for part in ("rows", "metrics", "status"):
        assert _rows(getattr(summed, part)) == _rows(getattr(plain, part)), part
    if not without:
        summary = spark.range(1).selectExpr("2 AS duplicate_rows_removed", "0 AS invalid_dates_found")
        how = dict(product_share=0.01, customer_share_pct=0.1)
        plain = B.generate_recommendations(lines, K.calculate_kpis(lines), summary, **how)
        assert _rows(B.generate_recommendations(lines, K.calculate_kpis(lines), summary, rolled=rolled, **how)) == _rows(plain)


def test_roll_up_is_the_only_reader_of_the_lines(spark, sales, tmp_path):
    sales.write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    rolled = roll_up(lines)
    assert rolled.rows.count() == len(rolled.rows.distinct().collect())
    frames = [*vars(T.calculate_trends(rolled.months("Category"))).values(), FC.generate_forecast(rolled.days()).rows]
    frames.append(analyze_rolled_root_cause(rolled).contributors)
    assert not {file for frame in frames for file in frame.inputFiles()} & set(lines.inputFiles())
    assert roll_up(lines.limit(0)).rows.isEmpty()


def test_trends(sales):
    trends = T.calculate_trends(sales)
    months = [tuple(r) for r in trends.monthly.collect()]
    assert [m[0] for m in months] == ["2026-01", "2026-02", "2026-03"]
    assert months[0][3] is None and math.isclose(months[1][3], -20.0) and math.isclose(months[2][3], 12.5)
    assert trends.quarterly.first()["Quarter_Period"] == "2026Q1"
    assert trends.yearly.first()["Year_Period"] == "2026"
    assert tuple(trends.best_worst.first()) == ("2026-01", 1050.0, "2026-02", 840.0)
    fastest = trends.fastest_category.first()
    assert fastest[0] == "Electronics" and math.isclose(fastest[1], 12.5)
    assert [r["insight"] for r in trends.insights.collect()] == [
        "Revenue increased by 12.5% in the latest month (2026-03) compared to the previous month (2026-02) "
        "($945.00 vs $840.00).",
        "Net Profit increased by 182.6% in the latest month ($325.00 vs $115.00).",
        "Peak sales occurred in 2026-01 with total revenue of $1,050.00.",
        "Fastest-growing category is **Electronics** with a Month-over-Month growth rate of **12.5%**.",
    ]


def test_trend_edges(spark):
    rows = [
        (date(2025, 12, 1), "1", "c", "p", "B", 20.0, 0.0),
        (date(2025, 12, 1), "1", "c", "p", "A", 20.0, 0.0),
        (date(2025, 12, 1), "1", "c", "p", "tiny", 9.99, 0.0),
        (date(2026, 2, 1), "1", "c", "p", "B", 30.0, 4.0),
        (date(2026, 2, 1), "1", "c", "p", "A", 30.0, 4.0),
        (date(2026, 2, 1), "1", "c", "p", "tiny", 900.0, 0.0),
        (date(2026, 2, 1), "1", "c", "p", None, 5000.0, 0.0),
        (None, "1", "c", "p", "A", 1e6, 0.0),
    ]
    lines = spark.createDataFrame(rows, LINE)
    assert tuple(T.fastest_growing_category(lines).first()) == ("A", 50.0)
    assert [r["MoM_Profit_Growth"] for r in T.monthly_trend(lines).collect()] == [None, None]
    assert "Net Profit increased by 0.0%" in T.trend_insights(lines).collect()[1]["insight"]
    none = T.calculate_trends(lines.where("Date is null"))
    assert none.monthly.count() == none.best_worst.count() == none.insights.count() == 0
    assert T.calculate_trends(lines.drop("Date")).monthly.columns[0] == "Month_Period"


def test_root_cause_of_a_decline(sales):
    found = analyze_root_cause(sales.where("Date < '2026-03-01'"))
    summary = found.summary.first()
    assert summary["drop_detected"] and summary["total_change"] == -210.0 and summary["status"] == "decline"
    assert (summary["previous_month"], summary["current_month"]) == ("2026-01", "2026-02")
    rows = {(r["dimension"], r["member"]): r for r in found.contributors.collect()}
    assert rows["Product", "Laptop"]["change"] == -200.0 and len(rows) == 5
    assert {key: row["rank"] for key, row in rows.items()} == {
        ("Category", "Electronics"): 1, ("Customer_ID", "C1"): 1, ("Customer_ID", "C2"): 2, ("Product", "Laptop"): 1, ("Product", "Mouse"): 2
    }
    assert math.isclose(rows["Product", "Laptop"]["contribution_pct"], 200 / 210 * 100)
    top = {r["dimension"]: r["member"] for r in found.top.collect()}
    assert top == {"Category": "Electronics", "Product": "Laptop", "Customer_ID": "C1"}
    texts = [r["explanation"] for r in found.explanations.collect()]
    assert texts[0] == "Overall Revenue declined by **20.0%** (-$210.00) from 2026-01 ($1,050.00) to 2026-02 ($840.00)."
    assert texts[3].startswith("Within **Customer_ID**, the largest drag was **Customer 'C1'**.")


def test_root_cause_other_states(spark, sales):
    up = analyze_root_cause(sales)
    assert up.summary.first()["status"] == "no_decline" and up.contributors.count() == 0
    assert up.explanations.first()["explanation"] == (
        "No decline detected! Overall Revenue increased by **12.5%** from 2026-02 to 2026-03 (+$105.00)."
    )
    short = analyze_root_cause(sales.where("Date < '2026-02-01'"), "Profit")
    assert short.summary.first()["status"] == "one_month" and short.summary.first()["current_month"] == "2026-01"
    assert analyze_root_cause(sales.drop("Date")).summary.first()["status"] == "no_data"
    with pytest.raises(ValueError, match="only supported"):
        analyze_root_cause(sales, "Cost")
    rows = [
        (date(2026, 1, 1), "1", None, "p", "Unknown", 100.0, 0.0),
        (date(2026, 1, 1), "1", "c", "q", "Unknown", 50.0, 0.0),
        (date(2026, 2, 1), "1", "c", "r", "Unknown", 80.0, 0.0),
    ]
    found = analyze_root_cause(spark.createDataFrame(rows, LINE)).contributors.collect()
    assert [(r["dimension"], r["member"], r["change"]) for r in found] == [
        ("Category", "Unknown", -70.0), ("Product", "p", -100.0), ("Product", "q", -50.0)
    ]


def test_ranks_of_very_many_members_with_ties(spark):
    rows = [(date(2026, m, 1), "1", f"c{k:04d}", "p", "x", 10.0 if m == 1 else float(k % 3), 0.0) for k in range(2000) for m in (1, 2)]
    found = analyze_root_cause(spark.createDataFrame(rows, LINE)).contributors.where("dimension = 'Customer_ID'").collect()
    want = sorted((k % 3 - 10.0, f"c{k:04d}") for k in range(2000))
    assert [(r["rank"], r["change"], r["member"]) for r in found] == [(n, *row) for n, row in enumerate(want, 1)]


def test_forecast_of_the_shop(shop):
    made = FC.generate_forecast(shop)
    rows = made.rows.collect()
    history = [r for r in rows if r["Type"] == "Historical"]
    future = sorted((r for r in rows if r["Type"] == "Forecast"), key=lambda r: r["Date"])
    assert (len(history), len(future)) == (6, 30)
    assert sum(r["Forecast_MA"] is not None for r in history) == 1
    expected = [15200, 15200, 15200, 10228.571428571428, 11546.938775510204]
    assert all(math.isclose(r["Forecast_MA"], e) for r, e in zip(future, expected))
    assert all(r["Forecast_LR"] == 0 for r in future) and future[0]["Date"] == date(2024, 1, 6)
    metrics = made.metrics.first()
    assert math.isclose(metrics["slope"], -6900) and math.isclose(metrics["intercept"], 29000)
    assert metrics["average_historical_daily"] == 15200
    assert (metrics["window_days"], metrics["window_average"]) == (5, 15200)
    none = FC.generate_forecast(shop, 0)
    assert none.rows.where("Type = 'Forecast'").count() == 0 and none.rows.count() == 6
    assert none.metrics.first()["horizon_total_ma"] == 0.0
    with pytest.raises(ValueError, match="negative"):
        FC.generate_forecast(shop, -1)


@pytest.mark.parametrize("days", [4, 5, 13, 14, 20])
def test_forecast_against_brute_force(spark, days):
    values = [float((n * 7919) % 100) for n in range(days)]
    start = date(2026, 1, 1)
    # every third day has no sales but the first and last
    sold = [n for n in range(days) if n % 3 != 1 or n in (0, days - 1)]
    full = [values[n] if n in sold else 0.0 for n in range(days)]
    rows = [(start + timedelta(days=n), "k", values[n]) for n in sold] + [(None, "k", 1.0), (start, None, 5.0)]
    lines = spark.createDataFrame(rows, "Date date, Product string, Revenue double")
    made = FC.generate_forecast(lines, 9, "Product")
    future = sorted((r for r in made.rows.collect() if r["Type"] == "Forecast"), key=lambda r: r["Date"])
    status = made.status.collect()
    assert [r["series"] for r in status] == ["k"]
    if len(sold) < 5:
        assert future == [] and "5 unique days" in status[0]["status"] and made.metrics.count() == 0
        return
    window = 14 if days >= 14 else 7
    walk = list(full)
    for _ in range(9):
        part = walk[-window:]
        walk.append(sum(part) / len(part))
    mean_x, mean_y = (days - 1) / 2, sum(full) / days
    slope = sum((x - mean_x) * (y - mean_y) for x, y in enumerate(full)) / sum((x - mean_x) ** 2 for x in range(days))
    line = [max(0.0, mean_y + slope * (x - mean_x)) for x in range(days, days + 9)]
    assert [r["Forecast_MA"] for r in future] == pytest.approx(walk[days:])
    assert [r["Forecast_LR"] for r in future] == pytest.approx(line)


def test_recommendations(spark, sales, shop):
    kpis = spark.createDataFrame([(1000.0, 5.0)], "revenue double, profit_margin double")
    summary = spark.createDataFrame([(5, 1)], "duplicate_rows_removed long, invalid_dates_found long")
    rows = B.generate_recommendations(sales, kpis, summary).collect()
    assert [(r["rule_no"], r["priority"]) for r in rows] == [
        (1, "Medium"), (3, "Medium"), (4, "High"), (5, "Low"), (6, "Low")
    ]
    assert rows[0]["trigger_reason"] == "Overall profit margin is currently low at 5.0%."
    assert rows[1]["trigger_reason"].startswith("Laptop is a critical revenue driver representing 270.0%")
    assert B.generate_recommendations(sales.where("Revenue < 0"), kpis, summary).count() == 0
    clean = spark.createDataFrame([(0, 0)], "duplicate_rows_removed long, invalid_dates_found long")
    found = B.generate_recommendations(shop, K.calculate_kpis(shop), clean).collect()
    assert [r["title"] for r in found] == [
        "Increase Inventory Buffer for High-Seller: Laptop",
        "Mitigate Customer Concentration Risk (Customer: C001)",
    ]
    losing = sales.withColumn("Profit", F.when(F.col("Product") == "Mouse", -1.0).otherwise(F.col("Profit")))
    loss = B.loss_products(B.product_totals(losing)).collect()
    assert loss[0]["trigger_reason"] == "Product 'Mouse' operates at a net loss (Margin: -2.2%, Profit: -$3.00)."


def test_member_totals_equal_the_separate_sums(spark):
    rows = [("P", "a", 1.0, -2.0), ("P", "b", 2.0, None), (None, "a", 4.0, 1.0), ("Q", "Unknown", 8.0, 1.0), ("R", None, None, 3.0)]
    sales = spark.createDataFrame(rows, "Product string, Customer_ID string, Revenue double, Profit double")
    totals = B.member_totals(sales)
    assert sorted(B.products_of(totals).collect()) == sorted(B.product_totals(sales).collect())
    assert sorted(B.customers_of(totals).collect()) == sorted(B.customer_totals(sales).collect())
    assert B.member_totals(sales.limit(0)).isEmpty() and B.member_totals(sales.select("Revenue").limit(0)).isEmpty()
    assert sorted(B.customers_of(B.member_totals(sales.drop("Product", "Profit"))).collect()) == [("a", 5.0), ("b", 2.0)]
