import random
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tillwise.operators import medians as M, profile as P
from tillwise.operators.cleaning import clean_data, clean_sales_data, in_date_order, standardize_column_names
from tillwise.sources.staging import stage


def raw(spark, rows, *names):
    return spark.createDataFrame(rows, StructType([StructField(name, StringType()) for name in names]))


def test_common_problems(spark):
    source = raw(
        spark,
        [
            ("2026-01-01", "O-1", "Laptop", "$1,000", "700", None),
            ("bad-date", "O-2", "Phone", "500", "300", "200"),
            ("2026-01-03", "O-3", None, None, "100", None),
            ("2026-01-03", "O-3", None, None, "100", None),
        ],
        " date ", "order id", "Product", "Revenue", "Cost", "Profit",
    )
    result = clean_sales_data(source)
    rows = in_date_order(result.cleaned).collect()
    assert [r["Order_ID"] for r in rows] == ["O-1", "O-3"]
    assert [r["Product"] for r in rows] == ["Laptop", "Unknown"]
    assert [r["Revenue"] for r in rows] == [1000.0, 1000.0]
    assert [r["Profit"] for r in rows] == [300.0, 900.0]
    summary = result.summary.first()
    assert (summary["rows_before"], summary["rows_after"], summary["columns"]) == (4, 2, 6)
    assert (summary["duplicate_rows_removed"], summary["invalid_dates_found"]) == (1, 1)
    assert (summary["missing_values_before"], summary["missing_values_after"]) == (7, 0)
    assert (summary["quality_score_before"], summary["quality_score_after"]) == (70.8, 100.0)
    assert summary["missing_expected_columns"] == ["Customer_ID", "Category", "Quantity"]
    assert [r["message"] for r in result.actions.orderBy("step").collect()] == [
        "Removed 1 duplicate rows.",
        "Removed 1 rows with invalid dates.",
        "Filled 1 empty Revenue rows with median (1,000.00).",
        "Derived 2 missing Profit values as Revenue - Cost.",
        "Replaced 1 empty Product values with 'Unknown'.",
        "Optional expected columns missing: Customer_ID, Category, Quantity",
    ]
    report = {r["Column"]: r for r in result.column_report.collect()}
    assert report["Profit"]["Missing Before"] == 3 and report["Profit"]["Missing After"] == 0
    assert report["Revenue"]["Unique Values After"] == 1
    assert report["Date"]["Data Type After Cleaning"] == "date"


def test_numbers_signs_and_medians(spark):
    cells = ["$ 100", "(100)", "1.5d", "1e3", "inf", "-20", " 1,200.50 ", "None", "nan", "", "5", None, "+7."]
    source = raw(spark, [("2026-01-01", str(i), c) for i, c in enumerate(cells)], "Date", "Order_ID", "Quantity")
    rows = clean_data(source).orderBy(F.col("Order_ID").cast("int")).collect()
    values = [r["Quantity"] for r in rows]
    known = {0: 100.0, 3: 1000.0, 5: 20.0, 6: 1200.5, 10: 5.0, 12: 7.0}
    median = statistics.median(known.values())
    assert values == [known.get(i, median) for i in range(len(cells))]


def test_profit_keeps_sign_and_uses_median_without_cost(spark):
    source = raw(
        spark, [("2026-01-01", "a", "-5"), ("2026-01-02", "b", None), ("2026-01-03", "c", "15")],
        "Date", "Order_ID", "Profit",
    )
    assert [r["Profit"] for r in in_date_order(clean_data(source)).collect()] == [-5.0, 5.0, 15.0]


def test_all_null_number_becomes_zero(spark):
    source = raw(spark, [("2026-01-01", "x"), ("2026-01-02", None)], "Date", "Cost")
    assert [r["Cost"] for r in clean_data(source).collect()] == [0.0, 0.0]


def test_dates_and_formats(spark):
    cells = ["2026-1-5", "2026-01-06", "01/02/2026", "2026-01-03 10:00", None, " 2026-02-01 "]
    source = raw(spark, [(c, str(i)) for i, c in enumerate(cells)], "Date", "Order_ID")
    found = {r["Order_ID"]: str(r["Date"]) for r in clean_data(source).collect()}
    assert found == {"0": "2026-01-05", "1": "2026-01-06", "2": "2026-01-02", "3": "2026-01-03", "5": "2026-02-01"}
    narrow = clean_sales_data(source, ["yyyy-M-d"])
    assert sorted(r["Order_ID"] for r in narrow.cleaned.collect()) == ["0", "1", "5"]
    summary = narrow.summary.first()
    assert summary["invalid_dates_found"] == 2 and summary["rows_after"] == 3
    times = raw(spark, [("2026-01-06T00:00:00",), ("2026-01-07 10:00:01.25",), ("31/01/2026",)], "Date")
    assert [str(r["Date"]) for r in in_date_order(clean_data(times)).collect()] == ["2026-01-06", "2026-01-07"]
    day_first = clean_data(times, ["d/M/yyyy"])
    assert [str(r["Date"]) for r in day_first.collect()] == ["2026-01-31"]


def test_plain_numbers_are_compared_by_value(spark):
    plain = raw(spark, [("2026-01-01", "1"), ("2026-01-01", "1.0"), ("2026-01-01", None)], "Date", "Revenue")
    mixed = raw(spark, [("2026-01-01", "1"), ("2026-01-01", "1.0"), ("2026-01-01", "$2")], "Date", "Revenue")
    assert clean_sales_data(plain).summary.first()["duplicate_rows_removed"] == 1
    zero = raw(spark, [("2026-01-01", "0.00"), ("2026-01-01", "-0.00"), ("2026-01-01", "1.50")], "Date", "Profit")
    assert clean_sales_data(zero).summary.first()["duplicate_rows_removed"] == 1
    assert clean_sales_data(mixed).summary.first()["duplicate_rows_removed"] == 0


def test_duplicates_are_found_before_trimming(spark):
    source = raw(spark, [("2026-01-01", "A"), ("2026-01-01", " A"), ("2026-01-01", "A")], "Date", "Product")
    result = clean_sales_data(source)
    assert result.summary.first()["duplicate_rows_removed"] == 1
    assert [r["Product"] for r in result.cleaned.collect()] == ["A", "A"]


def test_extra_columns_and_missing_date(spark):
    source = raw(spark, [("1", " hi "), ("2", "   "), ("3", None)], "revenue", "my.note 'x'")
    result = clean_sales_data(source)
    rows = result.cleaned.orderBy("Revenue").collect()
    assert [r["my.note 'x'"] for r in rows] == ["hi", None, None]
    summary = result.summary.first()
    assert (summary["missing_values_before"], summary["missing_values_after"]) == (1, 2)
    assert result.actions.orderBy("step").first()["message"] == "Date column not supplied; date validation skipped."


def test_nan_is_missing(spark):
    source = spark.createDataFrame(
        [("2026-01-01", float("nan")), ("2026-01-02", 4.0)], "Date string, Revenue double"
    )
    result = clean_sales_data(source)
    assert result.summary.first()["missing_values_before"] == 1
    assert [r["Revenue"] for r in result.cleaned.collect()] == [4.0, 4.0]


def test_refusals(spark):
    with pytest.raises(ValueError, match="does not contain any data rows"):
        clean_sales_data(raw(spark, [], "Date", "Revenue"))
    with pytest.raises(ValueError, match="Revenue"):
        standardize_column_names(raw(spark, [("1", "2")], "revenue", "Re venue"))


@pytest.mark.parametrize("size", [1, 2, 3, 10, 501])
def test_exact_medians_against_brute_force(spark, size):
    pick = random.Random(size)
    rows = [
        (pick.choice([7.0, pick.uniform(-1e9, 1e9), pick.gauss(0, 1e-3)]), float(pick.randint(0, 3)), None)
        for _ in range(size)
    ]
    frame = spark.createDataFrame(rows, "a double, b double, c double")
    found = M.exact_medians(frame, {n: F.col(n) for n in "abc"})
    assert found == {
        "a": statistics.median(r[0] for r in rows), "b": statistics.median(r[1] for r in rows), "c": None
    }


def test_median_rounds_with_few_slices(spark, monkeypatch):
    """A hot value, extreme outliers and narrow slices still end at the exact value."""
    monkeypatch.setattr(M, "SLICES", 3)
    values = [1e12, -1e12] + [0.1] * 40 + [0.2] * 41 + [3.5] * 2
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    assert M.exact_medians(frame, {"v": F.col("v")})["v"] == statistics.median(values)


def test_medians_only_when_asked_for(spark, monkeypatch):
    source = raw(spark, [("2026-01-01", str(i), None if i % 4 == 0 else str(i * i)) for i in range(1, 200)], "Date", "Order_ID", "Quantity")
    exact = clean_sales_data(source)
    sketched = clean_sales_data(source, sketched_medians=True)
    known = sorted(float(i * i) for i in range(1, 200) if i % 4)
    assert exact.fills["Quantity"] == statistics.median(known)
    assert sketched.fills["Quantity"] in known[len(known) // 2 - 1 : len(known) // 2 + 1]
    monkeypatch.setattr("tillwise.operators.cleaning.exact_medians", lambda *_: pytest.fail("no median is needed"))
    assert clean_sales_data(source).summary.first()["missing_values_before"] == 49


@pytest.mark.parametrize("repeats", [0, 1, 1000])
def test_distinct_rows_by_fingerprint(spark, repeats):
    rows = [("a", None), (None, "a"), ("a", None), ("", None), (None, None), (None, None), (None, ""), ("1", "0")] + [("hot", "x")] * 500
    frame = raw(spark, rows, "a.b", "c").repartition(3)
    written = stage(P.with_fingerprint(frame).withColumn("extra", F.concat_ws("-", "`a.b`", "c")), "rows")
    found = [tuple(r) for r in P.distinct_rows(written, ["a.b", "c"], "n", repeats).select("`a.b`", "c", "n", "extra").collect()]
    want = {row: rows.count(row) for row in rows}
    assert sorted(found, key=repr) == sorted(((*row, n, "-".join(x for x in row if x is not None)) for row, n in want.items()), key=repr)
    assert P.distinct_rows(written.limit(0), ["a.b", "c"]).count() == 0


def test_rows_that_only_share_a_fingerprint_stay_two(spark):
    frame = raw(spark, [("a", "1"), ("b", "2"), ("b", "2"), ("c", "3")], "x", "y")
    same = frame.withColumns({P.PRINTS[0]: F.when(F.col("x") == "c", 8).otherwise(7), P.PRINTS[1]: F.lit(7)})
    found = P.distinct_rows(stage(same, "rows"), ["x", "y"])
    assert sorted(tuple(r) for r in found.collect()) == [("a", "1", 1), ("b", "2", 2), ("c", "3", 1)]


def test_cleaning_does_not_shuffle_whole_rows(spark):
    frame = raw(spark, [("2026-01-01", str(k), "5") for k in range(50)], "Date", "Order_ID", "Quantity")
    assert "Exchange" not in clean_data(frame)._jdf.queryExecution().executedPlan().toString()


def test_column_report_with_inferred_types(spark):
    frame = raw(spark, [("2026-01-01", "7", "1.5"), ("2026-01-02", "8", "2")], "Date", "Order_ID", "Quantity")
    report = {r["Column"]: r["Inferred Type Before"] for r in clean_sales_data(frame, by_type=True).column_report.collect()}
    assert report == {"Date": "date", "Order_ID": "int", "Quantity": "float"}


def test_cells_are_counted_like_distinct_values(spark):
    names = ["b", "i", "l", "d", "f", "dec", "wide", "day", "at", "t", "raw", "many", "nothing"]
    values = [
        "true, 1, 9223372036854775807, 0.0D, float('nan'), 1.5, 12345678901234567890.5, date'1900-01-01', timestamp'2024-01-01 00:00:00', '', x'00', array('a, b'), null",
        "false, -1, -9223372036854775808, -0.0D, float('inf'), -1.5, -12345678901234567890.5, date'9999-12-31', timestamp'2024-01-01 00:00:01', ' ', x'', array('a', 'b'), null",
        "null, 0, 0, double('nan'), float(0.1), 0, null, null, null, 'é', null, array(null), null",
        "null, null, null, 0.1D, null, null, null, null, null, null, null, null, null",
    ]
    frame = spark.sql(" union all ".join(f"select {value}" for value in [*values, *values])).toDF(*names)
    names[0] = "text"  # clashes with a name inside
    frame = frame.toDF(*names)
    found = {r["Column"]: (r["Missing After"], r["Unique Values After"]) for r in P.count_cells(frame).collect()}
    counts = [F.struct(F.count_if(F.col(n).isNull()), F.count_distinct(n)).alias(n) for n in names if n != "nothing"]
    assert found == {**{n: tuple(v) for n, v in frame.agg(*counts).first().asDict().items()}, "nothing": (8, 0)}
    plan = P.count_cells(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_column_report_of_no_rows(spark):
    empty = spark.createDataFrame([], "v long, w string")
    report = P.build_column_report(empty, empty).collect()
    assert [tuple(row) for row in report] == [("v", "bigint", 0, 0, 0), ("w", "string", 0, 0, 0)]
