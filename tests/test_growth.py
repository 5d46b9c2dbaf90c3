"""What keeps times, moved bytes and task memory in step with the tables."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.test_csv_files import by_python, by_spark, messy, splits_of
from tillwise.functions.periods import needed_marks, parse_date
from tillwise.operators import cleaning, inference, star
from tillwise.operators.profile import check_duplicates, generate_quality_report
from tillwise.sources import csv_files, staging


def texts(spark, rows, *names):
    return spark.createDataFrame(rows, ", ".join(f"`{name}` string" for name in names))


@pytest.mark.parametrize(
    "form, marks", [("yyyy-M-d", ["-"]), ("yyyy-M-d H:mm[:ss][.SSS]", ["-", ":"]), ("yyyy-M-d'T-/'H", ["-"]), ("M/d/yyyy", ["/"]), ("yyyy", [])]
)
def test_marks_a_format_needs(form, marks):
    assert needed_marks(form) == marks


def test_formats_are_tried_where_their_marks_stand(spark):
    frame = texts(spark, [("2026-01-02",), ("2026-1-2 3:04",), ("1/2/2026",), ("1-2/2026",), ("20260102",), (None,)], "Date")
    found = frame.select(parse_date(F.col("Date"), frame.schema["Date"].dataType, cleaning.DATE_FORMATS)).collect()
    assert [row[0] for row in found] == [date(2026, 1, 2)] * 3 + [None] * 3


def test_long_methods_are_not_interpreted(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    with pytest.raises(KeyError), staging.compiled_methods(spark):
        assert int(spark.conf.get(key)) == staging.LONGEST_METHOD
        raise KeyError
    assert spark.conf.get(key) == before


def test_trimmed_texts_are_staged_once(spark):
    frame = texts(spark, [(" a ", "1"), ("b", "$2"), (" ", None), (None, "-3")], "Product", "Revenue")
    result = cleaning.clean_sales_data(frame)
    assert sorted(tuple(row) for row in result.cleaned.collect()) == [("Unknown", 2.0), ("Unknown", 3.0), ("a", 1.0), ("b", 2.0)]
    assert "regexp_replace" not in result.cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert result.summary.first()["missing_values_before"] == 2


def test_typed_numbers_are_not_grouped_again(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(cleaning, "stage", lambda frame, name, **options: staged.append(name) or staging.stage(frame, name, **options))
    frame = texts(spark, [("a", "1"), ("a", "1.0"), ("a", "-0.0"), ("a", "0"), ("b", "2.25"), ("b", None)], "Product", "Revenue")
    row = cleaning.clean_sales_data(frame, by_type=True).summary.first()
    assert (row["rows_before"], row["rows_after"], row["duplicate_rows_removed"]) == (6, 4, 2)
    assert staged == ["rows", "distinct"]


def test_csv_lines_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(csv_files, "BLOCK_BITS", 1)
    text = messy(60, "\n")
    (tmp_path / "in.csv").write_bytes(text.encode())
    with splits_of(spark, 2000):
        assert by_spark(spark, tmp_path / "in.csv") == by_python(text)


def test_duplicates_without_grouping_whole_rows(spark):
    rows = [("2026-01-01", "a"), ("2026-01-01", "a"), ("x", None), ("x", None), ("x", None), (None, ""), (None, None)]
    frame = texts(spark, rows, "Date", "Product").repartition(3)
    assert check_duplicates(frame).first()["duplicate_rows"] == 3
    assert check_duplicates(frame.limit(0)).first()["duplicate_rows"] == 0
    report = {(row["item"], row["column"]): row["value"] for row in generate_quality_report(frame).collect()}
    assert report == {
        ("Total Rows", None): 7, ("Missing Values", "Date"): 2, ("Missing Values", "Product"): 4, ("Duplicate Rows", None): 3, ("Invalid Dates", None): 5,
    }
    assert {row["value"] for row in generate_quality_report(frame.limit(0)).collect()} == {0}


def test_parts_grow_with_the_tables(spark, sales, tmp_path, monkeypatch):
    sales.write.parquet(str(tmp_path / "sales"))
    read = spark.read.parquet(str(tmp_path / "sales"))
    assert "repartition" not in staging.in_parts(read, "Order_ID")._jdf.queryExecution().logical().toString().lower()
    before = star.star_measures(star.fact_sales(read), ["Product_ID"]).collect()
    monkeypatch.setattr(staging, "PART", 100)
    assert staging.in_parts(read, "Order_ID").rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert sorted(star.star_measures(star.fact_sales(read), ["Product_ID"]).collect()) == sorted(before)
    made = spark.createDataFrame(sales.rdd, sales.schema)  # of no known size
    assert star.star_measures(star.fact_sales(made)).collect() == star.star_measures(star.fact_sales(read)).collect()
