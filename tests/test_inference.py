from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tillwise.operators.cleaning import clean_sales_data
from tillwise.operators.inference import by_inferred_value, date_format_votes, infer_types, type_of
from tillwise.plans.analysis import ingest
from tillwise.sources.csv_files import load_data
from tillwise.sources.run_store import RunStore


def texts(spark, **columns):
    names = list(columns)
    rows = list(zip(*columns.values()))
    return spark.createDataFrame(rows, StructType([StructField(name, StringType()) for name in names]))


CASES = {
    "whole": (["7", "+7", "007", None], "int"),
    "huge": (["9223372036854775808", "1", None, None], "float"),
    "fraction": (["7", "7.0", ".5", "1e3"], "float"),
    "truth": (["True", "TRUE", "false", None], "bool"),
    "truth and number": (["True", "1", None, None], "text"),
    "day": (["2026-01-05", " 2026-1-6 ", "01/02/2026", None], "date"),
    "day and word": (["2026-01-05", "bad-date", None, None], "text"),
    "inf": (["inf", "1", None, None], "text"),
    "spelling": (["1.5d", "1", "2", "3"], "text"),
    "money": (["$5", "1", "2", "3"], "text"),
    "blank": (["", "1", "2", "3"], "text"),
    "nothing": ([None, None, None, None], "void"),
    "long": (["x" * 50_000, "1" * 300, "2026-01-05 " * 900, None], "text"),
    "a.b`c": (["1", "2", None, None], "int"),
}


def test_types_follow_from_the_set_of_kinds(spark):
    frame = texts(spark, **{name: cells for name, (cells, _) in CASES.items()})
    found = {t.column: t for t in infer_types(frame)}
    assert {name: t.type for name, t in found.items()} == {name: kind for name, (_, kind) in CASES.items()}
    assert (found["long"].widest, found["long"].cells, found["long"].missing) == (50_000, 3, 1)
    assert found["fraction"].kinds == ["int", "float"] and found["truth and number"].kinds == ["bool", "int"]
    typed = infer_types(spark.range(3).select("id", F.lit(1.5).alias("x"), F.lit(date(2026, 1, 1)).alias("d"), F.lit(True).alias("t")))
    assert [t.type for t in typed] == ["int", "float", "date", "bool"]
    assert [t.type for t in infer_types(frame.limit(0))] == ["void"] * len(CASES)


def test_kinds_merge_in_any_order():
    for left in range(32):
        for right in range(32):
            both = {type_of(left), type_of(right)} - {"void"}
            if len(both) == 1 and "text" not in both:
                assert type_of(left | right) == both.pop()
            elif both == {"int", "float"}:
                assert type_of(left | right) == "float"
            elif both:
                assert type_of(left | right) == "text"


def test_cells_spelled_by_value(spark):
    frame = texts(spark, a=["7", "07.0", None], b=["7", "+7", "007"], c=["True", "TRUE", "false"], d=["7", "x", "7.0"], e=["1", "2", "1.0"])
    rows = by_inferred_value(frame, infer_types(frame), keep=["e"]).collect()
    assert [tuple(row) for row in rows] == [("7.0", "7", "true", "7", "1"), ("7.0", "7", "true", "x", "2"), (None, "7", "false", "7.0", "1.0")]


def test_duplicates_by_inferred_type(spark):
    frame = texts(
        spark, Date=["2026-01-01"] * 4, Order_ID=["7", "7.0", "07", "8"], Product=["7", "7", "7", "x"], Quantity=["1", "1.0", "1", "2"]
    )
    plain, typed = clean_sales_data(frame), clean_sales_data(frame, by_type=True)
    assert plain.summary.first()["duplicate_rows_removed"] == 0
    assert typed.summary.first()["duplicate_rows_removed"] == 2
    assert sorted((r["Order_ID"], r["Product"], r["Quantity"]) for r in typed.cleaned.collect()) == [("7.0", "7", 1.0), ("8.0", "x", 2.0)]


def test_each_file_has_its_own_date_order(spark, tmp_path):
    header = "Date,Order ID,Revenue,Cost,Profit,Customer ID\n"
    files = {
        "us.csv": ["01/02/2026,1,1,1,0,c", "12/31/2025,2,1,1,0,c", "31/12/2025,3,1,1,0,c"],
        "eu.csv": ["01/02/2026,1,1,1,0,c", "31/12/2025,5,1,1,0,c", "30/11/2025,6,1,1,0,c", "11/30/2025,7,1,1,0,c", "2026-05-06,8,1,1,0,c"],
        "either.csv": ["03/04/2026,9,1,1,0,c", ",10,1,1,0,c"],
        "none.csv": ["bad,11,1,1,0,c"],
    }
    for name, lines in files.items():
        (tmp_path / name).write_text(header + "\n".join(lines) + "\n")
    raw = load_data(spark, str(tmp_path), file_column="file")
    votes = {(r["file"].rsplit("/", 1)[-1], r["format"]): (r["parsed"], r["chosen"]) for r in date_format_votes(raw, "file").collect()}
    assert votes == {
        ("us.csv", "M/d/yyyy"): (2, True), ("us.csv", "d/M/yyyy"): (2, False),
        ("eu.csv", "M/d/yyyy"): (2, False), ("eu.csv", "d/M/yyyy"): (3, True),
        ("either.csv", "M/d/yyyy"): (1, True), ("either.csv", "d/M/yyyy"): (1, False),
        ("none.csv", "M/d/yyyy"): (0, True), ("none.csv", "d/M/yyyy"): (0, False),
    }
    done = ingest(spark, str(tmp_path), str(tmp_path / "store"), date_order_per_file=True)
    rows = RunStore(spark, str(tmp_path / "store")).table("sales_data", done.run_id).collect()
    assert sorted((r["Order_ID"], str(r["Date"])) for r in rows) == [
        ("1", "2026-01-02"), ("1", "2026-02-01"), ("2", "2025-12-31"), ("5", "2025-12-31"), ("6", "2025-11-30"), ("8", "2026-05-06"),
        ("9", "2026-03-04"),
    ]
    summary = done.quality.summary.first()
    assert (summary["rows_before"], summary["rows_after"], summary["duplicate_rows_removed"], summary["invalid_dates_found"]) == (11, 7, 0, 3)
    done.close()


def test_votes_with_ties_and_odd_cells(spark):
    rows = [("a", 5, "13/01/2026"), ("a", 9, "01/13/2026"), ("b", 9, "13/01/2026"), ("b", 5, "01/13/2026"), (None, 1, "14/1/2026"), ("c", 1, None)]
    frame = spark.createDataFrame(rows, "file string, n int, Date string")
    chosen = {r["file"]: r["format"] for r in date_format_votes(frame, "file", row_order=F.col("n")).where("chosen").collect()}
    assert chosen == {"a": "d/M/yyyy", "b": "M/d/yyyy", None: "d/M/yyyy", "c": "M/d/yyyy"}
    assert date_format_votes(frame.limit(0), "file").count() == 0
    with pytest.raises(ValueError, match="no column"):
        clean_sales_data(frame, file_column="absent")
