"""DuckDB SQL for every registered query, over the same tables."""

from __future__ import annotations

from catalog.inputs import COST_FACTOR
from catalog.queries import (
    CUSTOMER_HIGH_PCT,
    CUSTOMER_SHARE_PCT,
    HORIZON,
    PRODUCT_SHARE,
    SEGMENT_REGULAR_RANGE,
    SEGMENT_VIP_FROM,
)
from tillwise import fixed_values as V

SALES = """
sales AS (
  SELECT CAST(o_orderdate AS DATE) AS "Date", CAST(l_orderkey AS VARCHAR) AS Order_ID,
         CAST(o_custkey AS VARCHAR) AS Customer_ID, p_name AS Product, p_type AS Category,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS Revenue,
         CAST(CAST(p_retailprice AS DECIMAL(11,2)) * CAST(l_quantity AS DECIMAL(6,0)) AS DECIMAL(18,2)) AS Cost,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4))
           - CAST(p_retailprice AS DECIMAL(11,2)) * CAST(l_quantity AS DECIMAL(6,0)) AS Profit,
         CAST(l_quantity AS BIGINT) AS Quantity
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
)"""

COSTLY = f"""
costly AS (
  SELECT * REPLACE (Cost * {COST_FACTOR} AS Cost, Revenue - Cost * {COST_FACTOR} AS Profit) FROM sales
)"""


def sums(name: str) -> str:
    return f"CAST(COALESCE(SUM({name}), 0) AS DOUBLE)"


def kpis(source: str) -> str:
    """CTEs ending in ``kpi``: one row, unrounded."""
    known = "COUNT(DISTINCT TRIM({0})) FILTER (WHERE LOWER(TRIM({0})) <> 'unknown')"
    return f"""
months AS (
  SELECT strftime("Date", '%Y-%m') AS m, CAST(COALESCE(SUM(Revenue), 0) AS DOUBLE) AS v
  FROM {source} WHERE "Date" IS NOT NULL GROUP BY 1
),
growth AS (
  SELECT MAX(m) FILTER (WHERE n = 1) AS cur, MAX(m) FILTER (WHERE n = 2) AS prev,
         MAX(v) FILTER (WHERE n = 1) AS cur_v, MAX(v) FILTER (WHERE n = 2) AS prev_v
  FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY m DESC) AS n FROM months)
),
totals AS (
  SELECT {sums("Revenue")} AS revenue, {sums("Profit")} AS profit,
         {known.format("Order_ID")} AS orders,
         {known.format("Customer_ID")} AS customers
  FROM {source}
),
kpi AS (
  SELECT revenue, profit, profit / NULLIF(revenue, 0) * 100 AS profit_margin,
         revenue / NULLIF(orders, 0) AS average_order_value, orders, customers,
         (cur_v - prev_v) / NULLIF(prev_v, 0) * 100 AS growth_rate,
         cur AS growth_current_period, prev AS growth_previous_period,
         cur_v AS growth_current_revenue, prev_v AS growth_previous_revenue
  FROM totals, growth
)"""


def kpi_row(digits: int) -> str:
    doubles = ("revenue profit profit_margin average_order_value growth_rate growth_current_revenue "
               "growth_previous_revenue").split()  # fmt: skip
    return "SELECT * REPLACE (" + ", ".join(f"ROUND({d}, {digits}) AS {d}" for d in doubles) + ") FROM kpi"


KPI_LONG = " UNION ALL ".join(
    f"""SELECT '{name}' AS "KPI", CAST({field} AS DOUBLE) AS "Value", '{unit}' AS "Unit" FROM kpi"""
    for name, unit, field in V.KPI_UNITS
)


def with_sales(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join([SALES, *ctes]) + "\n" + body


def trend(start: str, label: str, name: str, growth: str) -> str:
    return with_sales(
        f"""
SELECT {label} AS {name}, ROUND(r, 4) AS "Revenue", ROUND(p, 4) AS "Profit",
       ROUND((r - LAG(r) OVER w) / NULLIF(LAG(r) OVER w, 0) * 100, 4) AS {growth}_Revenue_Growth,
       ROUND((p - LAG(p) OVER w) / NULLIF(LAG(p) OVER w, 0) * 100, 4) AS {growth}_Profit_Growth
FROM (SELECT {start} AS s, CAST(SUM(Revenue) AS DOUBLE) AS r, CAST(SUM(Profit) AS DOUBLE) AS p
      FROM sales WHERE "Date" IS NOT NULL GROUP BY 1)
WINDOW w AS (ORDER BY s)"""
    )


MONTHS = """
by_month AS (
  SELECT CAST(date_trunc('month', "Date") AS DATE) AS s, CAST(SUM(Revenue) AS DOUBLE) AS r, CAST(SUM(Profit) AS DOUBLE) AS p
  FROM sales WHERE "Date" IS NOT NULL GROUP BY 1
),
last_two AS (
  SELECT MAX(s) FILTER (WHERE n = 1) AS cur, MAX(s) FILTER (WHERE n = 2) AS prev,
         MAX(r) FILTER (WHERE n = 1) AS cur_r, MAX(r) FILTER (WHERE n = 2) AS prev_r,
         MAX(p) FILTER (WHERE n = 1) AS cur_p, MAX(p) FILTER (WHERE n = 2) AS prev_p
  FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY s DESC) AS n FROM by_month)
),
by_quarter AS (
  SELECT CAST(date_trunc('quarter', s) AS DATE) AS s, SUM(r) AS r, ROW_NUMBER() OVER (ORDER BY date_trunc('quarter', s) DESC) AS n
  FROM by_month GROUP BY date_trunc('quarter', s)
)"""

FASTEST = f"""
category_growth AS (
  SELECT Category, (c - b) / b * 100 AS rate FROM (
    SELECT Category,
           COALESCE(SUM(CAST(Revenue AS DOUBLE)) FILTER (WHERE date_trunc('month', "Date") = cur), 0) AS c,
           COALESCE(SUM(CAST(Revenue AS DOUBLE)) FILTER (WHERE date_trunc('month', "Date") = prev), 0) AS b
    FROM sales, last_two WHERE Category IS NOT NULL GROUP BY 1)
  WHERE b >= {V.GROWTH_FLOOR}
),
fastest AS (SELECT * FROM category_growth ORDER BY rate DESC, Category LIMIT 1)"""


def money(value: str) -> str:
    return f"format('{{:,.2f}}', {value})"


def tenth(value: str) -> str:
    return f"format('{{:,.1f}}', {value})"


def text(template: str, **values: str) -> str:
    """SQL that fills a wording template."""
    out = "'" + template.replace("'", "''") + "'"
    for name, value in values.items():
        out = out.replace("{" + name + "}", f"' || {value} || '")
    return out


def moved(now: str, before: str, zero: str = "NULL") -> tuple[str, str]:
    growth = f"COALESCE(({now} - {before}) / NULLIF({before}, 0) * 100, {zero})"
    return f"CASE WHEN {growth} >= 0 THEN 'increased' ELSE 'decreased' END", tenth(f"ABS({growth})")


def insights() -> str:
    t = V.TREND_TEXTS
    revenue, profit = moved("cur_r", "prev_r"), moved("cur_p", "prev_p", "0.0")
    quarter = moved("a.r", "b.r")
    label = "strftime({0}, '%Y-%m')".format
    quarter_label = "year({0}) || 'Q' || quarter({0})".format
    return with_sales(
        f"""
SELECT 1 AS ord, {text(t["revenue"], direction=revenue[0], growth=revenue[1], current=label("cur"), previous=label("prev"),
                       now=money("cur_r"), before=money("prev_r"))} AS insight FROM last_two
UNION ALL SELECT 2, {text(t["profit"], direction=profit[0], growth=profit[1], now=money("cur_p"), before=money("prev_p"))} FROM last_two
UNION ALL SELECT 3, {text(t["quarter"], direction=quarter[0], growth=quarter[1], current=quarter_label("a.s"),
                          previous=quarter_label("b.s"), now=money("a.r"), before=money("b.r"))}
          FROM by_quarter a, by_quarter b WHERE a.n = 1 AND b.n = 2
UNION ALL (SELECT 4, {text(t["peak"], month=label("s"), revenue=money("r"))} FROM by_month ORDER BY r DESC, s LIMIT 1)
UNION ALL SELECT 5, {text(t["category"], category="Category", growth=tenth("rate"))} FROM fastest""",
        MONTHS,
        FASTEST,
    )


def drivers(metric: str = "Revenue") -> str:
    """CTEs ending in ``fallen``: members that fell, unrounded."""
    dims = " UNION ALL ".join(
        f"""SELECT '{name}' AS dimension, {name} AS member,
  SUM(CASE WHEN date_trunc('month', "Date") = prev THEN {metric} ELSE 0 END) AS b,
  SUM(CASE WHEN date_trunc('month', "Date") = cur THEN {metric} ELSE 0 END) AS c
  FROM sales, last_two WHERE date_trunc('month', "Date") IN (cur, prev) GROUP BY {name}"""
        for name in V.DRIVER_DIMENSIONS
    )
    field = "r" if metric == "Revenue" else "p"
    return f"""
members AS ({dims}),
fallen AS (
  SELECT dimension, member, CAST(b AS DOUBLE) AS previous_value, CAST(c AS DOUBLE) AS current_value,
         CAST(c - b AS DOUBLE) AS change,
         COALESCE(CAST(c - b AS DOUBLE) / NULLIF(CAST(b AS DOUBLE), 0) * 100, 0) AS pct_change,
         ABS(CAST(c - b AS DOUBLE)) AS abs_change,
         ABS(CAST(c - b AS DOUBLE)) / ABS(cur_{field} - prev_{field}) * 100 AS contribution_pct
  FROM members, last_two WHERE member IS NOT NULL AND c < b AND cur_{field} < prev_{field}
)"""


FALLEN = """SELECT dimension, member, ROUND(previous_value, 4) AS previous_value, ROUND(current_value, 4) AS current_value,
 ROUND(change, 4) AS change, ROUND(pct_change, 4) AS pct_change, ROUND(abs_change, 4) AS abs_change,
 ROUND(contribution_pct, 4) AS contribution_pct FROM fallen"""
RANKED = FALLEN.replace(" FROM fallen", ", ROW_NUMBER() OVER (PARTITION BY dimension ORDER BY change, member) AS \"rank\" FROM fallen")
FIRST_FALLEN = " QUALIFY ROW_NUMBER() OVER (PARTITION BY dimension ORDER BY change, member) = 1"


def rca_summary() -> str:
    return with_sales(
        """
SELECT CASE WHEN prev IS NULL THEN 'one_month' WHEN cur_r >= prev_r THEN 'no_decline' ELSE 'decline' END AS status,
       COALESCE(cur_r < prev_r, FALSE) AS drop_detected, 'Revenue' AS metric,
       ROUND(COALESCE(cur_r - prev_r, 0), 4) AS total_change,
       ROUND(COALESCE((cur_r - prev_r) / NULLIF(prev_r, 0) * 100, 0), 4) AS pct_change,
       strftime(cur, '%Y-%m') AS current_month, strftime(prev, '%Y-%m') AS previous_month,
       ROUND(cur_r, 4) AS current_value, ROUND(prev_r, 4) AS previous_value
FROM last_two""",
        MONTHS,
    )


def rca_explanations() -> str:
    t = V.DRIVER_TEXTS
    pct = "COALESCE((cur_r - prev_r) / NULLIF(prev_r, 0) * 100, 0)"
    cur, prev = "strftime(cur, '%Y-%m')", "strftime(prev, '%Y-%m')"
    up = text(t["no_decline"], metric="'Revenue'", pct=tenth(pct), previous=prev, current=cur, change=money("cur_r - prev_r"))
    down = text(t["decline"], metric="'Revenue'", pct=tenth(f"ABS({pct})"), drop=money("prev_r - cur_r"), previous=prev,
                before=money("prev_r"), current=cur, now=money("cur_r"))
    shown = "CASE WHEN dimension = 'Customer_ID' THEN 'Customer ''' || member || '''' ELSE member END"
    each = text(t["dimension"], dimension="dimension", member=shown, metric="'Revenue'", before=money("previous_value"),
                now=money("current_value"), pct=tenth("ABS(pct_change)"), share=tenth("contribution_pct"))
    place = "CASE dimension " + " ".join(
        f"WHEN '{name}' THEN {i}" for i, name in enumerate(V.DRIVER_DIMENSIONS, 1)
    ) + " END"
    return with_sales(
        f"""
SELECT 0 AS ord, CASE WHEN cur_r >= prev_r THEN {up} ELSE {down} END AS explanation FROM last_two
UNION ALL SELECT {place}, {each} FROM (SELECT * FROM fallen{FIRST_FALLEN})""",
        MONTHS,
        drivers(),
    )


# --- raw text lines and cleaning --------------------------------------------------
DIRTY = """
keyed AS (
  SELECT *, CAST(Order_ID AS BIGINT) AS k,
         UNNEST(CASE WHEN CAST(Order_ID AS BIGINT) % 50 = 0 THEN [1, 2] ELSE [1] END) AS copy,
         CAST(CAST(Revenue AS DECIMAL(14,2)) AS VARCHAR) AS rev, CAST(CAST(Profit AS DECIMAL(14,2)) AS VARCHAR) AS pro
  FROM sales
),
dirty AS (
  SELECT CASE WHEN k % 101 = 0 THEN 'bad-date' WHEN k % 103 = 0 THEN NULL ELSE strftime("Date", '%Y-%m-%d') END AS "Date",
         Order_ID, CASE WHEN k % 67 = 0 THEN NULL WHEN k % 71 = 0 THEN 'Unknown' ELSE Customer_ID END AS Customer_ID,
         CASE WHEN k % 89 = 0 THEN '  ' || Product || ' ' WHEN k % 97 = 0 THEN '' ELSE Product END AS Product, Category,
         CASE WHEN k % 61 = 0 THEN NULL WHEN k % 37 = 0 THEN '$' || rev WHEN k % 41 = 0 THEN '-' || rev ELSE rev END AS Revenue,
         CASE WHEN k % 59 = 0 THEN NULL ELSE CAST(Cost AS VARCHAR) END AS Cost,
         CASE WHEN k % 31 = 0 THEN NULL ELSE pro END AS Profit,
         CASE WHEN k % 53 = 0 THEN 'n/a?' ELSE CAST(Quantity AS VARCHAR) END AS Quantity
  FROM keyed
)"""

CLEAN = DIRTY + """,
singles AS (SELECT DISTINCT * FROM dirty),
parsed AS (
  SELECT "Date" AS date_text, CAST(TRY_STRPTIME("Date", '%Y-%m-%d') AS DATE) AS d, NULLIF(TRIM(Order_ID), '') AS Order_ID,
         NULLIF(TRIM(Customer_ID), '') AS Customer_ID, NULLIF(TRIM(Product), '') AS Product, NULLIF(TRIM(Category), '') AS Category,
         TRY_CAST(REPLACE(Revenue, '$', '') AS DOUBLE) AS r, TRY_CAST(Cost AS DOUBLE) AS c,
         TRY_CAST(Profit AS DOUBLE) AS p, TRY_CAST(Quantity AS DOUBLE) AS q
  FROM singles
),
kept AS (SELECT * FROM parsed WHERE d IS NOT NULL),
medians AS (SELECT MEDIAN(ABS(r)) AS mr, MEDIAN(ABS(c)) AS mc, MEDIAN(ABS(q)) AS mq FROM kept),
cleaned AS (
  SELECT d AS "Date", COALESCE(Order_ID, 'Unknown') AS Order_ID, COALESCE(Customer_ID, 'Unknown') AS Customer_ID,
         COALESCE(Product, 'Unknown') AS Product, COALESCE(Category, 'Unknown') AS Category,
         COALESCE(ABS(r), mr) AS Revenue, COALESCE(ABS(c), mc) AS Cost,
         COALESCE(p, COALESCE(ABS(r), mr) - COALESCE(ABS(c), mc)) AS Profit, COALESCE(ABS(q), mq) AS Quantity
  FROM kept, medians
)"""


def per_column(source: str, expression: str, value: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS {value}, {expression.format('"' + name + '"')} FROM {source}""" for name in V.SALES_COLUMNS
    )


NULLS = "CAST(COUNT(*) FILTER (WHERE {0} IS NULL) AS BIGINT)"
DUPLICATES = "(SELECT COUNT(*) FROM dirty) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM dirty))"
ALL_NULLS = " + ".join(f"""COUNT(*) FILTER (WHERE "{name}" IS NULL)""" for name in V.SALES_COLUMNS)
BAD_DATES = """SELECT COUNT(*) FROM dirty WHERE TRY_STRPTIME("Date", '%Y-%m-%d') IS NULL"""


def inferred() -> str:
    """Types of the text columns, by the set of the kinds of their cells."""
    iso, slash = "strftime(\"Date\", '%Y-%m-%d')", "strftime(\"Date\", '%m/%d/%Y')"
    columns = {
        "whole": "Order_ID", "fraction": "CASE WHEN k % 3 = 0 THEN Order_ID || '.0' WHEN k % 11 = 0 THEN NULL ELSE Order_ID END",
        "truth": "CASE WHEN k % 2 = 0 THEN 'True' WHEN k % 5 = 0 THEN NULL ELSE 'FALSE' END", "day": iso,
        "days": f"CASE WHEN k % 7 = 0 THEN {slash} ELSE {iso} END", "mixed": "CASE WHEN k % 97 = 0 THEN 'unknown' ELSE Order_ID END",
        "word": "Product", "nothing": "CAST(NULL AS VARCHAR)", "typed": "CAST(Quantity AS VARCHAR)",
    }
    cells = " UNION ALL ".join(
        f"SELECT {place} AS place, '{name}' AS \"column\", {cell} AS cell FROM (SELECT *, CAST(Order_ID AS BIGINT) AS k FROM sales)"
        for place, (name, cell) in enumerate(columns.items())
    )
    return with_sales(
        f"""
SELECT "column", CASE WHEN kinds = '' THEN 'void' WHEN kinds IN ('int,float', 'float') THEN 'float' WHEN contains(kinds, ',') THEN 'text'
         ELSE kinds END AS type, kinds, cells, missing, widest
FROM (SELECT "column", array_to_string(list_filter(['bool', 'int', 'float', 'date', 'text'], lambda x: list_contains(found, x)), ',') AS kinds,
             cells, missing, CAST(COALESCE(widest, 0) AS INTEGER) AS widest
      FROM (SELECT "column", COALESCE(list(DISTINCT kind) FILTER (WHERE kind IS NOT NULL), []) AS found, count(cell) AS cells,
                   count(*) - count(cell) AS missing, max(length(cell)) AS widest
            FROM (SELECT *, CASE WHEN cell IS NULL THEN NULL WHEN lower(cell) IN ('true', 'false') THEN 'bool'
                           WHEN regexp_full_match(cell, '[+-]?[0-9]+') THEN 'int' WHEN regexp_full_match(cell, '[+-]?[0-9]+[.][0-9]*') THEN 'float'
                           WHEN TRY_STRPTIME(cell, ['%Y-%m-%d', '%m/%d/%Y']) IS NOT NULL THEN 'date' ELSE 'text' END AS kind
                  FROM ({cells})) GROUP BY place, "column"))"""
    )


DATED = """
dated AS (
  SELECT *, 'file' || f AS file, CASE WHEN f <= 1 THEN strftime("Date", '%m/%d/%Y') WHEN f <= 3 THEN strftime("Date", '%-d/%-m/%Y')
         WHEN f = 4 THEN strftime("Date", '%Y-%m-%d') WHEN day("Date") <= 12 THEN strftime("Date", '%m/%d/%Y') END AS cell
  FROM (SELECT *, CAST(Customer_ID AS BIGINT) % 6 AS f FROM sales)
)"""


def votes() -> str:
    forms = [("M/d/yyyy", "%m/%d/%Y"), ("d/M/yyyy", "%d/%m/%Y")]
    each = " UNION ALL ".join(
        f"SELECT {place} AS place, file, '{form}' AS format, count(*) FILTER (WHERE TRY_STRPTIME(cell, '{short}') IS NOT NULL) AS parsed, "
        f"min(CAST(Order_ID AS BIGINT)) FILTER (WHERE TRY_STRPTIME(cell, '{short}') IS NOT NULL) AS first_row FROM dated GROUP BY file"
        for place, (form, short) in enumerate(forms)
    )
    return with_sales(
        f"""
SELECT file, format, parsed, first_row,
       ROW_NUMBER() OVER (PARTITION BY file ORDER BY parsed DESC, first_row NULLS LAST, place) = 1 AS chosen FROM ({each})""",
        DATED,
    )


def clean_summary() -> str:
    return with_sales(
        f"""
SELECT CAST(before.n AS BIGINT) AS rows_before, CAST(after.n AS BIGINT) AS rows_after, CAST(9 AS BIGINT) AS columns,
       CAST(before.n - single.n AS BIGINT) AS duplicate_rows_removed, CAST(single.bad AS BIGINT) AS invalid_dates_found,
       CAST(before.nulls AS BIGINT) AS missing_values_before, CAST(after.nulls AS BIGINT) AS missing_values_after,
       ROUND((before.n * 9 - before.nulls) / (before.n * 9) * 100, 1) AS quality_score_before,
       ROUND((after.n * 9 - after.nulls) / (after.n * 9) * 100, 1) AS quality_score_after,
       '' AS missing_expected_columns
FROM (SELECT COUNT(*) AS n, {ALL_NULLS} AS nulls FROM dirty) AS before,
     (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE date_text IS NOT NULL AND d IS NULL) AS bad FROM parsed) AS single,
     (SELECT COUNT(*) AS n, {ALL_NULLS} AS nulls FROM cleaned) AS after""",
        CLEAN,
    )


def clean_actions() -> str:
    t = V.ACTION_TEXTS
    found: list[tuple[str, str, str, str, str]] = []  # condition count, column, value, text, source

    def entry(kind: str, column: str, count: str, value: str = "NULL", source: str = "kept") -> None:
        words = {"rows": "n", "column": f"'{column}'", "value": money("v")}
        used = {name: sql for name, sql in words.items() if "{" + name + "}" in t[kind]}
        shown = "NULL" if column == "" else f"'{column}'"
        found.append((count, shown, value, text(t[kind], **used), source))

    entry("duplicates", "", DUPLICATES, source="(SELECT 1)")
    entry("dates", "Date", "COUNT(*) FILTER (WHERE d IS NULL)", source="parsed")
    for column, cell, median in (("Revenue", "r", "mr"), ("Cost", "c", "mc")):
        entry("negatives", column, f"COUNT(*) FILTER (WHERE {cell} < 0)")
        entry("median", column, f"COUNT(*) FILTER (WHERE {cell} IS NULL)", f"(SELECT {median} FROM medians)")
    entry("profit", "Profit", "COUNT(*) FILTER (WHERE p IS NULL)")
    entry("negatives", "Quantity", "COUNT(*) FILTER (WHERE q < 0)")
    entry("median", "Quantity", "COUNT(*) FILTER (WHERE q IS NULL)", "(SELECT mq FROM medians)")
    for column in V.TEXT_COLUMNS:
        entry("text", column, f"COUNT(*) FILTER (WHERE {column} IS NULL)")
    rows = " UNION ALL ".join(
        f"SELECT {i} AS i, {shown} AS col, CAST(n AS BIGINT) AS n, v, {sentence} AS message "
        f"FROM (SELECT {count} AS n, CAST({value} AS DOUBLE) AS v FROM {source})"
        for i, (count, shown, value, sentence, source) in enumerate(found)
    )
    return with_sales(
        f"""
SELECT CAST(ROW_NUMBER() OVER (ORDER BY i) AS BIGINT) AS step, CAST(col AS VARCHAR) AS "column", n AS rows,
       ROUND(v, 4) AS value, message
FROM ({rows}) WHERE n > 0""",
        CLEAN,
    )


TYPES = {"Date": "date"} | dict.fromkeys(V.TEXT_COLUMNS, "string") | dict.fromkeys(V.NUMERIC_COLUMNS, "double")
COLUMN_REPORT = " UNION ALL ".join(
    f"""
SELECT '{name}' AS "Column", '{TYPES[name]}' AS "Data Type After Cleaning",
       (SELECT COUNT(*) FROM dirty WHERE "{name}" IS NULL) AS "Missing Before",
       COUNT(*) FILTER (WHERE "{name}" IS NULL) AS "Missing After", COUNT(DISTINCT "{name}") AS "Unique Values After"
FROM cleaned"""
    for name in V.SALES_COLUMNS
)

# --- forecast ---------------------------------------------------------------------


def spine(key: str) -> str:
    """CTEs ending in ``model``: one row per series."""
    return f"""
daily AS (
  SELECT {key} AS series, "Date" AS d, CAST(SUM(Revenue) AS DOUBLE) AS y FROM sales
  WHERE "Date" IS NOT NULL AND Revenue IS NOT NULL AND {key} IS NOT NULL GROUP BY 1, 2
),
ends AS (SELECT series, MIN(d) AS f, MAX(d) AS l, COUNT(*) AS sold FROM daily GROUP BY 1),
dense AS (
  SELECT e.series, e.d, COALESCE(y, 0) AS y, CAST(e.d - f AS INTEGER) AS x, l
  FROM (SELECT series, f, l, CAST(UNNEST(generate_series(f, l, INTERVAL 1 DAY)) AS DATE) AS d FROM ends WHERE sold >= 5) e
  LEFT JOIN daily ON daily.series = e.series AND daily.d = e.d
),
model AS (
  SELECT series, MAX(l) AS l, COUNT(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, AVG(y) AS mean,
         list(y ORDER BY d) AS ys, CASE WHEN COUNT(*) >= 14 THEN 14 ELSE 7 END AS w
  FROM dense GROUP BY 1
),
walk AS (
  SELECT series, 0 AS step, ys AS h, w FROM model
  UNION ALL
  SELECT series, step + 1, list_append(h, list_avg(h[-w:])), w FROM walk WHERE step < {HORIZON}
),
future AS (
  SELECT m.series, CAST(m.l + step AS DATE) AS d, h[-1] AS ma, GREATEST(0, slope * (n - 1 + step) + intercept) AS lr
  FROM walk JOIN model m ON m.series = walk.series WHERE step > 0
)"""


ALL = spine("'all'")

# --- recommendations --------------------------------------------------------------


def advice(rule: str, number: int, rank: str, priority: str, source: str, **words: str) -> str:
    title, category, reason, description = V.RULE_TEXTS[rule]
    fill = lambda template: text(template, **{n: s for n, s in words.items() if "{" + n + "}" in template})
    return f"""
SELECT {number} AS rule_no, CAST({rank} AS INTEGER) AS rank, {fill(title)} AS title, {priority} AS priority,
       {text(category)} AS category, {fill(reason)} AS trigger_reason, {fill(description)} AS description
FROM {source}"""


LOW = advice(
    "margin", 1, "1", f"CASE WHEN profit_margin < {V.URGENT_MARGIN} THEN 'High' ELSE 'Medium' END",
    f"kpi WHERE profit_margin < {V.LOW_MARGIN}", margin=tenth("profit_margin"),
)


def loss(source: str) -> str:
    return advice(
        "loss", 2, "n", "'High'",
        f"""(SELECT Product, r, p, ROW_NUMBER() OVER (ORDER BY p, Product) AS n FROM (
  SELECT Product, CAST(SUM(Revenue) AS DOUBLE) AS r, CAST(SUM(Profit) AS DOUBLE) AS p FROM {source}
  WHERE Product IS NOT NULL GROUP BY 1) WHERE p < 0) WHERE n <= {V.LOSS_PRODUCTS_SHOWN}""",
        product="Product", margin=tenth("p / r * 100"), loss=money("ABS(p)"),
    )


def share(source: str) -> str:
    return advice(
        "share", 3, "1", "'Medium'",
        f"""(SELECT Product, CAST(SUM(Revenue) AS DOUBLE) / (SELECT CAST(SUM(Revenue) AS DOUBLE) FROM {source}) AS s
  FROM {source} WHERE Product IS NOT NULL GROUP BY 1) WHERE s >= {PRODUCT_SHARE}""",
        product="Product", share=tenth("s * 100"),
    )


def customer(source: str) -> str:
    return advice(
        "customer", 4, "1", f"CASE WHEN s >= {CUSTOMER_HIGH_PCT} THEN 'High' ELSE 'Medium' END",
        f"""(SELECT Customer_ID, r, r / (SELECT CAST(SUM(Revenue) AS DOUBLE) FROM {source}) * 100 AS s FROM (
  SELECT Customer_ID, CAST(SUM(Revenue) AS DOUBLE) AS r FROM {source}
  WHERE Customer_ID IS NOT NULL AND Customer_ID <> 'Unknown' GROUP BY 1)
  ORDER BY r DESC, Customer_ID LIMIT 1) WHERE s >= {CUSTOMER_SHARE_PCT}""",
        customer="Customer_ID", share=tenth("s"), revenue=money("r"),
    )


AUDITS = (
    advice("duplicates", 5, "1", "'Low'", f"(SELECT {DUPLICATES} AS n) WHERE n > 0", rows="n")
    + " UNION ALL "
    + advice(
        "dates", 6, "1", "'Low'",
        "(SELECT COUNT(*) AS n FROM parsed WHERE date_text IS NOT NULL AND d IS NULL) WHERE n > 0", rows="n",
    )
)

# --- numbered rows ----------------------------------------------------------------
NUMBERED = "numbered AS (SELECT ROW_NUMBER() OVER (ORDER BY " + ", ".join(
    f'"{name}" NULLS FIRST' for name in V.SALES_COLUMNS
) + ") AS row_number, * FROM sales)"


def json_cell(name: str) -> str:
    plain = f'CAST("{name}" AS VARCHAR)'
    quoted = plain if name in V.NUMERIC_COLUMNS else f"""'"' || {plain} || '"'"""
    return f"""'"{name}":' || COALESCE({quoted}, 'null')"""


JSON = "'{' || " + " || ',' || ".join(json_cell(name) for name in V.SALES_COLUMNS) + " || '}'"

PRODUCT_KEY = "md5(COALESCE(length(Product) || '=' || Product, '-') || '|' || COALESCE(length(Category) || '=' || Category, '-'))"
MEASURES = """ROUND(CAST(SUM(Revenue) AS DOUBLE), 4) AS total_revenue, ROUND(CAST(SUM(Cost) AS DOUBLE), 4) AS total_cost,
 ROUND(CAST(SUM(Revenue) - SUM(Cost) AS DOUBLE), 4) AS total_profit,
 ROUND(COALESCE(CAST(SUM(Revenue) - SUM(Cost) AS DOUBLE) / NULLIF(CAST(SUM(Revenue) AS DOUBLE), 0), 0), 4) AS profit_margin,
 COUNT(DISTINCT Order_ID) AS total_orders,
 ROUND(COALESCE(CAST(SUM(Revenue) AS DOUBLE) / NULLIF(COUNT(DISTINCT Order_ID), 0), 0), 4) AS average_order_value"""
TOTALS = """CAST(SUM(Quantity) AS BIGINT) AS Total_Quantity, ROUND(CAST(SUM(Revenue) AS DOUBLE), 4) AS Total_Revenue,
 ROUND(CAST(SUM(Profit) AS DOUBLE), 4) AS Total_Profit"""


def segments(vip: float, low: float, high: float) -> str:
    return with_sales(
        f"""
SELECT Customer_ID, COUNT(DISTINCT Order_ID) AS Total_Orders, ROUND(CAST(SUM(Revenue) AS DOUBLE), 4) AS Total_Spend,
       ROUND(CAST(SUM(Revenue) AS DOUBLE) / COUNT(Revenue), 4) AS Avg_Order_Value,
       CASE WHEN SUM(Revenue) >= {vip} THEN '{V.SEGMENT_VIP}' WHEN SUM(Revenue) BETWEEN {low} AND {high}
            THEN '{V.SEGMENT_REGULAR}' ELSE '{V.SEGMENT_OCCASIONAL}' END AS Customer_Segment
FROM sales WHERE Customer_ID <> 'Unknown' GROUP BY 1"""
    )


ORACLE: dict[str, str] = {
    "kpi_snapshot": with_sales(kpi_row(4), kpis("sales")),
    "kpi_long": with_sales(f'SELECT * REPLACE (ROUND("Value", 4) AS "Value") FROM ({KPI_LONG})', kpis("sales")),
    "kpi_texts": with_sales(
        f"""SELECT "KPI", CASE "Unit" WHEN 'currency' THEN '$' || {money('"Value"')} WHEN 'percent' THEN {money('"Value"')} || '%'
ELSE CAST(CAST("Value" AS BIGINT) AS VARCHAR) END AS "Text" FROM ({KPI_LONG})""",
        kpis("sales"),
    ),
    "monthly_growth": with_sales(
        """SELECT ROUND((cur_v - prev_v) / NULLIF(prev_v, 0) * 100, 4) AS growth_rate, cur AS current_period,
prev AS previous_period, ROUND(cur_v, 4) AS current_revenue, ROUND(prev_v, 4) AS previous_revenue FROM growth""",
        kpis("sales"),
    ),
    "kpi_by_category": with_sales(
        f"""SELECT Category, ROUND({sums("Revenue")}, 4) AS revenue, ROUND({sums("Profit")}, 4) AS profit,
ROUND({sums("Profit")} / NULLIF({sums("Revenue")}, 0) * 100, 4) AS profit_margin, COUNT(DISTINCT Order_ID) AS orders,
COUNT(DISTINCT Customer_ID) AS customers, ROUND({sums("Revenue")} / COUNT(DISTINCT Order_ID), 4) AS average_order_value
FROM sales GROUP BY 1"""
    ),
    "top_products": with_sales(f"SELECT Product, {TOTALS} FROM sales GROUP BY 1 ORDER BY Total_Revenue DESC, Product LIMIT 5"),
    "top_categories": with_sales(f"SELECT Category, {TOTALS} FROM sales GROUP BY 1 ORDER BY Total_Profit DESC, Category"),
    "monthly_revenue": with_sales(
        """SELECT strftime("Date", '%Y-%m') AS "Month", ROUND(CAST(SUM(Revenue) AS DOUBLE), 4) AS Total_Revenue,
ROUND(CAST(SUM(Profit) AS DOUBLE), 4) AS Total_Profit FROM sales WHERE "Date" IS NOT NULL GROUP BY 1 ORDER BY 1"""
    ),
    "customer_segments": segments(V.SEGMENT_VIP_FROM, *V.SEGMENT_REGULAR_RANGE),
    "customer_segments_scaled": segments(SEGMENT_VIP_FROM, *SEGMENT_REGULAR_RANGE),
    "best_customers": with_sales(
        """SELECT Customer_ID, COUNT(DISTINCT Order_ID) AS Orders, ROUND(CAST(SUM(Revenue) AS DOUBLE), 4) AS Total_Spend,
ROUND(CAST(SUM(Profit) AS DOUBLE), 4) AS Total_Profit FROM sales WHERE Customer_ID <> 'Unknown' GROUP BY 1
ORDER BY Total_Spend DESC, Customer_ID LIMIT 5"""
    ),
    "worst_products": with_sales(
        """SELECT Product, ROUND(r, 4) AS Total_Revenue, ROUND(p, 4) AS Total_Profit,
CASE WHEN r = 0 THEN 0 ELSE ROUND(p / r * 100, 2) END AS Margin_Pct
FROM (SELECT Product, CAST(SUM(Revenue) AS DOUBLE) AS r, CAST(SUM(Profit) AS DOUBLE) AS p FROM sales GROUP BY 1)
ORDER BY Margin_Pct, Product LIMIT 5"""
    ),
    "adhoc_sql": with_sales(
        """SELECT Category, COUNT(*) AS Transaction_Count, ROUND(CAST(SUM(Revenue) AS DOUBLE), 4) AS Total_Revenue
FROM sales GROUP BY Category"""
    ),
    "trend_monthly": trend("date_trunc('month', \"Date\")", "strftime(s, '%Y-%m')", "Month_Period", "MoM"),
    "trend_quarterly": trend("date_trunc('quarter', \"Date\")", "year(s) || 'Q' || quarter(s)", "Quarter_Period", "QoQ"),
    "trend_yearly": trend("date_trunc('year', \"Date\")", "strftime(s, '%Y')", "Year_Period", "YoY"),
    "best_worst_month": with_sales(
        """SELECT strftime(b.s, '%Y-%m') AS best_month, ROUND(b.r, 4) AS best_month_revenue,
strftime(w.s, '%Y-%m') AS worst_month, ROUND(w.r, 4) AS worst_month_revenue
FROM (SELECT * FROM by_month ORDER BY r DESC, s LIMIT 1) b, (SELECT * FROM by_month ORDER BY r, s LIMIT 1) w""",
        MONTHS,
    ),
    "fastest_category": with_sales(
        "SELECT Category AS fastest_growing_category, ROUND(rate, 4) AS fastest_growing_category_rate FROM fastest",
        MONTHS,
        FASTEST,
    ),
    "trend_insights": insights(),
    "rca_summary": rca_summary(),
    "rca_no_decline": rca_summary().replace("AS DECIMAL(18,4)) AS Revenue", "AS DECIMAL(18,4)) * -1 AS Revenue", 1),
    "rca_contributors": with_sales(RANKED, MONTHS, drivers()),
    "rca_top": with_sales(FALLEN + FIRST_FALLEN, MONTHS, drivers()),
    "rca_explanations": rca_explanations(),
    "rca_profit_contributors": with_sales(RANKED, MONTHS, drivers("Profit")),
    "null_counts": with_sales(
        f"""SELECT * FROM ({per_column("dirty", NULLS + " AS missing", '"column"')})""", DIRTY
    ),
    "duplicate_count": with_sales(f"SELECT {DUPLICATES} AS duplicate_rows", DIRTY),
    "invalid_dates": with_sales(f"SELECT ({BAD_DATES}) AS invalid_dates", DIRTY),
    "quality_report": with_sales(
        f"""SELECT 'Total Rows' AS item, NULL::VARCHAR AS "column", COUNT(*) AS value FROM dirty
UNION ALL SELECT 'Missing Values', c, n FROM ({per_column("dirty", NULLS + " AS n", "c")})
UNION ALL SELECT 'Duplicate Rows', NULL, {DUPLICATES} UNION ALL SELECT 'Invalid Dates', NULL, ({BAD_DATES})""",
        DIRTY,
    ),
    "quality_score": with_sales(
        f"SELECT ROUND((COUNT(*) * 9 - ({ALL_NULLS})) * 100.0 / (COUNT(*) * 9), 1)::DOUBLE AS quality_score FROM dirty", DIRTY
    ),
    "column_report": with_sales(COLUMN_REPORT, CLEAN),
    "clean_summary": clean_summary(),
    "clean_absent_columns": with_sales(
        """
SELECT (SELECT COUNT(*) FROM dirty) AS rows_before, COUNT(*) FILTER (WHERE TRY_STRPTIME("Date", '%Y-%m-%d') IS NOT NULL) AS rows_after,
       CAST(7 AS BIGINT) AS columns, (SELECT COUNT(*) FROM dirty) - COUNT(*) AS duplicate_rows_removed,
       'Customer_ID, Cost' AS missing_expected_columns
FROM (SELECT DISTINCT * EXCLUDE (Customer_ID, Cost) FROM dirty)""",
        DIRTY,
    ),
    "clean_actions": clean_actions(),
    "clean_rows": with_sales(
        'SELECT * REPLACE (ROUND(Revenue, 4) AS Revenue, ROUND(Cost, 4) AS Cost, ROUND(Profit, 4) AS Profit, '
        "ROUND(Quantity, 4) AS Quantity) FROM cleaned",
        CLEAN,
    ),
    "inferred_types": inferred(),
    "clean_by_type": with_sales(
        """
SELECT CAST(before.n AS BIGINT) AS rows_before, CAST(after.n AS BIGINT) AS rows_after,
       CAST(before.n - (SELECT COUNT(*) FROM singles) AS BIGINT) AS duplicate_rows_removed
FROM (SELECT COUNT(*) + COUNT(*) FILTER (WHERE CAST(Order_ID AS BIGINT) % 50 = 0) AS n FROM dirty) AS before,
     (SELECT COUNT(*) AS n FROM cleaned) AS after""",
        CLEAN,
    ),
    "date_format_vote": votes(),
    "clean_voted_dates": with_sales(
        """
SELECT "Date", COUNT(*) AS lines, ROUND(CAST(SUM(Revenue) AS DOUBLE), 4) AS revenue
FROM (SELECT DISTINCT * FROM dated WHERE cell IS NOT NULL) GROUP BY 1""",
        DATED,
    ),
    "clean_kpis": with_sales(kpi_row(3), CLEAN, kpis("cleaned")),
    "daily_revenue": with_sales('SELECT d AS "Date", ROUND(y, 4) AS revenue FROM daily', ALL),
    "daily_spine": with_sales('SELECT d AS "Date", ROUND(y, 4) AS revenue, x FROM dense', ALL),
    "trailing_mean": with_sales(
        """SELECT d AS "Date", ROUND(AVG(y) OVER (ORDER BY d ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 6) AS mean_14_days
FROM dense""",
        ALL,
    ),
    "forecast_lr": with_sales('SELECT d AS "Date", ROUND(lr, 4) AS "Forecast_LR" FROM future', ALL),
    "forecast_ma": with_sales('SELECT d AS "Date", ROUND(ma, 4) AS "Forecast_MA" FROM future', ALL),
    "forecast_rows": with_sales(
        """SELECT d AS "Date", ROUND(y, 4) AS "Actual_Revenue", NULL::DOUBLE AS "Forecast_MA", NULL::DOUBLE AS "Forecast_LR",
'Historical' AS "Type" FROM dense
UNION ALL SELECT d, ROUND(y, 4), ROUND(y, 4), ROUND(y, 4), 'Historical' FROM dense WHERE d = l
UNION ALL SELECT d, NULL, ROUND(ma, 4), ROUND(lr, 4), 'Forecast' FROM future""",
        ALL,
    ),
    "forecast_metrics": with_sales(
        """SELECT ROUND(slope, 4) AS slope, ROUND(intercept, 4) AS intercept, ROUND(mean, 4) AS average_historical_daily,
CAST(LEAST(w, n) AS INTEGER) AS window_days, ROUND(list_avg(ys[-w:]), 4) AS window_average,
(SELECT ROUND(SUM(ma), 4) FROM future) AS horizon_total_ma, (SELECT ROUND(SUM(lr), 4) FROM future) AS horizon_total_lr
FROM model""",
        ALL,
    ),
    "forecast_by_category": with_sales(
        'SELECT series, d AS "Date", ROUND(ma, 4) AS "Forecast_MA", ROUND(lr, 4) AS "Forecast_LR" FROM future',
        spine("Category"),
    ),
    "forecast_status_of_customers": with_sales(
        f"""SELECT Customer_ID AS series, COUNT(DISTINCT "Date") AS sale_days,
CASE WHEN COUNT(DISTINCT "Date") >= {V.FORECAST_MIN_DAYS} THEN 'ok' ELSE '{V.FORECAST_TEXTS["few_days"]}' END AS status
FROM sales WHERE Customer_ID IS NOT NULL AND "Date" IS NOT NULL AND Revenue IS NOT NULL GROUP BY Customer_ID"""
    ),
    "forecast_status": with_sales(
        f"""SELECT series, sold AS sale_days, CASE WHEN sold >= 5 THEN 'ok' ELSE {text(V.FORECAST_TEXTS["few_days"])} END
AS status FROM ends""",
        spine("Product"),
    ),
    "rec_margin": with_sales(LOW, COSTLY, kpis("costly")),
    "rec_loss_products": with_sales(loss("costly"), COSTLY),
    "rec_share_products": with_sales(share("sales")),
    "rec_customer_risk": with_sales(customer("sales")),
    "rec_quality": with_sales(AUDITS, CLEAN),
    "recommendations_all": with_sales(
        " UNION ALL ".join([LOW, loss("costly"), share("costly"), customer("costly"), AUDITS]), COSTLY, kpis("costly"), CLEAN
    ),
    "kpi_history": with_sales(
        f"""SELECT 'sales lines' AS source_name, (SELECT COUNT(*) FROM sales) AS row_count, growth_current_period,
growth_previous_period, "KPI" AS kpi_name, ROUND("Value", 4) AS kpi_value, "Unit" AS unit
FROM ({KPI_LONG}), (SELECT growth_current_period, growth_previous_period FROM kpi)""",
        kpis("sales"),
    ),
    "stored_sales": with_sales(
        """SELECT * REPLACE (ROUND(CAST(Revenue AS DOUBLE), 4) AS Revenue, ROUND(CAST(Cost AS DOUBLE), 4) AS Cost,
ROUND(CAST(Profit AS DOUBLE), 4) AS Profit) FROM numbered""",
        NUMBERED,
    ),
    "sales_json": with_sales(f"SELECT row_number, {JSON} AS sales_record FROM numbered", NUMBERED),
    "numbered_rows": with_sales('SELECT row_number, "Date", Order_ID, Customer_ID, Product, Category FROM numbered', NUMBERED),
    "preview_rows": with_sales(
        f"""SELECT * EXCLUDE (row_number) REPLACE (CAST(Revenue AS DOUBLE) AS Revenue, CAST(Cost AS DOUBLE) AS Cost,
CAST(Profit AS DOUBLE) AS Profit) FROM numbered WHERE row_number <= {V.PREVIEW_ROWS}""",
        NUMBERED,
    ),
    "csv_roundtrip": with_sales(
        "SELECT " + ", ".join(f'CAST("{name}" AS VARCHAR) AS "{name}"' for name in V.SALES_COLUMNS) + " FROM sales"
    ),
    "csv_two_orders": with_sales(
        "SELECT " + ", ".join(f'CAST("{name}" AS VARCHAR) AS "{name}"' for name in V.SALES_COLUMNS) + " FROM sales"
    ),
    "csv_quoted_breaks": with_sales(
        """SELECT Order_ID, Customer_ID, Product, Category, CASE CAST(Order_ID AS BIGINT) % 7
             WHEN 0 THEN Product || chr(10) || 'said "' || Category || '",' || chr(10) || Order_ID
             WHEN 1 THEN '"' || Category || '"'
             WHEN 2 THEN Category || chr(13) || chr(10) || ', ' || chr(10) || chr(10)
             WHEN 3 THEN Order_ID || ', ' || Product
             ELSE Product END AS note FROM sales"""
    ),
    "dim_products": with_sales(
        f"SELECT DISTINCT {PRODUCT_KEY} AS Product_ID, Product AS Product_Name, Category FROM sales"
    ),
    "dim_customers": with_sales("SELECT DISTINCT Customer_ID FROM sales"),
    "dim_calendar": with_sales(
        """SELECT d AS "Date", CAST(year(d) AS INTEGER) AS "Year", CAST(quarter(d) AS INTEGER) AS "Quarter",
CAST(month(d) AS INTEGER) AS "Month", monthname(d) AS "Month_Name", dayname(d) AS "Day_of_Week"
FROM (SELECT CAST(UNNEST(generate_series(MIN("Date"), MAX("Date"), INTERVAL 1 DAY)) AS DATE) AS d FROM sales)"""
    ),
    "fact_sales": with_sales(
        f"""SELECT Order_ID, "Date", Customer_ID, {PRODUCT_KEY} AS Product_ID, ROUND(CAST(Revenue AS DOUBLE), 4) AS "Revenue",
ROUND(CAST(Cost AS DOUBLE), 4) AS "Cost", ROUND(CAST(Profit AS DOUBLE), 4) AS "Profit", Quantity FROM sales"""
    ),
    "revenue_ytd": with_sales(
        """SELECT d AS "Date", ROUND(CAST(COALESCE(r, 0) AS DOUBLE), 4) AS revenue,
ROUND(CAST(COALESCE(SUM(r) OVER (PARTITION BY year(d) ORDER BY d), 0) AS DOUBLE), 4) AS revenue_ytd
FROM (SELECT CAST(UNNEST(generate_series(MIN("Date"), MAX("Date"), INTERVAL 1 DAY)) AS DATE) AS d FROM sales) days
LEFT JOIN (SELECT "Date" AS sold, SUM(Revenue) AS r FROM sales GROUP BY 1) ON sold = d"""
    ),
    "mom_calendar": with_sales(
        """SELECT strftime(m, '%Y-%m') AS "Month", ROUND(a.r, 4) AS revenue, ROUND(b.r, 4) AS prior_month_revenue,
ROUND(COALESCE((COALESCE(a.r, 0) - b.r) / NULLIF(b.r, 0), 0), 4) AS mom_growth
FROM (SELECT CAST(UNNEST(generate_series(MIN(s), MAX(s), INTERVAL 1 MONTH)) AS DATE) AS m FROM by_month) all_months
LEFT JOIN by_month a ON a.s = m LEFT JOIN by_month b ON b.s = m - INTERVAL 1 MONTH""",
        MONTHS,
    ),
    "star_measures": with_sales(f"SELECT {MEASURES} FROM sales"),
    "star_measures_by_product": with_sales(f"SELECT {PRODUCT_KEY} AS Product_ID, {MEASURES} FROM sales GROUP BY 1"),
}

# The same reports, read through a stored run.
ORACLE |= {"stored_report": ORACLE["top_products"], "stored_adhoc": ORACLE["adhoc_sql"]}
ORACLE |= {f"rolled_{name}": ORACLE[name] for name in ("trend_insights", "rca_contributors", "forecast_rows")}
