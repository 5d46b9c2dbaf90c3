"""Values the results depend on: names, labels, thresholds, patterns and wordings.

Everything here is a FIXED VALUE. It is data, not logic: a result is only right when
these texts and numbers are exactly these.
"""

from __future__ import annotations

# --- fixed values: columns -------------------------------------------------------
SALES_COLUMNS = [
    "Date",
    "Order_ID",
    "Customer_ID",
    "Product",
    "Category",
    "Revenue",
    "Cost",
    "Profit",
    "Quantity",
]
NUMERIC_COLUMNS = ["Revenue", "Cost", "Profit", "Quantity"]
UNSIGNED_COLUMNS = ["Revenue", "Cost", "Quantity"]
TEXT_COLUMNS = ["Order_ID", "Customer_ID", "Product", "Category"]
KPI_COLUMNS = ["Revenue", "Profit", "Order_ID", "Customer_ID"]
DRIVER_DIMENSIONS = ["Category", "Product", "Customer_ID"]
DRIVER_METRICS = ["Revenue", "Profit"]
UNKNOWN = "Unknown"

# --- fixed values: parsing -------------------------------------------------------
# Cell texts that mean "no value" in a CSV file (the public pandas default list).
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Every character str.strip() removes in Python, as a regular expression class.
WHITESPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
CURRENCY_MARKS = "$,"
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
WHOLE_PATTERN = r"^[+-]?\d+$"
BOOLEAN_TEXTS = ["True", "TRUE", "true", "False", "FALSE", "false"]
# Formats that read the same cells differently; one of them is chosen per file.
DATE_RIVALS = ("M/d/yyyy", "d/M/yyyy")
DATE_FORMATS = ("yyyy-M-d", "yyyy-M-d H:mm[:ss][.SSSSSS]", "yyyy-M-d'T'H:mm[:ss][.SSSSSS]", "M/d/yyyy")

# --- fixed values: KPI table -----------------------------------------------------
# (KPI, unit, snapshot column)
KPI_UNITS = [
    ("Revenue", "currency", "revenue"),
    ("Profit", "currency", "profit"),
    ("Profit Margin", "percent", "profit_margin"),
    ("Average Order Value", "currency", "average_order_value"),
    ("Orders", "count", "orders"),
    ("Customers", "count", "customers"),
    ("Monthly Growth Rate", "percent", "growth_rate"),
]
# (KPI, Formula, Business Meaning)
KPI_DEFINITIONS = [
    ("Revenue", "Sum of Revenue", "Total sales generated."),
    ("Profit", "Sum of Profit", "Money remaining after costs."),
    ("Profit Margin", "(Profit / Revenue) x 100", "Profit earned per 100 units of revenue."),
    ("Average Order Value", "Revenue / Unique Orders", "Average revenue generated by one order."),
    ("Orders", "Count of Unique Order_ID", "Number of distinct orders."),
    ("Customers", "Count of Unique Customer_ID", "Number of distinct customers."),
    (
        "Monthly Growth Rate",
        "((Latest Month Revenue - Previous Month Revenue) / Previous Month Revenue) x 100",
        "Revenue change between the latest two months.",
    ),
]

# --- fixed values: reports -------------------------------------------------------
REPORT_TITLES = {
    "top_products": "Top Products by Revenue",
    "top_categories": "Top Categories by Profit",
    "monthly_revenue": "Monthly Revenue and Profit Trends",
    "customer_segments": "Customer Segmentation (RFM Spend Profile)",
    "best_customers": "Best Customers by Total Spend",
    "worst_products": "Worst Performing Products (Lowest Margins)",
}
REPORT_ROWS = 5
PREVIEW_ROWS = 20
SEGMENT_VIP = "VIP (Spend >= $15k)"
SEGMENT_REGULAR = "Regular (Spend $3k - $15k)"
SEGMENT_OCCASIONAL = "Occasional (Spend < $3k)"
# VIP from this spend on; Regular is the closed range. The range between 14999 and 15000
# belongs to neither and is Occasional.
SEGMENT_VIP_FROM = 15000
SEGMENT_REGULAR_RANGE = (3000, 14999)
REFUSED_WORDS = ["DROP", "DELETE", "UPDATE", "INSERT", "ALTER", "CREATE", "TRUNCATE"]

# --- fixed values: trends and forecast -------------------------------------------
GROWTH_FLOOR = 10.0
FORECAST_MIN_DAYS = 5
FORECAST_LONG_WINDOW = 14
FORECAST_SHORT_WINDOW = 7
FORECAST_HORIZON = 30

# --- fixed values: recommendation rules ------------------------------------------
LOW_MARGIN = 15.0
URGENT_MARGIN = 5.0
LOSS_PRODUCTS_SHOWN = 2
PRODUCT_SHARE = 0.20
CUSTOMER_SHARE_PCT = 25.0
CUSTOMER_SHARE_HIGH_PCT = 40.0

# --- fixed values: recommendation wordings ({} marks an inserted value) ------------
# rule -> (title, category, trigger reason, description)
RULE_TEXTS = {
    "margin": (
        "Conduct Urgent Cost & Pricing Review",
        "Pricing & Strategy",
        "Overall profit margin is currently low at {margin}%.",
        "Your business is generating sales but keeping very little profit. "
        "We recommend reviewing vendor costs for raw inventory, audit shipping expenses, "
        "or raising prices on low-margin products by 3-5% to expand operational room.",
    ),
    "loss": (
        "Review Cost Structure for Product: {product}",
        "Pricing & Strategy",
        "Product '{product}' operates at a net loss (Margin: {margin}%, Profit: -${loss}).",
        "Every sale of {product} is draining cash from the company. "
        "Investigate if supplier rates have risen, check if this product is being "
        "heavily discounted, or negotiate better manufacturing costs immediately.",
    ),
    "share": (
        "Increase Inventory Buffer for High-Seller: {product}",
        "Inventory Management",
        "{product} is a critical revenue driver representing {share}% of total sales.",
        "Because {product} represents a major share of your sales, running out of stock "
        "would cause immediate and significant revenue loss. We recommend establishing "
        "a higher safety stock threshold with your logistics team to prevent stockouts.",
    ),
    "customer": (
        "Mitigate Customer Concentration Risk (Customer: {customer})",
        "Customer Relationship",
        "A single client represents {share}% of total revenue.",
        "Customer '{customer}' contributes ${revenue} to your business. "
        "If this customer leaves, it would cause a severe revenue contraction. "
        "Recommend establishing an executive relationship, offering loyalty discounts, "
        "and actively marketing to new segments to diversify your income stream.",
    ),
    "duplicates": (
        "Audit Sales CSV Integration Script",
        "Data Operations",
        "{rows} exact duplicate row(s) were automatically purged during upload.",
        "Duplicate rows suggest that transactions are being written twice to the raw export file, "
        "possibly due to database refresh issues or API double-post requests. Ask your data engineering team "
        "to review the webhook logging script to ensure order IDs are unique at source.",
    ),
    "dates": (
        "Establish Clean Date Encoding Formats",
        "Data Operations",
        "{rows} row(s) contained corrupt or unparseable dates.",
        "Invalid date records had to be dropped to calculate accurate monthly growth metrics. "
        "Verify if dates are entered manually by sales reps or if there are timezone encoding errors "
        "in the export. Standardize all data collections to ISO-8601 (YYYY-MM-DD).",
    ),
}

# --- fixed values: sentences -----------------------------------------------------
ACTION_TEXTS = {
    "duplicates": "Removed {rows} duplicate rows.",
    "dates": "Removed {rows} rows with invalid dates.",
    "no_date": "Date column not supplied; date validation skipped.",
    "negatives": "Sanitized {rows} negative values in '{column}' by taking their absolute value.",
    "profit": "Derived {rows} missing Profit values as Revenue - Cost.",
    "median": "Filled {rows} empty {column} rows with median ({value}).",
    "text": "Replaced {rows} empty {column} values with 'Unknown'.",
    "columns": "Optional expected columns missing: {columns}",
}
TREND_TEXTS = {
    "revenue": "Revenue {direction} by {growth}% in the latest month ({current}) "
    "compared to the previous month ({previous}) (${now} vs ${before}).",
    "profit": "Net Profit {direction} by {growth}% in the latest month (${now} vs ${before}).",
    "quarter": "Quarterly Revenue {direction} by {growth}% in {current} compared to {previous} (${now} vs ${before}).",
    "peak": "Peak sales occurred in {month} with total revenue of ${revenue}.",
    "category": "Fastest-growing category is **{category}** with a Month-over-Month growth rate of **{growth}%**.",
}
DRIVER_TEXTS = {
    "no_data": "Insufficient data or missing columns to perform root cause analysis.",
    "one_month": "At least two months of historical data are required to run Root Cause Analysis.",
    "no_decline": "No decline detected! Overall {metric} increased by **{pct}%** "
    "from {previous} to {current} (+${change}).",
    "decline": "Overall {metric} declined by **{pct}%** (-${drop}) "
    "from {previous} (${before}) to {current} (${now}).",
    "dimension": "Within **{dimension}**, the largest drag was **{member}**. "
    "Its {metric} sales fell from ${before} to ${now} (a **{pct}%** drop), "
    "which alone explains **{share}%** of the overall company-wide decline.",
}
FORECAST_TEXTS = {
    "no_data": "Insufficient data or missing columns to run forecast models.",
    "few_days": "At least 5 unique days of historical sales are required to generate forecasts.",
}
KPI_ERRORS = {
    "columns": "KPI calculations require these missing columns: ",
    "empty": "KPI calculations require at least one cleaned sales row.",
}
EMPTY_INPUT = "The uploaded CSV does not contain any data rows."
METRIC_ERROR = "Root Cause Analysis is only supported for 'Revenue' or 'Profit'."
SELECT_ERROR = "Security error: Only SELECT queries are allowed."
REFLECTIVE_WORDS = ["REFLECT", "JAVA_METHOD"]
CLAUSE_ERROR = "Security error: '{name}' is not allowed in a query."
TABLE_ERROR = "Security error: Table '{name}' is not part of the run store."
WORD_ERROR = "Security error: Use of forbidden keyword '{word}' is not allowed."
