"""Sales KPI analytics expressed as PySpark DataFrame plans.

Sub-packages
    functions   column expressions (text, numbers, periods, wording)
    sources     CSV files, star tables, the Parquet run store, staged tables
    operators   one module per analysis, DataFrame in and DataFrame out
    plans       operators chained into complete jobs
"""
