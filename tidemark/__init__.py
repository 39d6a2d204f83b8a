"""tidemark: table-quality profiling on Spark.

Reports dimensions, completeness, duplicates, identifier candidates, constant
columns, text defects, category variants, numeric statistics with IQR
outliers, date conversion and temporal consistency, and folds them into one
status summary. It reports and never cleans: inputs are never changed.
"""

__version__ = "0.1.0"
