"""Stand-in inputs for the registered queries, derived from the test tables.

The test tables are clean (no nulls, no duplicates, no text dates), so the
profile needs a table with defects. Each stand-in is one SQL text that Spark
and DuckDB both run unchanged (``{table}`` placeholders become DataFrames in
Spark and view names in DuckDB). The derivations only shape rows: they keep
every row of the source table, add no result and are not read by the library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)

# --- fixed values of the registered queries: cut dates, background row, price limits, statements
TIME_CUTS = ("1997-01-01 00:00:00", "1998-01-01 00:00:00")
BACKGROUND = {"o_totalprice": 150_000.0, "o_custkey": 750.0}
PRICE_LIMITS = (1_000.0, 300_000.0)
STATEMENTS = (
    ("Half of the good documents are found", "test", None, "recall", ">=", 0.5),
    ("Longer documents rank above shorter ones", "test", None, "roc_auc", ">", 0.5),
    ("No document is flagged wrongly", "test", None, "fp", "=", 0.0),
    ("English documents are flagged precisely", "language", "en", "precision", ">=", 0.5),
    ("Latin documents are flagged precisely", "language", "la", "precision", ">=", 0.5),
)

# A census-like table: nulls, blanks, textual nulls, case and accent variants,
# a constant and an empty column, and text dates in several layouts with failures.
CENSUS = """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS id_cliente,
       o_orderstatus AS estado,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS valor_total,
       CASE WHEN o_orderkey % 13 = 0 THEN 'SIN DATO'
            WHEN o_orderkey % 17 = 0 THEN ''
            WHEN o_orderkey % 23 = 0 THEN o_orderpriority || '  '
            WHEN o_orderkey % 5 = 0 THEN ' ' || o_orderpriority
            WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority)
            ELSE o_orderpriority END AS prioridad,
       'A' AS constante,
       CAST(NULL AS STRING) AS vacia,
       CASE WHEN o_orderkey % 19 = 0 THEN 'mal'
            WHEN o_orderkey % 7 = 1 THEN substr(d, 6, 2) || '/' || substr(d, 9, 2) || '/' || substr(d, 1, 4)
            WHEN o_orderkey % 5 = 1 THEN replace(d, '-', '')
            ELSE d END AS fecha_ingreso,
       CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 - 2 AS INT) AS STRING) AS fecha_salida
FROM (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderdate,
             CAST(CAST(o_orderdate AS DATE) AS STRING) AS d
      FROM {orders}) AS src
"""

# Admission and exit per order line: many lines ship before the order date.
STAY = """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey,
       o.o_orderdate AS fecha_ingreso, l.l_shipdate AS fecha_salida
FROM {lineitem} AS l JOIN {orders} AS o ON l.l_orderkey = o.o_orderkey
"""

# Orders with headers as a spreadsheet would hold them (accents, symbols, repeats).
MESSY_ORDERS = """
SELECT o_orderkey AS "  Número Orden", o_custkey AS "Cliente ID", o_orderstatus AS "Estado",
       o_totalprice AS "Valor Total ($)", o_orderdate AS "Fecha Ingreso", o_orderpriority AS "fecha ingreso"
FROM {orders}
"""

# Orders without their key, a quarter of them twice: whole rows repeat.
DUP_ORDERS = """
SELECT o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM {orders}
UNION ALL
SELECT o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM {orders} WHERE o_orderkey % 4 = 0
"""

# Order dates as text in further layouts: clock, AM / PM, offset, day first with dashes.
DATE_LAYOUTS = """
SELECT o_orderkey,
       CASE o_orderkey % 6
            WHEN 0 THEN y || '-' || m || '-' || d || 'T10:00:00-05:00'
            WHEN 1 THEN d || '-' || m || '-' || y
            WHEN 2 THEN m || '/' || d || '/' || y || ' 10:30'
            WHEN 3 THEN y || '-' || m || '-' || d || ' 10:30 PM'
            WHEN 4 THEN y || '-' || m || '-' || d || 'T10:00:00Z'
            ELSE 'mal' END AS fecha
FROM (SELECT o_orderkey, substr(t, 1, 4) AS y, substr(t, 6, 2) AS m, substr(t, 9, 2) AS d
      FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS t FROM {orders}) AS a) AS b
"""

VIEWS = {"census": CENSUS, "dup_orders": DUP_ORDERS, "date_layouts": DATE_LAYOUTS, "stay": STAY, "messy_orders": MESSY_ORDERS}
_DEPENDS = {"census": ("orders",), "dup_orders": ("orders",), "date_layouts": ("orders",), "stay": ("lineitem", "orders"), "messy_orders": ("orders",)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a stand-in view, as a DataFrame."""
    if name in VIEWS:
        tables = {t: table(spark, sf_dir, t) for t in _DEPENDS[name]}
        text = VIEWS[name]
        if name == "messy_orders":
            text = text.replace('"', "`")
        return spark.sql(text, **tables)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def duckdb_view(name: str) -> str:
    """The stand-in as a DuckDB subquery over the pre-registered views."""
    text = VIEWS[name]
    for t in _DEPENDS[name]:
        text = text.replace("{" + t + "}", t)
    return f"({text})"
