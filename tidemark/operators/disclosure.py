"""Disclosure control: counts of groups that show no small group and let none be worked out.

``small_groups`` protects one grouping and its total: groups under ``k_min`` rows are
folded into one row, and if that row is itself under ``k_min``, the smallest shown group
joins it.

``protected_table`` protects the cells of two groupings with their row, column and grand
totals. Small rows and columns are folded first, so every total can be shown. A cell
under ``k_min`` is hidden together with the three other corners of a rectangle, so it
lies on a cycle of hidden cells: adding and subtracting totals can never single it out.
Where the hidden cells of a row or column add up to less than ``k_min`` together, the
largest cell of that line is hidden too, again with a rectangle.

Everything works on the table of counted groups, by joins and windows; only the names
of the two largest rows and columns reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import qcol
from tidemark.session import checkpoint_dir

K_MIN = 10
#: Name of the row that small groups are folded into.
OTHER = "(other)"


def small_groups(counts: DataFrame, keys: list[str], rows: str = "rows", k_min: int = K_MIN) -> DataFrame:
    """The counted groups (``keys`` and ``rows``) with ``small``: whether the group is folded.

    If the small groups together are under ``k_min``, the smallest other group is folded with them.
    """
    small = F.col(rows) < k_min
    folded = counts.where(small).agg(F.coalesce(F.sum(rows), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("k")).first()
    need = k_min - folded["n"] if folded["k"] else 0
    if need <= 0:
        return counts.withColumn("small", small)
    # A group that is not small has ``k_min`` rows, so one makes up for what is missing.
    order = [F.col(rows), *(qcol(k).asc_nulls_first() for k in keys)]
    extra = counts.where(~small).orderBy(*order).limit(1).select(*(qcol(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.lit(True).alias("_extra"))
    joined = counts.join(F.broadcast(extra), [qcol(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left")
    return joined.select(*counts.columns, (small | F.coalesce("_extra", F.lit(False))).alias("small"))


def _folded(df: DataFrame, column: str, k_min: int, name: str) -> DataFrame:
    """The rows with ``name``: the column's value as text, or ``OTHER``."""
    counts = df.groupBy(qcol(column).cast("string").alias("_name")).agg(F.count(F.lit(1)).alias("rows"))
    groups = small_groups(counts, ["_name"], k_min=k_min).select("_name", "small")
    joined = df.join(groups, qcol(column).cast("string").eqNullSafe(F.col("_name")), "left")
    return joined.withColumn(name, F.when(F.col("small"), F.lit(OTHER)).otherwise(F.coalesce("_name", F.lit("(none)")))).drop("_name", "small")


def _largest(cells: DataFrame, name: str) -> list[str]:
    rows = cells.groupBy(name).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), name).limit(2).collect()
    return [r[name] for r in rows]


def _rectangles(hidden: DataFrame, rows: list[str], columns: list[str]) -> DataFrame:
    """The hidden cells with the other corners of a rectangle over the largest row and column (the second largest for cells in those)."""
    r = F.when(F.col("row") == rows[0], rows[1]).otherwise(rows[0])
    c = F.when(F.col("column") == columns[0], columns[1]).otherwise(columns[0])
    corners = F.array(*(F.struct(a.alias("row"), b.alias("column")) for a in (F.col("row"), r) for b in (F.col("column"), c)))
    return hidden.select(F.explode(corners).alias("x")).select("x.row", "x.column").distinct()


def protected_table(df: DataFrame, row: str, column: str, k_min: int = K_MIN) -> DataFrame:
    """row, column, rows (null if hidden), hidden: all cells, with totals where row or column is null.

    If one of the groupings has a single group left, the cells are the other's totals;
    then there is nothing to hide beyond what was folded. A table of fewer than
    ``k_min`` rows shows nothing.
    """
    checkpoint_dir(df.sparkSession)
    if df.count() < k_min:
        return df.sparkSession.createDataFrame([], "row string, column string, rows long, hidden boolean")
    folded = _folded(_folded(df.select(qcol(row).alias("_r"), qcol(column).alias("_c")), "_r", k_min, "row"), "_c", k_min, "column")
    cells = folded.groupBy("row", "column").agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    rows, columns = _largest(cells, "row"), _largest(cells, "column")
    hidden = cells.where(F.col("n") < k_min).select("row", "column")
    if len(rows) == 2 and len(columns) == 2:
        hidden = _rectangles(hidden, rows, columns).checkpoint(eager=True)
        while True:
            more = _thin_lines(cells, hidden, k_min)
            grown = _rectangles(hidden.unionByName(more), rows, columns).checkpoint(eager=True)
            if grown.count() == hidden.count():
                break
            hidden = grown
    # Hidden cells without rows are told too, else their absence would show that they are empty.
    joined = cells.join(hidden.withColumn("hidden", F.lit(True)), ["row", "column"], "full")
    hide = F.coalesce("hidden", F.lit(False))
    shown = joined.select("row", "column", F.when(~hide, F.col("n")).alias("rows"), hide.alias("hidden"))
    none = F.lit(None).cast("string")
    totals = [
        cells.groupBy("row").agg(F.sum("n").alias("rows")).select("row", none.alias("column"), "rows", F.lit(False).alias("hidden")),
        cells.groupBy("column").agg(F.sum("n").alias("rows")).select(none.alias("row"), "column", "rows", F.lit(False).alias("hidden")),
        cells.agg(F.sum("n").alias("rows")).where("rows IS NOT NULL").select(none.alias("row"), none.alias("column"), "rows", F.lit(False).alias("hidden")),
    ]
    if len(rows) < 2 or len(columns) < 2:
        totals = totals[2:]  # the cells are the totals of the other grouping
    for part in totals:
        shown = shown.unionByName(part)
    return shown


def _thin_lines(cells: DataFrame, hidden: DataFrame, k_min: int) -> DataFrame:
    """The largest shown cell of every row and column whose hidden cells add up to less than ``k_min``."""
    marked = cells.join(hidden.withColumn("hidden", F.lit(True)), ["row", "column"], "full").select("row", "column", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hidden", F.lit(False)).alias("hidden"))
    out = None
    for line, other in (("row", "column"), ("column", "row")):
        per = marked.groupBy(line).agg(
            F.sum(F.when(F.col("hidden"), F.col("n"))).alias("concealed"),
            F.max(F.when(~F.col("hidden") & (F.col("n") > 0), F.struct("n", other)))[other].alias(other),
        )
        thin = per.where((F.col("concealed") < k_min) & F.col(other).isNotNull()).select("row", "column")
        out = thin if out is None else out.unionByName(thin)
    return out
