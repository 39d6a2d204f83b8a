"""Dimensions and missing values (one wide aggregate, then long form).

Every metric here is a partial + final hash aggregate over one scan; the
per-column results are produced by exploding the single aggregated row, so
no shuffle carries more than one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import (
    balanced,
    explode_structs,
    is_missing,
    missing_count_per_row,
    pct,
    profiled_fields,
)

Key = str | Sequence[str] | None


def _missing_aggregate(df: DataFrame, key: Key) -> tuple[DataFrame, int]:
    fields = profiled_fields(df, key)
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count_if(is_missing(f)).alias(f"_m{i}") for i, f in enumerate(fields)]
    return df.agg(*aggs), len(fields)


def dimensions(df: DataFrame, key: Key = None) -> DataFrame:
    """rows, columns, total_cells, informed_cells, null_cells, completeness_pct."""
    agg, n = _missing_aggregate(df, key)
    null_cells = balanced(add, [F.col(f"_m{i}") for i in range(n)], F.lit(0).cast("long"))
    total = F.col("rows") * F.lit(n).cast("long")
    return agg.select(
        F.col("rows"),
        F.lit(n).alias("columns"),
        total.alias("total_cells"),
        (total - null_cells).alias("informed_cells"),
        null_cells.alias("null_cells"),
        pct(total - null_cells, total).alias("completeness_pct"),
    )


def nulls_by_column(df: DataFrame, key: Key = None) -> DataFrame:
    """Per column: position, column, nulls, nulls_pct, non_nulls, completeness_pct."""
    fields = profiled_fields(df, key)
    agg, _ = _missing_aggregate(df, key)
    rows = F.col("rows")
    structs = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(f.name).alias("column"),
            F.col(f"_m{i}").alias("nulls"),
            (rows - F.col(f"_m{i}")).alias("non_nulls"),
            rows.alias("rows"),
        )
        for i, f in enumerate(fields)
    ]
    long = agg.select(explode_structs(structs))
    return long.select(
        "position",
        "column",
        "nulls",
        pct(F.col("nulls"), F.col("rows")).alias("nulls_pct"),
        "non_nulls",
        pct(F.col("non_nulls"), F.col("rows")).alias("completeness_pct"),
    )


def row_completeness(df: DataFrame, key: Key = None) -> DataFrame:
    """all_null_rows, rows_with_nulls, complete_rows (one row)."""
    fields = profiled_fields(df, key)
    k = missing_count_per_row(fields)
    n = len(fields)
    return df.select(k.alias("k")).agg(
        F.count_if(F.col("k") == n).alias("all_null_rows"),
        F.count_if(F.col("k") > 0).alias("rows_with_nulls"),
        F.count_if(F.col("k") == 0).alias("complete_rows"),
    )


def nulls_per_row(df: DataFrame, key: Key = None) -> DataFrame:
    """Distribution of missing cells per row: nulls_in_row, rows, rows_pct.

    The grouping key has at most ``columns + 1`` values and is pre-aggregated
    map-side, so even a hot value costs one row per task in the shuffle.
    """
    k = missing_count_per_row(profiled_fields(df, key))
    counts = df.select(k.alias("nulls_in_row")).groupBy("nulls_in_row").agg(F.count(F.lit(1)).alias("rows"))
    total = F.sum("rows").over(Window.partitionBy())
    return counts.select("nulls_in_row", "rows", pct(F.col("rows"), total).alias("rows_pct"))


def missing_ranking(df: DataFrame, key: Key = None) -> DataFrame:
    """Null share per column ranked descending (the data behind the null bar chart)."""
    by_col = nulls_by_column(df, key)
    order = Window.orderBy(F.col("nulls_pct").desc(), F.col("position").asc())
    return by_col.select(F.row_number().over(order).alias("rank"), "column", "nulls_pct")
