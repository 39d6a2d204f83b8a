"""Exact duplicate rows (every member of a group of size >= 2 counts).

Grouping is on all profiled columns with Spark's null-safe grouping (null
groups with null, NaN with NaN). Whole rows are not shuffled for every row:
a 128-bit fingerprint is counted first, and only rows whose fingerprint
repeats go on to the exact full-row grouping (so the result stays exact).
Counts are pre-aggregated map-side, so one group holding a third of the rows
costs one row per map task in each shuffle. Member rows are found with semi
joins: a broadcast only for the ``limit`` groups of the examples (a bound
fixed by the argument), a shuffled semi join otherwise, whose hot partitions
AQE splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import FLOATING_TYPES, as_key_list, pct, profiled_fields, qcol
from tidemark.functions.terms import EXAMPLE_LIMIT

Key = str | Sequence[str] | None


def _group_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.groupBy(*[qcol(c) for c in cols]).agg(F.count(F.lit(1)).alias("_n"))


def canonical(field: T.StructField) -> Column:
    """Value as grouping sees it: one NaN, and -0.0 equal to 0.0 (hashes see raw bits)."""
    c = qcol(field.name)
    if isinstance(field.dataType, FLOATING_TYPES):
        return F.when(F.isnan(c), F.lit(float("nan"))).when(c == 0, F.lit(0.0)).otherwise(c)
    return c


def fingerprint(df: DataFrame, cols: list[str]) -> Column:
    """128-bit row fingerprint (two seeded xxhash64) over canonical values."""
    fields = {f.name: f for f in df.schema.fields}
    values = [canonical(fields[c]) for c in cols]
    return F.struct(F.xxhash64(F.lit(17), *values).alias("h1"), F.xxhash64(F.lit(31), *values).alias("h2"))


def candidate_rows(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose fingerprint repeats, fingerprint counts).

    Rows with a unique fingerprint are unique rows, so they leave before any
    full-row shuffle; only the 16-byte fingerprint of every row is shuffled.
    Rows that share a fingerprint are grouped by all columns afterwards, which
    keeps the result exact whatever the collisions.
    """
    fp = df.select(fingerprint(df, cols).alias("_fp"))
    counts = fp.groupBy("_fp").agg(F.count(F.lit(1)).alias("_c"))
    repeated = counts.where(F.col("_c") > 1).select("_fp")
    rows = df.withColumn("_fp", fingerprint(df, cols)).join(repeated, "_fp", "left_semi").drop("_fp")
    return rows, counts


def exact_duplicates(df: DataFrame, key: Key = None) -> DataFrame:
    """duplicate_rows, duplicate_rows_pct, duplicate_groups, largest_group (one row)."""
    cols = [f.name for f in profiled_fields(df, key)]
    rows, counts = candidate_rows(df, cols)
    groups = _group_counts(rows, cols).where(F.col("_n") > 1)
    n = F.col("_n")
    agg = groups.agg(
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("duplicate_rows"),
        F.count(F.lit(1)).alias("duplicate_groups"),
        F.coalesce(F.max(n), F.lit(0)).cast("long").alias("largest_group"),
    )
    total = counts.agg(F.coalesce(F.sum("_c"), F.lit(0))).scalar()
    return agg.select(
        "duplicate_rows",
        pct(F.col("duplicate_rows"), total).alias("duplicate_rows_pct"),
        "duplicate_groups",
        "largest_group",
    )


def _null_safe_match(left: DataFrame, right: DataFrame, cols: list[str], how: str) -> DataFrame:
    renamed = right.select(*[qcol(c).alias(f"_g{i}") for i, c in enumerate(cols)])
    cond = [qcol(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(cols)]
    return left.join(renamed, cond, how)


def duplicate_examples(df: DataFrame, key: Key = None, limit: int = EXAMPLE_LIMIT) -> DataFrame:
    """The first ``limit`` duplicated rows ordered by key (then by all columns), key columns first.

    The rows that can appear come from the ``limit`` groups with the smallest
    first member, so only those groups (at most ``limit`` rows) are broadcast.
    """
    keys = as_key_list(key)
    cols = [f.name for f in profiled_fields(df, key)]
    order = keys + cols
    first = F.min(F.struct(*[qcol(c) for c in order])) if keys else F.lit(None)
    rows, _ = candidate_rows(df, cols)
    groups = rows.groupBy(*[qcol(c) for c in cols]).agg(F.count(F.lit(1)).alias("_n"), first.alias("_first"))
    dup = groups.where(F.col("_n") > 1)
    first_groups = dup.orderBy(F.col("_first"), *[qcol(c) for c in cols]).limit(limit)
    members = _null_safe_match(rows, F.broadcast(first_groups), cols, "left_semi")
    return members.select(*[qcol(c) for c in order]).orderBy(*[qcol(c) for c in order]).limit(limit)


def duplicate_row_keys(df: DataFrame, key: Key) -> DataFrame:
    """Key of every row that belongs to a duplicate group, as a DataFrame (never collected)."""
    keys = as_key_list(key)
    if not keys:
        raise ValueError("duplicate_row_keys needs a row key")
    cols = [f.name for f in profiled_fields(df, key)]
    rows, _ = candidate_rows(df, cols)
    dup = _group_counts(rows, cols).where(F.col("_n") > 1).select(*[qcol(c) for c in cols])
    return _null_safe_match(rows, dup, cols, "left_semi").select(*[qcol(c) for c in keys])
