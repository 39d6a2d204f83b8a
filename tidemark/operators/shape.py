"""Column shape: inventory, identifier candidates, empty / constant columns.

Exact mode reads the hashed frequency table (``operators.frequencies``), combined
map-side, so long texts are not shuffled and regexes run once per distinct short value;
a caller that has the table already passes it as ``freq``. ``approx=True`` uses
HyperLogLog++ instead, and counts frequencies only for columns that can be dominated.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import (
    FLOATING_TYPES,
    as_text,
    explode_structs,
    is_missing,
    pct,
    present,
    profiled_fields,
    type_name,
)
from tidemark.functions.terms import (
    ALNUM_ID,
    DIGITS_ONLY,
    DOMINANT_SHARE,
    IDENTIFIER_MIN_PATTERN,
    IDENTIFIER_MIN_UNIQUENESS,
    IDENTIFIER_TERMS,
    LOW_VARIABILITY_MAX_UNIQUE,
)
from tidemark.functions.text import fold_value
from tidemark.operators.frequencies import Frequencies, frequencies, groupable, value_identity

Key = str | Sequence[str] | None


def distinct_count(c: Column, approx: bool = False, rsd: float = 0.01) -> Column:
    return F.approx_count_distinct(c, rsd) if approx else F.count_distinct(c)


def column_inventory(
    df: DataFrame,
    key: Key = None,
    mapping: Mapping[str, str] | None = None,
    approx: bool = False,
    freq: Frequencies | None = None,
) -> DataFrame:
    """position, original_name, normalized_name, data_type, non_null, distinct."""
    fields = profiled_fields(df, key)
    mapping = dict(mapping or {})
    if not approx and fields:
        return _inventory_from_frequencies(df, fields, mapping, freq)
    aggs = [F.count_if(~is_missing(f)).alias(f"_nn{i}") for i, f in enumerate(fields)]
    aggs += [
        (distinct_count(present(f), approx) if groupable(f) else F.lit(None).cast("long")).alias(f"_d{i}")
        for i, f in enumerate(fields)
    ]
    agg = df.agg(*aggs) if fields else df.agg(F.count(F.lit(1)).alias("_rows"))
    structs = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(mapping.get(f.name, f.name)).alias("original_name"),
            F.lit(f.name).alias("normalized_name"),
            F.lit(type_name(f)).alias("data_type"),
            F.col(f"_nn{i}").alias("non_null"),
            F.col(f"_d{i}").cast("long").alias("distinct"),
        )
        for i, f in enumerate(fields)
    ]
    return agg.select(explode_structs(structs)) if structs else agg.limit(0)


def _inventory_from_frequencies(df: DataFrame, fields: Sequence[T.StructField], mapping: Mapping[str, str], freq: Frequencies | None) -> DataFrame:
    """Exact distinct counts from the frequency table: work linear in the number of columns.

    Several exact ``count_distinct`` in one aggregate become an ``Expand`` that
    copies every row once per column, which does not hold on wide tables.
    """
    meta = df.sparkSession.createDataFrame(
        [(i + 1, mapping.get(f.name, f.name), f.name, type_name(f), groupable(f)) for i, f in enumerate(fields)],
        "position int, original_name string, normalized_name string, data_type string, groupable boolean",
    )
    freq = freq or frequencies(df, [f for f in fields if groupable(f)])
    counts = freq.table.groupBy("c").agg(F.sum("n").alias("non_null"), F.count(F.lit(1)).alias("distinct"))
    counts = counts.join(F.broadcast(freq.names()), "c").select(F.col("column").alias("normalized_name"), "non_null", "distinct")
    maps = [f for f in fields if not groupable(f)]
    if maps:
        informed = df.agg(*[F.count_if(~is_missing(f)).alias(f"_nn{i}") for i, f in enumerate(maps)])
        structs = [F.struct(F.lit(f.name).alias("normalized_name"), F.col(f"_nn{i}").alias("non_null"), F.lit(None).cast("long").alias("distinct")) for i, f in enumerate(maps)]
        counts = counts.unionByName(informed.select(explode_structs(structs)))
    zero = F.lit(0).cast("long")
    # Every side holds at most one row per column.
    joined = meta.join(F.broadcast(counts), "normalized_name", "left")
    return joined.orderBy("position").select(
        "position",
        "original_name",
        "normalized_name",
        "data_type",
        F.coalesce("non_null", zero).alias("non_null"),
        F.when(F.col("groupable"), F.coalesce("distinct", zero)).alias("distinct"),
    )


def identifier_name_match(name: str, terms: Sequence[str] = IDENTIFIER_TERMS) -> bool:
    """Folded name (spaces as underscores) contains any term, substrings included."""
    folded = fold_value(name).replace(" ", "_")
    return any(t in folded for t in terms)


def identifier_candidates(
    df: DataFrame,
    key: Key = None,
    terms: Sequence[str] = IDENTIFIER_TERMS,
    min_uniqueness: float = IDENTIFIER_MIN_UNIQUENESS,
    min_pattern: float = IDENTIFIER_MIN_PATTERN,
    approx: bool = False,
    freq: Frequencies | None = None,
) -> DataFrame:
    """Columns that look like identifiers by name, or by uniqueness and an id-like pattern.

    Exact mode reads the frequency table, with the median length weighted by
    frequency. ``approx=True`` needs no shuffle: HyperLogLog++ distincts and an
    approximate median in one pass.
    """
    fields = [f for f in profiled_fields(df, key) if groupable(f)]
    if not fields:
        return df.sparkSession.createDataFrame([], _IDENTIFIER_SCHEMA)
    spark = df.sparkSession
    names = spark.createDataFrame(
        [(i + 1, f.name, identifier_name_match(f.name, terms)) for i, f in enumerate(fields)],
        "position int, column string, name_match boolean",
    )
    if approx:
        rows = df.agg(F.count(F.lit(1)).alias("rows")).scalar()
        stats = _identifier_stats_approx(df, fields)
    else:
        freq = freq or frequencies(df, fields, {"pattern"})
        rows, n = freq.rows, F.col("n")
        per_column = freq.table.groupBy("c").agg(
            F.sum(n).alias("_nn"),
            F.count(F.lit(1)).alias("_u"),
            F.sum(F.when(F.col("digits"), n).otherwise(0)).alias("_dg"),
            F.sum(F.when(F.col("alnum"), n).otherwise(0)).alias("_an"),
            F.min("length").alias("min_length"),
            F.max("length").alias("max_length"),
            # Weighted by frequency over distinct values; its buffer holds distinct *lengths* only.
            F.percentile("length", F.lit(0.5), n).alias("median_length"),
        )
        stats = per_column.join(F.broadcast(freq.names()), "c").drop("c", "position")
    # Every side holds at most one row per column: broadcasts of proven size.
    joined = names.join(F.broadcast(stats), "column", "left")
    nn = F.coalesce(F.col("_nn"), F.lit(0).cast("long"))
    u = F.coalesce(F.col("_u"), F.lit(0).cast("long"))
    long = joined.select(
        "position",
        "column",
        "name_match",
        pct(u, nn).alias("uniqueness_pct"),
        (nn - u).alias("repeated_values"),
        (rows - nn).alias("nulls"),
        F.col("min_length").cast("int").alias("min_length"),
        F.col("max_length").cast("int").alias("max_length"),
        F.col("median_length").cast("double").alias("median_length"),
        pct(F.col("_dg"), nn).alias("digits_pct"),
        pct(F.col("_an"), nn).alias("alnum_pct"),
        nn.alias("_nn"),
    )
    by_content = (
        (F.col("_nn") > 0)
        & (F.col("uniqueness_pct") >= min_uniqueness)
        & (F.greatest("digits_pct", "alnum_pct") >= min_pattern)
    )
    return long.where(F.col("name_match") | by_content).orderBy("position").drop("_nn", "position")


def _identifier_stats_approx(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    aggs = []
    for i, f in enumerate(fields):
        s = as_text(f)
        ln = F.length(s)
        aggs += [
            F.count(s).alias(f"_nn{i}"),
            F.approx_count_distinct(s, 0.01).alias(f"_u{i}"),
            F.count_if(s.rlike(DIGITS_ONLY)).alias(f"_dg{i}"),
            F.count_if(s.rlike(ALNUM_ID)).alias(f"_an{i}"),
            F.min(ln).alias(f"_lmin{i}"),
            F.max(ln).alias(f"_lmax{i}"),
            F.percentile_approx(ln, F.lit(0.5), F.lit(10000)).alias(f"_lmed{i}"),
        ]
    return df.agg(*aggs).select(
        explode_structs(
            [
                F.struct(
                    F.lit(f.name).alias("column"),
                    F.col(f"_nn{i}").alias("_nn"),
                    F.col(f"_u{i}").alias("_u"),
                    F.col(f"_dg{i}").alias("_dg"),
                    F.col(f"_an{i}").alias("_an"),
                    F.col(f"_lmin{i}").alias("min_length"),
                    F.col(f"_lmax{i}").alias("max_length"),
                    F.col(f"_lmed{i}").cast("double").alias("median_length"),
                )
                for i, f in enumerate(fields)
            ]
        )
    )


_IDENTIFIER_SCHEMA = (
    "column string, name_match boolean, uniqueness_pct double, repeated_values long, nulls long, "
    "min_length int, max_length int, median_length double, digits_pct double, alnum_pct double"
)


def empty_constant_columns(
    df: DataFrame,
    key: Key = None,
    low_variability_max: int = LOW_VARIABILITY_MAX_UNIQUE,
    dominant_share: float = DOMINANT_SHARE,
    approx: bool = False,
    freq: Frequencies | None = None,
) -> DataFrame:
    """is_empty, single_value, low_variability, dominant_over_95, distinct_non_null, dominant_pct."""
    fields = [f for f in profiled_fields(df, key) if groupable(f)]
    if not fields:
        return df.sparkSession.createDataFrame([], _EMPTY_CONSTANT_SCHEMA)
    if not approx:
        return _shape_from_frequencies(freq or frequencies(df, fields), low_variability_max, dominant_share)
    aggs = []
    for i, f in enumerate(fields):
        aggs += [
            F.count_if(~is_missing(f)).alias(f"_nn{i}"),
            distinct_count(value_identity(f), approx).alias(f"_d{i}"),
        ]
    shape = df.agg(*aggs)
    # One bounded action: two numbers per column decide which columns need value counts.
    row = shape.first()
    needs_top = [
        f for i, f in enumerate(fields) if 1 < row[f"_d{i}"] and (approx or row[f"_d{i}"] < row[f"_nn{i}"])
    ]
    # The collected row (two numbers per column) is reused, so the table is not scanned again.
    long = df.sparkSession.createDataFrame(
        [(f.name, int(row[f"_nn{i}"]), int(row[f"_d{i}"])) for i, f in enumerate(fields)],
        "column string, non_null long, distinct long",
    )
    if needs_top:
        counted = frequencies(df, needs_top)
        top = counted.table.groupBy("c").agg(F.max("n").alias("top_n")).join(F.broadcast(counted.names()), "c").select("column", "top_n")
        # At most one row per column: a broadcast of proven size.
        long = long.join(F.broadcast(top), "column", "left")
    else:
        long = long.withColumn("top_n", F.lit(None).cast("long"))
    nn, d = F.col("non_null"), F.col("distinct")
    top_n = F.coalesce(
        F.col("top_n"),
        F.when(nn == 0, F.lit(0)).when(d == 1, nn).when(d == nn, F.lit(1)),
    )
    share = pct(top_n, nn)
    return long.select(
        "column",
        (nn == 0).alias("is_empty"),
        (d == 1).alias("single_value"),
        ((d > 1) & (d <= low_variability_max)).alias("low_variability"),
        (share > dominant_share).alias("dominant_over_95"),
        d.alias("distinct_non_null"),
        share.alias("dominant_pct"),
    )


def _shape_from_frequencies(freq: Frequencies, low_variability_max: int, dominant_share: float) -> DataFrame:
    """Exact path, one plan: the frequency table gives non-null, distinct and top counts."""
    per_column = freq.table.groupBy("c").agg(F.sum("n").alias("non_null"), F.count(F.lit(1)).alias("distinct"), F.max("n").alias("top_n"))
    # Both sides hold at most one row per column.
    joined = freq.names().join(F.broadcast(per_column), "c", "left")
    zero = F.lit(0).cast("long")
    nn, d = F.coalesce(F.col("non_null"), zero), F.coalesce(F.col("distinct"), zero)
    share = pct(F.coalesce(F.col("top_n"), zero), nn)
    return joined.orderBy("position").select(
        "column",
        (nn == 0).alias("is_empty"),
        (d == 1).alias("single_value"),
        ((d > 1) & (d <= low_variability_max)).alias("low_variability"),
        (share > dominant_share).alias("dominant_over_95"),
        d.alias("distinct_non_null"),
        share.alias("dominant_pct"),
    )


_EMPTY_CONSTANT_SCHEMA = (
    "column string, is_empty boolean, single_value boolean, low_variability boolean, "
    "dominant_over_95 boolean, distinct_non_null long, dominant_pct double"
)


def flagged_columns(empty_constant: DataFrame) -> DataFrame:
    """Columns that are empty, constant, or dominated by one value."""
    flag = F.col("is_empty") | F.col("single_value") | F.col("dominant_over_95")
    return empty_constant.where(flag).select("column", "is_empty", "single_value", "dominant_over_95")
