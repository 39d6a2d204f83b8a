"""Categorical columns: summary, top frequencies, equivalent spellings.

All read the hashed frequency table (``operators.frequencies``). A column is skipped
only when it has more than ``max_categories`` categories *and* its cardinality exceeds
``max_cardinality_pct``; the gate is a per-column table, so joining it back is a
broadcast of at most one row per column. The top-k uses a window that Spark runs as a
partial ``WindowGroupLimit`` before the shuffle. Long texts are fetched for the rows of
the result alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import is_string, pct
from tidemark.functions.terms import MAX_CARDINALITY_PCT, MAX_CATEGORIES, TOP_CATEGORIES
from tidemark.functions.text import category_key
from tidemark.operators.frequencies import Frequencies, frequencies
from tidemark.operators.text import string_fields

Key = str | Sequence[str] | None


def _gate(freq: Frequencies, max_categories: int, max_cardinality_pct: float) -> DataFrame:
    """Columns to report: c, position, column, categories, non_null, top_count, cardinality_pct."""
    columns = freq.of(is_string)
    stats = freq.table.where(F.col("c").isin(columns)).groupBy("c").agg(F.count(F.lit(1)).alias("categories"), F.sum("n").alias("non_null"), F.max("n").alias("top_count"))
    zero = F.lit(0).cast("long")
    joined = freq.names(columns).join(F.broadcast(stats), "c", "left")
    filled = joined.select("c", "position", "column", *[F.coalesce(x, zero).alias(x) for x in ("categories", "non_null", "top_count")])
    cardinality = pct(F.col("categories"), F.col("non_null"))
    skipped = (F.col("categories") > max_categories) & (cardinality > max_cardinality_pct)
    return filled.withColumn("cardinality_pct", cardinality).where(~skipped)


def _top(freq: Frequencies, gate: DataFrame, top: int) -> DataFrame:
    """The ``top`` most frequent values per column, ties broken by the smaller text: c, rank, text, n, and the gate's columns."""
    # The gate holds one row per column: a broadcast of proven size.
    gated = freq.table.join(F.broadcast(gate.select("c", "column", "position", "non_null")), "c")
    # Values that agree in frequency and first characters stay together until their texts are there.
    first = Window.partitionBy("c").orderBy(F.col("n").desc(), F.col("head").asc())
    near = gated.withColumn("_r", F.rank().over(first)).where(F.col("_r") <= top)
    whole = Window.partitionBy("c").orderBy(F.col("n").desc(), F.col("text").asc())
    ranked = freq.with_texts(near).withColumn("rank", F.row_number().over(whole))
    return ranked.where(F.col("rank") <= top).select("c", "position", "column", "rank", "text", "n", "non_null")


def category_summary(
    df: DataFrame,
    key: Key = None,
    max_categories: int = MAX_CATEGORIES,
    max_cardinality_pct: float = MAX_CARDINALITY_PCT,
    freq: Frequencies | None = None,
) -> DataFrame:
    """column, categories, cardinality_pct, top_category, top_count, top_pct, total_rows."""
    freq = freq or frequencies(df, string_fields(df, key))
    gate = _gate(freq, max_categories, max_cardinality_pct)
    top = _top(freq, gate, 1).select("c", F.col("text").alias("top_category"))
    return gate.join(F.broadcast(top), "c", "left").select(
        "column",
        "categories",
        "cardinality_pct",
        "top_category",
        "top_count",
        pct(F.col("top_count"), F.col("non_null")).alias("top_pct"),
        freq.rows.alias("total_rows"),
    )


def category_frequencies(
    df: DataFrame,
    key: Key = None,
    top: int = TOP_CATEGORIES,
    max_categories: int = MAX_CATEGORIES,
    max_cardinality_pct: float = MAX_CARDINALITY_PCT,
    freq: Frequencies | None = None,
) -> DataFrame:
    """column, rank, category, frequency, pct: the ``top`` most frequent values per column."""
    freq = freq or frequencies(df, string_fields(df, key))
    ranked = _top(freq, _gate(freq, max_categories, max_cardinality_pct), top)
    return ranked.select("column", "rank", F.col("text").alias("category"), F.col("n").alias("frequency"), pct(F.col("n"), F.col("non_null")).alias("pct"))


def category_variants(
    df: DataFrame,
    key: Key = None,
    max_categories: int = MAX_CATEGORIES,
    max_cardinality_pct: float = MAX_CARDINALITY_PCT,
    freq: Frequencies | None = None,
) -> DataFrame:
    """column, key, variant, frequency, variant_count: one row per spelling that shares its comparable key with another.

    Rows, not a list: a key with very many spellings is spread like any others.
    """
    freq = freq or frequencies(df, string_fields(df, key), {"equivalent"})
    gate = F.broadcast(_gate(freq, max_categories, max_cardinality_pct).select("c", "column"))
    keyed = freq.table.where(F.col("key1").isNotNull()).join(gate, "c")
    groups = keyed.groupBy("c", "key1", "key2").agg(F.count(F.lit(1)).alias("variant_count")).where(F.col("variant_count") > 1)
    texts = freq.with_texts(keyed.join(groups, ["c", "key1", "key2"]))
    return texts.select("column", category_key(F.col("text")).alias("key"), F.col("text").alias("variant"), F.col("n").alias("frequency"), "variant_count")


def equivalent_categories(
    df: DataFrame,
    key: Key = None,
    max_categories: int = MAX_CATEGORIES,
    max_cardinality_pct: float = MAX_CARDINALITY_PCT,
    freq: Frequencies | None = None,
) -> DataFrame:
    """column, key, variants, variant_count: spellings that share one comparable key, in one text for reading.

    The list is made of ``category_variants``; that is the form for keys with very many spellings.
    """
    rows = category_variants(df, key, max_categories, max_cardinality_pct, freq)
    return rows.groupBy("column", "key", "variant_count").agg(F.expr("listagg(variant, ' | ') WITHIN GROUP (ORDER BY variant)").alias("variants")).select("column", "key", "variants", "variant_count")
