"""Date candidates, conversion, failures, and temporal consistency of column pairs.

A column is a candidate by name (whole-token rules), by type (timestamp/date),
or by content (share of values that look like a date or a time). Which columns
are candidates is decided inside the plan (a filter on the per-column result),
so the candidate, conversion and failure tables are single lazy plans. Text is parsed
once per distinct value, in the frequency table. Only
the converted frame and the column pairs depend on candidate *names*, which
one bounded action (one row per column) provides.
"""

from __future__ import annotations

import re
from itertools import product
import datetime as _dt
from collections.abc import Sequence
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import (
    SCALAR_TYPES,
    as_key_list,
    as_text,
    balanced,
    explode_structs,
    is_datetime,
    is_missing,
    is_numeric,
    pct,
    profiled_fields,
    qcol,
    type_name,
)
from tidemark.functions.dates import hours_between, to_timestamp_lenient
from tidemark.functions.quantiles import quantile_map
from tidemark.functions.terms import (
    DATE_CONTENT_THRESHOLD,
    DATE_NAME_EXCLUSIONS,
    DATE_TERMS,
    EARLIEST_DATE,
    EXAMPLE_LIMIT,
    EXPLICIT_DATE_WORDS,
    TEMPORAL_END_TERMS,
    TEMPORAL_START_TERMS,
)
from tidemark.functions.text import fold_value, name_tokens
from tidemark.operators.frequencies import Frequencies, frequencies

Key = str | Sequence[str] | None
AsOf = str | _dt.datetime | None


def date_name_match(name: str) -> bool:
    tokens = name_tokens(name)
    if tokens & set(EXPLICIT_DATE_WORDS):
        return True
    return bool(tokens & set(DATE_TERMS)) and not tokens & set(DATE_NAME_EXCLUSIONS)


def _content_eligible(f: T.StructField) -> bool:
    # Numbers (booleans included) are dates only by name.
    return not is_numeric(f, include_bool=True)


def _considered(df: DataFrame, key: Key) -> list[T.StructField]:
    out = []
    for f in profiled_fields(df, key):
        if not isinstance(f.dataType, SCALAR_TYPES):
            continue
        if date_name_match(f.name) or _content_eligible(f) or is_datetime(f):
            out.append(f)
    return out


def _ts_literal(value: AsOf, default: Column) -> Column:
    if value is None:
        return default
    if isinstance(value, _dt.datetime):
        value = value.isoformat(sep=" ")
    return F.lit(str(value)).cast("timestamp_ntz")


def converted(f: T.StructField) -> Column:
    return to_timestamp_lenient(qcol(f.name), f.dataType)


def unconverted(f: T.StructField) -> Column:
    """Whether an informed value cannot be read as a date."""
    return ~is_missing(f) & converted(f).isNull()


def _typed_counts(df: DataFrame, fields: list[T.StructField], now: Column, lower: Column) -> DataFrame:
    """Date and timestamp columns need no parsing: one wide aggregate."""
    aggs = []
    for i, f in enumerate(fields):
        v = converted(f)
        # They render as yyyy-MM-dd[ HH:mm:ss], so every informed value matches the hint.
        aggs.append(F.struct(F.lit(f.name).alias("column"), F.count(v).alias("non_null"), F.count(v).alias("hits"), F.count(v).alias("convertible"), F.min(v).alias("min_date"), F.max(v).alias("max_date"), F.count_if(v > now).alias("future_dates"), F.count_if(v < lower).alias("before_limit")).alias(f"c{i}"))
    return df.agg(*aggs).select(explode_structs([F.col(f"c{i}") for i in range(len(fields))]))


def _text_counts(freq: Frequencies, fields: list[T.StructField], now: Column, lower: Column) -> DataFrame:
    """Other columns: each distinct value is parsed once, in the frequency table."""
    wanted = {f.name for f in fields}
    which = freq.of(lambda f: f.name in wanted)
    by_hint = freq.of(lambda f: f.name in wanted and _content_eligible(f))
    n, at = F.col("n"), F.col("at")

    def cells(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0)).cast("long")

    counted = freq.table.where(F.col("c").isin(which)).groupBy("c").agg(
        F.sum("n").alias("non_null"),
        cells(F.col("c").isin(by_hint) & F.col("hint")).alias("hits"),
        cells(at.isNotNull()).alias("convertible"),
        F.min("at").alias("min_date"),
        F.max("at").alias("max_date"),
        cells(at > now).alias("future_dates"),
        cells(at < lower).alias("before_limit"),
    )
    return counted.join(F.broadcast(freq.names(which)), "c").drop("c", "position")


def date_profile(
    df: DataFrame,
    key: Key = None,
    earliest: str = EARLIEST_DATE,
    as_of: AsOf = None,
    threshold: float = DATE_CONTENT_THRESHOLD,
    freq: Frequencies | None = None,
) -> DataFrame:
    """One row per considered column with candidate flags and conversion counters."""
    fields = _considered(df, key)
    if not fields:
        return df.sparkSession.createDataFrame([], _PROFILE_SCHEMA)
    now = _ts_literal(as_of, F.localtimestamp())
    lower = F.lit(earliest).cast("date").cast("timestamp_ntz")
    typed = [f for f in fields if is_datetime(f)] if freq is None else []
    texts = [f for f in fields if f not in typed]
    parts = [_typed_counts(df, typed, now, lower)] if typed else []
    if texts:
        parts.append(_text_counts(freq or frequencies(df, texts, {"date"}), texts, now, lower).select("column", "non_null", "hits", "convertible", "min_date", "max_date", "future_dates", "before_limit"))
    counted = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    facts = df.sparkSession.createDataFrame(
        [(i + 1, f.name, date_name_match(f.name), is_datetime(f), type_name(f)) for i, f in enumerate(fields)],
        "position int, column string, by_name boolean, recognized boolean, data_type string",
    )
    zero = F.lit(0).cast("long")
    # One row per considered column on both sides.
    joined = facts.join(F.broadcast(counted), "column", "left")
    counts = {c: F.coalesce(c, zero) for c in ("non_null", "hits", "convertible", "future_dates", "before_limit")}
    nn = F.col("non_null")
    long = joined.withColumns(counts).select(
        "position",
        "column",
        "by_name",
        "recognized",
        "data_type",
        pct(F.col("hits"), nn).alias("date_pattern_pct"),
        F.when(F.col("recognized") & (nn > 0), 100.0).otherwise(0.0).alias("date_object_pct"),
        nn,
        "convertible",
        (nn - F.col("convertible")).alias("failed"),
        pct(F.col("convertible"), nn).alias("conversion_pct"),
        "min_date",
        "max_date",
        "future_dates",
        "before_limit",
    )
    hint = F.greatest("date_pattern_pct", "date_object_pct") >= threshold
    return (
        long.withColumn("content_hint", hint)
        .withColumn("by_content", hint & (F.col("conversion_pct") >= threshold))
        .withColumn("earliest_limit", F.lit(str(_dt.date.fromisoformat(earliest))))
        .where(F.col("by_name") | F.col("recognized") | F.col("content_hint"))
    )


_PROFILE_SCHEMA = (
    "position int, column string, by_name boolean, recognized boolean, data_type string, "
    "date_pattern_pct double, date_object_pct double, non_null long, convertible long, failed long, "
    "conversion_pct double, min_date timestamp_ntz, max_date timestamp_ntz, future_dates long, "
    "before_limit long, content_hint boolean, by_content boolean, earliest_limit string"
)


def date_candidates(df: DataFrame, key: Key = None, **kw) -> DataFrame:
    """column, by_name, by_content, data_type, date_pattern_pct."""
    return date_profile(df, key, **kw).select("column", "by_name", "by_content", "data_type", "date_pattern_pct")


def date_conversion(df: DataFrame, key: Key = None, **kw) -> DataFrame:
    """Per candidate: non_null, convertible, failed, conversion_pct, min/max, future, before limit."""
    return date_profile(df, key, **kw).select(
        "column",
        "non_null",
        "convertible",
        "failed",
        "conversion_pct",
        "min_date",
        "max_date",
        "future_dates",
        "before_limit",
        "earliest_limit",
    )


def date_failures(df: DataFrame, key: Key = None, limit: int = EXAMPLE_LIMIT, **kw) -> DataFrame:
    """First ``limit`` unconvertible values per candidate column (by key, then value)."""
    keys = as_key_list(key)
    fields = _considered(df, key)
    if not fields:
        columns = [F.lit(None).cast("string").alias("column"), *[qcol(k) for k in keys], F.lit(None).cast("string").alias("original_value")]
        return df.select(*columns).limit(0)
    bad = [unconverted(f) for f in fields]
    cells = [
        F.struct(F.lit(f.name).alias("column"), b.alias("_bad"), as_text(f).alias("original_value"))
        for f, b in zip(fields, bad)
    ]
    failing = (
        df.where(balanced(or_, bad))
        .select(*[qcol(k) for k in keys], explode_structs(cells))
        .where(F.col("_bad"))
        .drop("_bad")
    )
    order = [qcol(k) for k in keys] + [F.col("original_value")]
    ranked = failing.withColumn("_rn", F.row_number().over(Window.partitionBy("column").orderBy(*order)))
    first = ranked.where(F.col("_rn") <= limit).drop("_rn")
    candidates = F.broadcast(date_profile(df, key, **kw).select("column"))
    return first.join(candidates, "column", "left_semi").select("column", *[qcol(k) for k in keys], "original_value")


def candidate_names(df: DataFrame, key: Key = None, **kw) -> list[str]:
    """Names of date candidates, in column order (one bounded action)."""
    rows = date_profile(df, key, **kw).select("position", "column").collect()
    return [r["column"] for r in sorted(rows, key=lambda r: r["position"])]


def converted_name(column: str) -> str:
    return f"{column}__ts"


def with_converted_dates(df: DataFrame, key: Key = None, candidates: Sequence[str] | None = None, **kw):
    """The frame with one added TIMESTAMP_NTZ column per candidate; originals untouched.

    Returns (frame, {candidate: converted column name}).
    """
    names = list(candidates) if candidates is not None else candidate_names(df, key, **kw)
    by_name = {f.name: f for f in df.schema.fields}
    mapping = {n: converted_name(n) for n in names}
    return df.withColumns({mapping[n]: converted(by_name[n]) for n in names}), mapping


def temporal_pairs(names: Sequence[str]) -> list[tuple[str, str]]:
    """Ordered (start, end) pairs of distinct columns whose folded names suggest an interval."""
    starts, ends = (
        [n for n in names if re.search("|".join(map(re.escape, terms)), fold_value(n))]
        for terms in (TEMPORAL_START_TERMS, TEMPORAL_END_TERMS)
    )
    return [pair for pair in product(starts, ends) if pair[0] != pair[1]]


def temporal_consistency(df: DataFrame, key: Key = None, candidates: Sequence[str] | None = None, **kw) -> DataFrame:
    """Per plausible pair: both_valid, end_before_start, zero_difference, min/max/median hours."""
    conv, mapping = with_converted_dates(df, key, candidates, **kw)
    pairs = temporal_pairs(list(mapping))
    if not pairs:
        return df.sparkSession.createDataFrame([], _CONSISTENCY_SCHEMA)
    aggs = []
    for i, (s, e) in enumerate(pairs):
        a, b = F.col(mapping[s]), F.col(mapping[e])
        d = F.when(a.isNotNull() & b.isNotNull(), hours_between(a, b))
        aggs += [
            F.count(d).alias(f"_both{i}"),
            F.count_if(d < 0).alias(f"_neg{i}"),
            F.count_if(d == 0).alias(f"_zero{i}"),
            F.min(d).alias(f"_min{i}"),
            F.max(d).alias(f"_max{i}"),
        ]
    structs = [
        F.struct(
            F.lit(s).alias("start_column"),
            F.lit(e).alias("end_column"),
            F.col(f"_both{i}").alias("both_valid"),
            F.col(f"_neg{i}").alias("end_before_start"),
            F.col(f"_zero{i}").alias("zero_difference"),
            F.col(f"_min{i}").alias("min_hours"),
            F.col(f"_max{i}").alias("max_hours"),
            F.col(f"_med{i}").cast("double").alias("median_hours"),
        )
        for i, (s, e) in enumerate(pairs)
    ]
    # Medians by rank selection over the differences (one value per pair comes back).
    diffs = {
        f"_med{i}": F.when(F.col(mapping[s]).isNotNull() & F.col(mapping[e]).isNotNull(),
                           hours_between(F.col(mapping[s]), F.col(mapping[e])))
        for i, (s, e) in enumerate(pairs)
    }
    medians = quantile_map(conv, diffs, [0.5])
    aggs += [F.lit(medians[k][0]).cast("double").alias(k) for k in diffs]
    return conv.agg(*aggs).select(explode_structs(structs))


_CONSISTENCY_SCHEMA = (
    "start_column string, end_column string, both_valid long, end_before_start long, zero_difference long, "
    "min_hours double, max_hours double, median_hours double"
)


def temporal_inconsistencies(
    df: DataFrame, key: Key = None, candidates: Sequence[str] | None = None, **kw
) -> DataFrame:
    """Every (row, pair) whose end precedes its start: pair, key..., both dates, hours."""
    keys = as_key_list(key)
    conv, mapping = with_converted_dates(df, key, candidates, **kw)
    pairs = temporal_pairs(list(mapping))
    if not pairs:
        none = {"start_value": "timestamp_ntz", "end_value": "timestamp_ntz", "hours": "double"}
        columns = [F.lit(None).cast("string").alias(c) for c in ("start_column", "end_column")] + [qcol(k) for k in keys]
        return df.select(*columns, *[F.lit(None).cast(t).alias(c) for c, t in none.items()]).limit(0)
    diffs = [hours_between(F.col(mapping[s]), F.col(mapping[e])) for s, e in pairs]
    cells = [
        F.struct(
            F.lit(s).alias("start_column"),
            F.lit(e).alias("end_column"),
            F.col(mapping[s]).alias("start_value"),
            F.col(mapping[e]).alias("end_value"),
            d.alias("hours"),
        )
        for (s, e), d in zip(pairs, diffs)
    ]
    negative = conv.where(balanced(or_, [d < 0 for d in diffs]))
    exploded = negative.select(*[qcol(k) for k in keys], explode_structs(cells))
    return exploded.where(F.col("hours") < 0).select(
        "start_column", "end_column", *[qcol(k) for k in keys], "start_value", "end_value", "hours"
    )
