"""Numeric summary and IQR outliers.

Moments and percentiles use finite values only; zeros, negatives and outliers
count every value (NaN never counts: Spark orders NaN above +inf, so it is
excluded explicitly). Percentiles are exact by default (linear interpolation, as
pandas) by rank selection (``functions.quantiles``), so no task holds a whole
column; ``approx=True`` switches to ``percentile_approx``, one pass with a sketch of
fixed size. Least, middle and greatest value of whole-number and decimal columns are
given as text too, in their own type: a double cannot hold every long.

Outlier limits need the quartiles first: one row of statistics is collected (a fixed
number of values per column) and the limits enter the next pass as literals. A caller
that wants the summary and the outliers makes ``numeric_stats`` once for both.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import as_key_list, balanced, explode_structs, is_missing, is_numeric, profiled_fields, qcol
from tidemark.functions.quantiles import Value, own_type, quantile_values
from tidemark.functions.terms import IQR_FACTOR, PERCENTILES
from tidemark.operators.frequencies import Frequencies

Key = str | Sequence[str] | None
_PCT_NAMES = ("p1", "p5", "p25", "p50", "p75", "p95", "p99")


def numeric_fields(df: DataFrame, key: Key = None) -> list[T.StructField]:
    # Booleans are not numbers here (they are in the date gate).
    return [f for f in profiled_fields(df, key) if is_numeric(f)]


def _x(f: T.StructField) -> Column:
    return qcol(f.name).cast("double")


def _finite(f: T.StructField) -> Column:
    """The value in its own type (long, decimal or double) when finite."""
    return own_type(qcol(f.name), f.dataType)[0]


def _approx_quantiles(c: Column, accuracy: int) -> Column:
    return F.percentile_approx(c.cast("double"), F.array(*[F.lit(p) for p in PERCENTILES]), accuracy)


@dataclass
class ColumnStats:
    """One numeric column: counts and moments, percentiles in its own type, outlier limits."""

    field: T.StructField
    counts: dict[str, int]
    mean: float | None
    stddev: float | None
    least: Value | None
    greatest: Value | None
    percentiles: list[Value | None]
    lo: float | None
    hi: float | None
    iqr: float | None


_COUNTS = ("count", "nulls", "finite", "zeros", "negatives", "infinities")


def _limits(q: Sequence[Value | None], factor: float) -> tuple[float | None, float | None, float | None]:
    if q[0] is None:
        return None, None, None
    q1, q3 = float(q[2]), float(q[4])
    return q1 - factor * (q3 - q1), q3 + factor * (q3 - q1), q3 - q1


def numeric_stats_from(freq: Frequencies, factor: float = IQR_FACTOR) -> list[ColumnStats]:
    """The statistics from a frequency table: each distinct value counts as often as it occurs."""
    which = freq.of(is_numeric)
    if not which:
        return []
    rows = freq.rows
    table = freq.table.where(F.col("c").isin(which)).select("c", "value", "n", F.col("value").cast("double").alias("x"))
    values = {freq.fields[i].name: F.when(F.col("c") == i, F.col("value").cast(freq.fields[i].dataType)) for i in which}
    found = quantile_values(table, values, (0.0, *PERCENTILES, 1.0), weight=F.col("n"))
    # Moments are taken from the least value, so that large values that lie close together keep their spread.
    least = {i: found[freq.fields[i].name][0] for i in which}
    base = F.get(F.array(*(F.lit(float(least.get(i) or 0)) for i in range(len(freq.fields)))), F.col("c"))
    inf = F.lit(math.inf)
    off = F.when(F.abs("x") != inf, F.col("x") - base)

    def cells(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")

    counted = table.withColumn("off", off).groupBy("c").agg(
        F.sum("n").alias("count"),
        cells(F.col("off").isNotNull()).alias("finite"),
        cells(F.col("x") == 0).alias("zeros"),
        cells(F.col("x") < 0).alias("negatives"),
        cells(F.abs("x") == inf).alias("infinities"),
        (F.sum(F.col("off") * F.col("n")) / F.nullif(cells(F.col("off").isNotNull()), F.lit(0))).alias("mean"),
    )
    # One row per column on the right: a broadcast of proven size.
    joined = table.withColumn("off", off).join(F.broadcast(counted.select("c", "mean", "finite")), "c")
    spread = joined.groupBy("c", "finite").agg(F.sum(F.col("n") * F.pow(F.col("off") - F.col("mean"), F.lit(2.0))).alias("squares"))
    spread = spread.select("c", F.when(F.col("finite") > 1, F.sqrt(F.col("squares") / (F.col("finite") - 1))).alias("stddev"))
    got = {r["c"]: r for r in counted.join(F.broadcast(spread), "c", "left").withColumn("rows", rows).withColumn("mean", F.col("mean") + base).collect()}
    total = None if got else freq.source.sparkSession.range(1).select(rows.alias("rows")).first()["rows"]
    out = []
    for i in which:
        r, f = got.get(i), freq.fields[i]
        least, *q, greatest = found[f.name]
        lo, hi, iqr = _limits(q, factor)
        all_rows = next((x["rows"] for x in got.values()), total)
        counts = {c: r[c] if r else 0 for c in _COUNTS if c != "nulls"} | {"nulls": all_rows - (r["count"] if r else 0)}
        out.append(ColumnStats(f, counts, r["mean"] if r else None, r["stddev"] if r else None, least, greatest, q, lo, hi, iqr))
    return out


def numeric_stats(df: DataFrame, key: Key = None, approx: bool = False, accuracy: int = 10000, factor: float = IQR_FACTOR) -> list[ColumnStats]:
    """Statistics of every numeric column, collected: a fixed number of values per column."""
    fields = numeric_fields(df, key)
    if not fields:
        return []
    aggs = []
    for i, f in enumerate(fields):
        x, own = _x(f), _finite(f)
        counted = (F.count_if(~is_missing(f)), F.count_if(is_missing(f)), F.count(own), F.count_if(x == 0), F.count_if(x < 0), F.count_if(F.abs(x) == F.lit(math.inf)))
        aggs += [c.alias(f"{name}{i}") for name, c in zip(_COUNTS, counted, strict=True)]
        fin = own.cast("double")
        aggs += [F.avg(fin).alias(f"mean{i}"), F.stddev_samp(fin).alias(f"sd{i}"), F.min(own).alias(f"min{i}"), F.max(own).alias(f"max{i}")]
        if approx:
            aggs.append(_approx_quantiles(own, accuracy).alias(f"q{i}"))
    row = df.agg(*aggs).first()
    if approx:
        percentiles = {f.name: list(row[f"q{i}"] or [None] * len(PERCENTILES)) for i, f in enumerate(fields)}
    else:
        facts = {f.name: (row[f"finite{i}"], row[f"min{i}"], row[f"max{i}"]) for i, f in enumerate(fields)}
        percentiles = quantile_values(df, {f.name: qcol(f.name) for f in fields}, PERCENTILES, facts)
    out = []
    for i, f in enumerate(fields):
        q = percentiles[f.name]
        lo, hi, iqr = _limits(q, factor)
        out.append(ColumnStats(f, {c: row[f"{c}{i}"] for c in _COUNTS}, row[f"mean{i}"], row[f"sd{i}"], row[f"min{i}"], row[f"max{i}"], q, lo, hi, iqr))
    return out


def _double(v: Value | None) -> float | None:
    return None if v is None else float(v)


def _exact(v: Value | None) -> str | None:
    """A whole number or decimal as text; floating values are exact as doubles already."""
    if v is None or isinstance(v, float):
        return None
    if isinstance(v, Fraction):
        if v.denominator == 1:
            return str(v.numerator)
        # Halves and tenths of halves: between two whole numbers or decimals.
        digits = max(1, (v.denominator - 1).bit_length())
        v = Decimal(round(v * 10**digits)).scaleb(-digits)
    return format(v.normalize(), "f") if isinstance(v, Decimal) else str(v)


def _lit(v) -> Column:
    return F.lit(v).cast("double")


def _is_outlier(f: T.StructField, lo, hi) -> Column:
    x = _x(f)
    if lo is None or hi is None:
        return F.lit(False)
    return ~F.isnan(x) & ((x < _lit(lo)) | (x > _lit(hi)))


_INTEGRAL_BITS = ((T.ByteType, 7), (T.ShortType, 15), (T.IntegerType, 31), (T.LongType, 63))


def _scan_filter(f: T.StructField, lo, hi) -> Column:
    """A superset of the outlier rows written on the raw column, so Parquet can skip row groups.

    Integral columns compare with integral bounds (x < lo  <=>  x < ceil(lo),
    clamped to the type's range); floating columns compare directly, and NaN
    (which Spark orders above +inf) is removed after the scan by the exact test.
    """
    c = qcol(f.name)
    if lo is None or hi is None or math.isnan(lo) or math.isnan(hi):
        return F.lit(False)
    for t, bits in _INTEGRAL_BITS:
        if isinstance(f.dataType, t):
            tmin, tmax = -(2**bits), 2**bits - 1
            low = math.ceil(lo) if math.isfinite(lo) else (tmax + 1 if lo > 0 else tmin)
            high = math.floor(hi) if math.isfinite(hi) else (tmax if hi > 0 else tmin - 1)
            below = F.lit(False) if low <= tmin else F.lit(True) if low > tmax else c < F.lit(low).cast(f.dataType)
            above = F.lit(False) if high >= tmax else F.lit(True) if high < tmin else c > F.lit(high).cast(f.dataType)
            return below | above
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        return (c < F.lit(lo).cast(f.dataType)) | (c > F.lit(hi).cast(f.dataType))
    return (_x(f) < _lit(lo)) | (_x(f) > _lit(hi))


def numeric_summary(
    df: DataFrame,
    key: Key = None,
    approx: bool = False,
    accuracy: int = 10000,
    factor: float = IQR_FACTOR,
    stats: Sequence[ColumnStats] | None = None,
) -> DataFrame:
    """Per numeric column: counts, moments, percentiles 1..99, IQR, zeros, negatives, infinities, outliers."""
    spark = df.sparkSession
    stats = numeric_stats(df, key, approx, accuracy, factor) if stats is None else stats
    if not stats:
        return spark.createDataFrame([], _SUMMARY_SCHEMA)
    rows = []
    for i, s in enumerate(stats):
        c, q = s.counts, [_double(v) for v in s.percentiles]
        exact = [_exact(v) for v in (s.least, s.percentiles[3], s.greatest)]
        rows.append((i + 1, s.field.name, c["count"], c["nulls"], s.mean, q[3], s.stddev, _double(s.least), _double(s.greatest), *q, s.iqr, c["zeros"], c["negatives"], c["infinities"], *exact))
    long = spark.createDataFrame(rows, "position int, " + _SUMMARY_SCHEMA.rsplit(", iqr_outliers long", 1)[0])
    # Only rows that can hold an outlier are read past the scan (row groups skipped by their statistics).
    candidates = df.where(balanced(or_, [_scan_filter(s.field, s.lo, s.hi) for s in stats]))
    outliers = candidates.agg(*[F.count_if(_is_outlier(s.field, s.lo, s.hi)).alias(f"_out{i}") for i, s in enumerate(stats)])
    out_long = outliers.select(explode_structs([F.struct(F.lit(s.field.name).alias("column"), F.col(f"_out{i}").alias("iqr_outliers")) for i, s in enumerate(stats)]))
    # One row per numeric column on each side: a broadcast of proven size.
    return long.join(F.broadcast(out_long), "column").orderBy("position").drop("position")


_SUMMARY_SCHEMA = (
    "column string, count long, nulls long, mean double, median double, stddev double, min double, "
    "max double, p1 double, p5 double, p25 double, p50 double, p75 double, p95 double, p99 double, "
    "iqr double, zeros long, negatives long, infinities long, min_exact string, median_exact string, "
    "max_exact string, iqr_outliers long"
)


def outlier_cells(stats: Sequence[ColumnStats]) -> list[Column]:
    """A struct per column: column, _hit (whether the row's value is an outlier), value, limits."""
    return [
        F.struct(
            F.lit(s.field.name).alias("column"),
            _is_outlier(s.field, s.lo, s.hi).alias("_hit"),
            _x(s.field).alias("value"),
            _lit(s.lo).alias("lower_limit"),
            _lit(s.hi).alias("upper_limit"),
        )
        for s in stats
    ]


def numeric_outliers(
    df: DataFrame,
    key: Key = None,
    approx: bool = False,
    accuracy: int = 10000,
    factor: float = IQR_FACTOR,
    stats: Sequence[ColumnStats] | None = None,
) -> DataFrame:
    """Every (column, row) outside [q1 - 1.5 iqr, q3 + 1.5 iqr]: column, key..., value, limits."""
    keys = as_key_list(key)
    stats = numeric_stats(df, key, approx, accuracy, factor) if stats is None else stats
    if not stats:
        none = [F.lit(None).cast("double").alias(c) for c in ("value", "lower_limit", "upper_limit")]
        return df.select(F.lit(None).cast("string").alias("column"), *[qcol(k) for k in keys], *none).limit(0)
    cells = outlier_cells(stats)
    # Rows without any outlier are dropped before the per-cell explode.
    any_hit = balanced(or_, [_is_outlier(s.field, s.lo, s.hi) for s in stats])
    scan = balanced(or_, [_scan_filter(s.field, s.lo, s.hi) for s in stats])
    exploded = df.where(scan).where(any_hit).select(*[qcol(k) for k in keys], explode_structs(cells))
    return exploded.where(F.col("_hit")).select("column", *[qcol(k) for k in keys], "value", "lower_limit", "upper_limit")
