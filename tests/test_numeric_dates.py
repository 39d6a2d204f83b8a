"""Numeric statistics, dates and temporal consistency on the FIXTURES goldens."""

import datetime as dt
import math

from tidemark import operators as O
from tidemark.functions.dates import to_timestamp_lenient

K = "row_key"


def test_numeric_summary_golden(quality_small):
    n = O.numeric_summary(quality_small, K).first()
    assert (n.column, n["count"], n.zeros, n.iqr_outliers) == ("numero", 4, 1, 1)
    assert n.mean == 25.75 and n.median == 1.5
    assert math.isclose(n.stddev, 49.5067, rel_tol=1e-5)
    assert [round(x, 4) for x in (n.p1, n.p5, n.p25, n.p75, n.p95, n.p99)] == [0.03, 0.15, 0.75, 26.5, 85.3, 97.06]
    assert n.iqr == 25.75
    out = O.numeric_outliers(quality_small, K).collect()
    assert [(r.column, r.row_key, r.value, r.lower_limit, r.upper_limit) for r in out] == [
        ("numero", 3, 100.0, -37.875, 65.125)
    ]


def test_edge_numeric(spark):
    vals = [None, float("nan"), float("inf"), float("-inf"), 0.0, 1.0, 2.0, 3.0, 4.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    n = O.numeric_summary(df).first()
    assert (n["count"], n.nulls, n.infinities) == (7, 2, 2)
    assert (n.min, n.max, n.mean, n.median) == (0.0, 4.0, 2.0, 2.0)
    assert n.iqr_outliers == 2
    assert sorted(r.value for r in O.numeric_outliers(df).collect()) == [float("-inf"), float("inf")]


def test_numeric_approx_close(spark):
    df = spark.range(0, 10001).selectExpr("cast(id as double) as v")
    exact = O.numeric_summary(df).first()
    approx = O.numeric_summary(df, approx=True).first()
    assert abs(exact.p50 - approx.p50) <= 10


def test_dates_golden(quality_small):
    cands = {r.column: r for r in O.date_candidates(quality_small, K).collect()}
    assert set(cands) == {"fecha_ingreso", "fecha_salida"}
    assert cands["fecha_ingreso"].by_name and not cands["fecha_ingreso"].by_content
    assert cands["fecha_salida"].by_content
    conv = {r.column: r for r in O.date_conversion(quality_small, K).collect()}
    assert conv["fecha_ingreso"].failed == 1 and conv["fecha_ingreso"].convertible == 3
    fails = O.date_failures(quality_small, K).collect()
    assert [(r.column, r.row_key, r.original_value) for r in fails] == [("fecha_ingreso", 1, "mal")]


def test_numeric_identifier_not_a_date(spark):
    df = spark.createDataFrame([(1001,), (1002,), (1003,)], "identificacion long")
    assert O.date_candidates(df).count() == 0


def test_temporal_golden(quality_small):
    t = O.temporal_consistency(quality_small, K).first()
    assert (t.start_column, t.end_column) == ("fecha_ingreso", "fecha_salida")
    assert (t.both_valid, t.end_before_start, t.zero_difference) == (3, 1, 1)
    assert (t.min_hours, t.max_hours, t.median_hours) == (-48.0, 24.0, 0.0)
    bad = O.temporal_inconsistencies(quality_small, K).collect()
    assert [(r.row_key, r.hours) for r in bad] == [(2, -48.0)]


def test_lenient_formats(spark):
    df = spark.createDataFrame(
        [("2024-01-02",), ("2024-01-02 10:30:00",), ("20240102",), ("2024/1/2",), ("01/02/2024",), ("13/02/2024",),
         ("2024-02-30",), ("10:30",), ("2024",), ("mal",)],
        "s string",
    )
    got = [r.t for r in df.select(to_timestamp_lenient(df.s).alias("t")).collect()]
    d = dt.datetime
    assert got == [d(2024, 1, 2), d(2024, 1, 2, 10, 30), d(2024, 1, 2), d(2024, 1, 2), d(2024, 1, 2), d(2024, 2, 13),
                   None, None, None, None]


def test_summary_golden(quality_small):
    s = {r.check: r for r in O.validation_summary(quality_small, K, as_of=dt.datetime(2026, 1, 1)).collect()}
    assert (s["null values"].affected, s["null values"].status) == (6, "WARNING")
    assert s["exact duplicates"].status == "OK"
    assert (s["identifier candidates"].affected, s["identifier candidates"].status) == (5, "WARNING")
    assert (s["empty or constant columns"].affected, s["empty or constant columns"].status) == (2, "REVIEW")
    assert s["text problems"].affected == 9
    assert (s["date conversion"].affected, s["temporal consistency"].affected) == (1, 1)
    assert s["temporal consistency"].status == "REVIEW"
    counts = {r.status: r.checks for r in O.status_counts(O.validation_summary(quality_small, K)).collect()}
    assert counts == {"OK": 1, "WARNING": 4, "REVIEW": 2}


def test_date_layouts_with_time_offset_and_day_first(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    from tidemark.functions.dates import to_timestamp_lenient

    want = {
        "31/12/2024 08:00": dt.datetime(2024, 12, 31, 8),
        "01/02/2024 10:30": dt.datetime(2024, 1, 2, 10, 30),
        "2024-01-02T10:00:00Z": dt.datetime(2024, 1, 2, 10),
        "2024-01-02T10:00:00-05:00": dt.datetime(2024, 1, 2, 15),
        "2024-01-02T10:00:00+0530": dt.datetime(2024, 1, 2, 4, 30),
        "31-12-2024": dt.datetime(2024, 12, 31),
        "2024-01-02 10:30 PM": dt.datetime(2024, 1, 2, 22, 30),
        "01/02/2024 12:05:07.25 am": dt.datetime(2024, 1, 2, 0, 5, 7, 250000),
        " 2024/1/2\t": dt.datetime(2024, 1, 2),
        "20240102": dt.datetime(2024, 1, 2),
        "31/31/2024": None,
        "2024-02-30": None,
        "2024-01/02": None,
        "10:30": None,
        "2024-01-02 13:00 PM": None,
        "mal": None,
    }
    df = spark.createDataFrame([(k,) for k in want], "s string")
    got = {r.s: r.t for r in df.select("s", to_timestamp_lenient(F.col("s")).alias("t")).collect()}
    assert got == want
