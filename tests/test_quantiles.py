"""Exact distributed quantiles against numpy on small fixtures (hot values, several columns)."""

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.quantiles import exact_quantiles, quantile_values

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def test_matches_numpy_linear(spark):
    rng = random.Random(11)
    a = [rng.gauss(0, 10) for _ in range(1500)] + [3.0] * 700  # one value holds a third of the rows
    b = [float(rng.randint(0, 5)) for _ in range(2200)]
    rows = list(zip(a, b))
    df = spark.createDataFrame(rows, "a double, b double")
    got = exact_quantiles(df, {"a": F.col("a"), "b": F.col("b")}, PROBS).collect()
    res = {(r.column, r.prob): r.value for r in got}
    for name, values in (("a", a), ("b", b)):
        expected = np.quantile(np.array(values), PROBS, method="linear")
        for p, e in zip(PROBS, expected):
            assert abs(res[(name, p)] - e) < 1e-9, (name, p, res[(name, p)], e)


def test_nulls_ignored_and_single_value(spark):
    df = spark.createDataFrame([(None,), (5.0,), (None,)], "x double")
    got = exact_quantiles(df, {"x": F.col("x")}, [0.5, 0.99]).collect()
    assert sorted((r.prob, r.value) for r in got) == [(0.5, 5.0), (0.99, 5.0)]


def test_same_on_persisted_input_and_without_reuse(spark):
    rng = random.Random(5)
    values = [rng.expovariate(0.02) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(7)
    expected = np.quantile(np.array(values), PROBS, method="linear")
    settings = ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled")
    kept = {k: spark.conf.get(k) for k in settings}
    try:
        for persisted in (False, True):
            source = df.persist() if persisted else df
            for reuse in ("true", "false"):
                for adaptive in ("true", "false"):
                    spark.conf.set(settings[0], reuse)
                    spark.conf.set(settings[1], adaptive)
                    res = {r.prob: r.value for r in exact_quantiles(source, {"x": F.col("x")}, PROBS).collect()}
                    assert np.allclose([res[p] for p in PROBS], expected, rtol=0, atol=1e-9), (persisted, reuse, adaptive)
    finally:
        df.unpersist()
        for k, v in kept.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_few_steps_per_level_and_uneven_values(spark, monkeypatch, bits):
    from tidemark.functions import quantiles

    monkeypatch.setattr(quantiles, "LEVEL_BITS", bits)
    rng = random.Random(4)
    wide = [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(60)] + [0.0, 5e-324, 1e308, -1e308]
    near = [1.0 + k * 2**-52 for k in range(64)]
    whole = [(k * 7919) % 64 for k in range(64)]
    df = spark.createDataFrame(list(zip(wide, near, whole)), "a double, b double, c long")
    got = quantile_values(df, {c: F.col(c) for c in "abc"}, PROBS)
    for name, values in zip("abc", (wide, near, whole)):
        expected = np.quantile(np.array(values, dtype=float), PROBS, method="linear")
        assert np.allclose([float(x) for x in got[name]], expected, rtol=1e-12, atol=0), name


def test_values_keep_their_own_type(spark):
    base = 2**53
    longs = [base + 1, base + 3, -(2**63), 2**63 - 1, base + 2]
    wide = [Decimal("12345678901234567890.0000000001"), Decimal("12345678901234567890.0000000002"), Decimal("12345678901234567890.0000000004"), Decimal("-3"), Decimal("99999999999999999999.5")]
    df = spark.createDataFrame(list(zip(longs, wide)), "a long, d decimal(38,10)")
    got = quantile_values(df, {"a": F.col("a"), "d": F.col("d")}, [0.0, 0.25, 0.5, 1.0])
    assert got["a"] == [-(2**63), base + 1, base + 2, 2**63 - 1]
    assert got["d"] == [Decimal("-3"), wide[0], wide[1], wide[4]]


def test_summary_gives_whole_numbers_exactly(spark):
    from tidemark import operators as O

    df = spark.createDataFrame([(2**53 + 1, 0.5), (2**53 + 3, None), (2**53 + 4, float("nan")), (2**53 + 9, float("inf"))], "a long, x double")
    a, x = O.numeric_summary(df).collect()
    assert (a.min_exact, a.median_exact, a.max_exact) == ("9007199254740993", "9007199254740995.5", "9007199254741001")
    assert (x.min_exact, x.min, x.max, x.count, x.infinities) == (None, 0.5, 0.5, x.count, 1)


def test_infinities_nan_and_empty(spark):
    df = spark.createDataFrame([(float("inf"), None), (float("nan"), None), (2.0, None), (4.0, None)], "x double, y long")
    assert quantile_values(df, {"x": F.col("x"), "y": F.col("y")}, [0.5]) == {"x": [3.0], "y": [None]}
    assert quantile_values(df.limit(0), {"x": F.col("x")}, [0.5]) == {"x": [None]}


def test_running_totals_do_not_depend_on_caching(spark):
    from tidemark.functions.prefix import running_totals

    rows = [(float((i * 31) % 997), i % 5) for i in range(997)]
    df = spark.createDataFrame(rows, "s double, n long").repartition(5)
    want, so_far = {}, 0
    for s, n in sorted(rows, reverse=True):
        want[s] = so_far
        so_far += n
    for source in (df, df.persist()):
        got = running_totals(source, "s", ["n"], descending=True, ranges=8).collect()
        assert {r.s: r.n_before for r in got} == want
    df.unpersist()
