"""The profile job against the operators on their own, and what it reads."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.plans.job import as_findings, profile_job
from tidemark.plans.profile import profile
from tidemark.plans.registry import rounded

AS_OF = dt.datetime(2026, 1, 1)


def frame(spark):
    long = "a text that is longer than the bound for values that are their own key " * 3
    rows = []
    for i in range(300):
        text = [long, long.upper(), "A", " a", "NA", None, "mal"][i % 7]
        day = None if i % 11 == 0 else "mal" if i % 13 == 0 else f"2024-0{1 + i % 9}-1{i % 10}"
        end = dt.date(2024, 1 + i % 9, 10 + i % 5)
        number = None if i % 5 == 0 else float("inf") if i % 77 == 1 else 1e6 if i % 50 == 3 else float(i % 20)
        rows.append((i % 290 if i < 290 else i, 10**9 + i % 4, number, text, day, end, -0.0 if i % 2 else 0.0, None))
    rows += rows[:40]  # rows that repeat, their key too
    return spark.createDataFrame(rows, "id long, big long, x double, t string, fecha_ingreso string, fecha_salida date, zero double, none string").repartition(3)


@pytest.mark.parametrize("key", ["id", None])
def test_job_equals_the_operators(spark, tmp_path, key):
    df = frame(spark) if key else frame(spark).drop("id")
    job = profile_job(df, str(tmp_path / "job"), key, as_of=AS_OF)
    alone = profile(df, key, as_of=AS_OF)
    few = ("data_types", "duplicate_summary", "duplicate_examples", "date_failures", "numeric_outliers")  # what depends on the key
    for name, table in alone.items():
        if key is None and name not in few:
            continue
        got, want = rounded(job[name]), rounded(table)
        assert got.columns == want.columns, name
        if name == "data_types" and key:  # the first values of rows that share a key are taken in another order
            got, want = got.drop("sample_types"), want.drop("sample_types")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name


def test_numeric_statistics_of_large_neighbours(spark):
    from tidemark.operators.frequencies import frequencies
    from tidemark.operators.numeric import numeric_stats_from

    df = spark.createDataFrame([(2**53 + 2 * (i % 3), None) for i in range(300)], "big long, none double")
    big, none = numeric_stats_from(frequencies(df, df.schema.fields))
    assert big.mean == 2**53 + 2 and abs(big.stddev - (8 / 3 * 300 / 299) ** 0.5) < 1e-9 and big.greatest == 2**53 + 4
    assert (none.mean, none.counts["nulls"], none.percentiles[3]) == (None, 300, None)


def test_empty_table(spark, tmp_path):
    df = frame(spark).limit(0)
    job = profile_job(df, str(tmp_path / "job"), "id", as_of=AS_OF)
    assert job["dimensions"].first().total_cells == 0 and job["duplicate_summary"].first().duplicate_rows == 0
    assert as_findings(job, "id").where("table = 'numeric_outliers'").count() == 0
    assert {r.status for r in job["validation_summary"].collect()} <= {"OK", "WARNING", "REVIEW"}


def test_evidence_reads_the_intermediates_alone(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "source"))
    df = spark.read.parquet(str(tmp_path / "source"))
    job = profile_job(df, str(tmp_path / "job"), "id", as_of=AS_OF)
    fetched = {"duplicate_examples", "category_summary", "category_frequencies", "category_variants", "category_equivalences"}
    for name, table in job.items():
        read = "".join(f for f in table.inputFiles() if "/source/" in f)
        # Row-group statistics of the source are used for the outlier counts alone.
        assert not read or name in fetched | {"numeric_summary"}, name
    whole = spark.read.parquet(str(tmp_path / "job" / "frequencies"))
    assert whole.agg(F.max(F.octet_length("value"))).first()[0] <= 128


def test_preserved_values_need_no_rows(spark):
    from tidemark import operators as O

    df = frame(spark)
    same = O.values_preserved(df, df.repartition(5).toDF(*[f"n{i}" for i in range(len(df.columns))])).first()
    assert (same.only_in_first, same.only_in_second, same.preserved) == (0, 0, True)
    changed = df.withColumn("x", F.when(F.col("id") == 7, F.lit(99.5)).otherwise(F.col("x")))
    other = O.values_preserved(df, changed).first()
    n = df.where("id = 7").count()
    assert (other.only_in_first, other.only_in_second, other.preserved) == (n, n, False)
    fewer = O.values_preserved(df, df.where("id <> 7")).first()
    assert (fewer.only_in_first, fewer.only_in_second) == (n, 0)
    assert O.values_preserved(df.limit(0), df.limit(0)).first().preserved
    nulls = spark.createDataFrame([(None, 1), (1, None)], "a long, b long")
    assert not O.values_preserved(nulls, nulls.select("b", "a").where("a = 1").unionByName(nulls.where("a = 1"))).first().preserved
