"""A third of all rows share one value: results stay exact (checked against pandas / numpy)."""

import numpy as np
from pyspark.sql import functions as F

from tidemark import operators as O

N = 300_000


def _skewed(spark):
    ids = spark.range(0, N, numPartitions=8)
    hot = F.col("id") % 3 == 0
    return ids.select(
        F.col("id").alias("k"),
        F.when(hot, F.lit("hot")).otherwise(F.concat(F.lit("v"), (F.col("id") % 997).cast("string"))).alias("cat"),
        F.when(hot, F.lit(5.0)).otherwise((F.col("id") * 7919 % 100_003).cast("double")).alias("x"),
        F.when(F.col("id") % 10 == 1, None).otherwise(F.col("id") % 4).alias("small"),
    )


def test_skewed_categories_duplicates_and_quantiles(spark):
    df = _skewed(spark)
    pdf = df.toPandas()

    freq = {r.category: r.frequency for r in O.category_frequencies(df, "k", max_categories=10_000).where("column = 'cat'").collect()}
    expected = pdf["cat"].value_counts()
    assert freq["hot"] == int(expected["hot"]) == N // 3
    for value, count in freq.items():
        assert count == int(expected[value])

    d = O.exact_duplicates(df.select("cat", "small")).first()
    counts = pdf.groupby(["cat", "small"], dropna=False).size()
    assert d.duplicate_rows == int(counts[counts > 1].sum())
    assert d.largest_group == int(counts.max())

    s = {r.column: r for r in O.numeric_summary(df, "k").collect()}["x"]
    q = np.quantile(pdf["x"].to_numpy(), [0.01, 0.25, 0.5, 0.75, 0.99], method="linear")
    assert [s.p1, s.p25, s.p50, s.p75, s.p99] == [float(v) for v in q]
    assert s.mean == float(np.mean(pdf["x"])) or abs(s.mean - float(np.mean(pdf["x"]))) < 1e-9

    nulls = {r.column: r.nulls for r in O.nulls_by_column(df, "k").collect()}
    assert nulls["small"] == int(pdf["small"].isna().sum())
