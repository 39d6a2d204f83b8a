"""Dimensions, nulls and duplicates on the FIXTURES goldens."""

import math

from pyspark.sql import functions as F

from tidemark import operators as O

K = "row_key"


def _by(df, col="column"):
    return {r[col]: r for r in df.collect()}


def test_dimensions_golden(quality_small):
    d = O.dimensions(quality_small, K).first()
    assert (d.rows, d.columns, d.total_cells) == (4, 9, 36)
    assert (d.null_cells, d.informed_cells) == (6, 30)
    assert math.isclose(d.completeness_pct, 30 / 36 * 100)


def test_nulls_by_column_golden(quality_small):
    n = _by(O.nulls_by_column(quality_small, K))
    assert n["vacia"].nulls == 4 and n["vacia"].nulls_pct == 100.0
    assert n["id_paciente"].nulls == 1 and n["mixto"].nulls == 1
    assert sum(r.nulls for r in n.values()) == 6
    assert all(r.nulls + r.non_nulls == 4 for r in n.values())


def test_nulls_per_row_and_completeness(quality_small):
    dist = {r.nulls_in_row: r.rows for r in O.nulls_per_row(quality_small, K).collect()}
    assert dist == {1: 3, 3: 1}
    c = O.row_completeness(quality_small, K).first()
    assert (c.all_null_rows, c.rows_with_nulls, c.complete_rows) == (0, 4, 0)


def test_missing_ranking_order(quality_small):
    ranked = O.missing_ranking(quality_small, K).orderBy("rank").collect()
    assert ranked[0].column == "vacia"
    assert [r.rank for r in ranked] == list(range(1, 10))


def test_exact_duplicates_golden(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "a long, b string")
    d = O.exact_duplicates(df).first()
    assert (d.duplicate_rows, d.duplicate_groups, d.largest_group) == (2, 1, 2)
    assert len(O.duplicate_examples(df).collect()) == 2


def test_duplicates_null_safe_and_keys(spark):
    df = spark.createDataFrame(
        [(0, None, "x"), (1, None, "x"), (2, float("nan"), "y"), (3, float("nan"), "y"), (4, 1.0, "z")],
        "k long, a double, b string",
    )
    d = O.exact_duplicates(df, "k").first()
    assert (d.duplicate_rows, d.duplicate_groups) == (4, 2)
    keys = sorted(r.k for r in O.duplicate_row_keys(df, "k").collect())
    assert keys == [0, 1, 2, 3]
    ex = O.duplicate_examples(df, "k", limit=3).collect()
    assert [r.k for r in ex] == [0, 1, 2]


def test_hot_group_is_counted_whole(spark):
    # One group holds most rows: counts stay exact.
    df = spark.range(0, 3000).select(F.when(F.col("id") < 2000, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("v"))
    d = O.exact_duplicates(df).first()
    assert (d.duplicate_rows, d.duplicate_groups, d.largest_group) == (2000, 1, 2000)


def test_empty_input_keeps_schema(spark, quality_small):
    empty = quality_small.limit(0)
    d = O.dimensions(empty, K).first()
    assert d.rows == 0 and d.completeness_pct == 0.0
    assert O.exact_duplicates(empty, K).first().duplicate_rows == 0
    assert O.nulls_by_column(empty, K).count() == 9


def test_repartition_does_not_change_results(quality_small):
    a = sorted(O.nulls_by_column(quality_small, K).collect())
    b = sorted(O.nulls_by_column(quality_small.repartition(3), K).collect())
    assert a == b


def test_fingerprint_prefilter_keeps_grouping_semantics(spark):
    # -0.0 groups with 0.0, and NaN with NaN, exactly as Spark's grouping does.
    df = spark.createDataFrame(
        [(0.0, "a"), (-0.0, "a"), (float("nan"), "b"), (float("nan"), "b"), (1.0, "c")], "x double, s string"
    )
    d = O.exact_duplicates(df).first()
    assert (d.duplicate_rows, d.duplicate_groups, d.largest_group) == (4, 2, 2)


def test_whole_row_duplicate_queries_see_every_column(spark, tmp_path):
    from tidemark.plans.registry import QUERIES

    rows = [(1, "same", "en", "a", 4), (2, "same", "en", "b", 4), (3, "twin", "en", "a", 4), (4, "twin", "en", "a", 4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("duplicate_examples_documents", "duplicate_row_keys_documents"):
        assert sorted(r.doc_id for r in QUERIES[name](spark, str(tmp_path)).collect()) == [3, 4]
