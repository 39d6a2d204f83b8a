"""The profile job: every check on one table, evidence written, nothing changed.

``profile`` returns a dict of lazy DataFrames, each operator on its own. ``run_profile``
is the whole stage: read the source, normalise names, verify values are preserved,
write the identified table as Parquet, then profile *that written table* from two
shared intermediates (``plans.job``), so the lineage of every later job starts at files
in the output folder; write each evidence table as CSV, the summary and ingestion
reports as JSON, and a manifest of outputs.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import operators as O
from tidemark.operators.dates import candidate_names
from tidemark.functions.terms import EARLIEST_DATE
from tidemark.plans.job import profile_job
from tidemark.sinks import (
    evidence_manifest,
    ingestion_metadata,
    validation_report,
    write_evidence_csv,
    write_identified,
    write_report_json,
)
from tidemark.sources import infer_types, nullify_markers, read_headed_table, require_source


def profile(
    df: DataFrame,
    key: str | Sequence[str] | None = None,
    earliest: str = EARLIEST_DATE,
    as_of: _dt.datetime | None = None,
    mapping: dict[str, str] | None = None,
    approx: bool = False,
    source_paths: Sequence[str] | None = None,
    output_paths: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """All evidence tables for ``df`` (lazy). Date candidates are resolved once and shared."""
    kw = {"earliest": earliest, "as_of": as_of}
    candidates = candidate_names(df, key, **kw)
    summary = O.validation_summary(df, key, earliest=earliest, as_of=as_of, date_candidates=candidates, approx=approx)
    empty_constant = O.empty_constant_columns(df, key, approx=approx)
    return {
        "dimensions": O.dimensions(df, key),
        "columns": O.column_inventory(df, key, mapping=mapping, approx=approx),
        "data_types": O.type_profile(df, key),
        "nulls": O.nulls_by_column(df, key),
        "nulls_per_row": O.nulls_per_row(df, key),
        "row_completeness": O.row_completeness(df, key),
        "missing_ranking": O.missing_ranking(df, key),
        "duplicate_summary": O.exact_duplicates(df, key),
        "duplicate_examples": O.duplicate_examples(df, key),
        "identifiers": O.identifier_candidates(df, key, approx=approx),
        "empty_constants": empty_constant,
        "flagged_columns": O.flagged_columns(empty_constant),
        "text_problems": O.text_problems(df, key),
        "textual_nulls": O.textual_nulls(df, key),
        "category_summary": O.category_summary(df, key),
        "category_frequencies": O.category_frequencies(df, key),
        "category_equivalences": O.equivalent_categories(df, key),
        "numeric_summary": O.numeric_summary(df, key, approx=approx),
        "numeric_outliers": O.numeric_outliers(df, key, approx=approx),
        "date_candidates": O.date_candidates(df, key, **kw),
        "date_results": O.date_conversion(df, key, **kw),
        "date_failures": O.date_failures(df, key, **kw),
        "temporal_summary": O.temporal_consistency(df, key, candidates=candidates, **kw),
        "temporal_inconsistencies": O.temporal_inconsistencies(df, key, candidates=candidates, **kw),
        "classification": O.classify_variables(df, key),
        "memory": O.storage_footprint(df, key, source_paths, output_paths),
        "validation_summary": summary,
        "status_counts": O.status_counts(summary),
        "pending_validations": O.pending_validations(summary),
    }


def run_profile(
    spark: SparkSession,
    source: str,
    out_dir: str,
    key: str | Sequence[str] | None = None,
    source_format: str = "parquet",
    header_row: int = 1,
    earliest: str = EARLIEST_DATE,
    as_of: _dt.datetime | None = None,
    approx: bool = False,
) -> dict[str, DataFrame]:
    """The whole profiling stage; returns the evidence tables, read back from what was written."""
    as_of = as_of or _dt.datetime.now()
    require_source(spark, source, "Place the source table before running the profile.")
    if source_format == "headed_text":
        raw = infer_types(nullify_markers(read_headed_table(spark, source, header_row=header_row)))
    else:
        raw = spark.read.parquet(source)
    renamed, mapping_df = O.normalize_columns(raw)
    preserved = O.values_preserved(raw, renamed).first()
    if not preserved["preserved"]:
        raise RuntimeError("Values changed while renaming columns.")
    mapping = {r["normalized_name"]: r["original_name"] for r in mapping_df.collect()}
    identified_path = f"{out_dir}/identified.parquet"
    mixed = [r["column"] for r in O.mixed_type_columns(renamed, key).select("column").collect()]  # a row per column
    write_identified(renamed, identified_path, mixed)
    # Lineage now starts at the written table, in the shared output folder.
    df = spark.read.parquet(identified_path)
    kw = {"earliest": earliest, "as_of": as_of, "mapping": mapping, "source_paths": [source], "output_paths": [identified_path]}
    tables = profile(df, key, approx=True, **kw) if approx else profile_job(df, f"{out_dir}/intermediate", key, **kw)
    produced = [identified_path]
    for name, table in tables.items():
        path = f"{out_dir}/tables/{name}.csv"
        write_evidence_csv(_csv_safe(table), path)
        produced.append(path)
    summary = spark.read.option("header", True).csv(f"{out_dir}/tables/validation_summary.csv")
    report_path = f"{out_dir}/metrics/validation_summary.json"
    write_report_json(validation_report(summary, tables["row_completeness"], run_time=as_of), report_path)
    produced.append(report_path)
    meta_path = f"{out_dir}/metrics/ingestion_metadata.json"
    produced.append(meta_path)
    meta = ingestion_metadata(
        df,
        [source],
        identified_path,
        produced=produced,
        required_member=None,
        stringified_columns=mixed,
        run_time=as_of,
        key=key,
    )
    write_report_json(meta, meta_path)
    write_evidence_csv(evidence_manifest(spark, produced), f"{out_dir}/tables/manifest.csv")
    return {name: spark.read.option("header", True).csv(f"{out_dir}/tables/{name}.csv") for name in tables}


def _csv_safe(df: DataFrame) -> DataFrame:
    """CSV holds no arrays or structs: those become JSON text."""
    return df.select(
        *[
            F.to_json(F.col(f"`{f.name}`")).alias(f.name)
            if f.dataType.typeName() in ("array", "struct", "map")
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def main(argv: Sequence[str] | None = None) -> None:
    """Command-line entry (``spark-submit tidemark/plans/profile.py SOURCE OUT_DIR``)."""
    import argparse

    from tidemark.session import configure

    parser = argparse.ArgumentParser(description="Profile a table and write the evidence tables.")
    parser.add_argument("source", help="Parquet path, or a folder of headed delimited text with --headed")
    parser.add_argument("out_dir", help="shared output folder")
    parser.add_argument("--key", action="append", help="row-key column (repeat for several)")
    parser.add_argument("--headed", action="store_true", help="source is delimited text with a title row")
    parser.add_argument("--header-row", type=int, default=1)
    parser.add_argument("--earliest", default=EARLIEST_DATE)
    parser.add_argument("--approx", action="store_true", help="sketches instead of exact distincts/quantiles")
    args = parser.parse_args(argv)
    spark = configure(SparkSession.builder.appName("tidemark-profile").getOrCreate())
    tables = run_profile(
        spark,
        args.source,
        args.out_dir,
        key=args.key,
        source_format="headed_text" if args.headed else "parquet",
        header_row=args.header_row,
        earliest=args.earliest,
        approx=args.approx,
    )
    tables["validation_summary"].orderBy(F.col("position").cast("int")).show(truncate=False)


if __name__ == "__main__":
    main()
