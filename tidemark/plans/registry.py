"""Registered queries: each operator run on whole test tables or a stand-in derived from them.

Every callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame. Double
columns are rounded to 6 decimals only here, at the output boundary, so that
sums taken in a different order compare equal with the SQL oracle.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import operators as O
from tidemark.functions.columns import balanced, qcol
from tidemark.functions.text import category_key, fold_text
from tidemark.functions.dates import to_timestamp_lenient
from tidemark.operators import metrics as M
from tidemark.operators import outcome as OC
from tidemark.operators import disclosure as DC
from tidemark.plans import evaluation as EV
from tidemark.plans import modeling as ML
from tidemark.plans.inputs import BACKGROUND, BASE_TABLES, PRICE_LIMITS, STATEMENTS, TIME_CUTS, table
from tidemark.plans.job import as_findings, profile_job
from tidemark.sinks import (
    evidence_manifest,
    fingerprint_files,
    ingestion_metadata,
    stringify_mixed,
    validation_report,
    write_evidence_csv,
    write_headed_text,
    write_identified,
)
from tidemark.session import checkpoint_dir
from tidemark.sources import infer_types, list_members, nullify_markers, read_headed_table

Query = Callable[[SparkSession, str], DataFrame]

# --- fixed values: the reference instant and lower limit of the date checks in registered queries
AS_OF = _dt.datetime(2026, 1, 1)
EARLIEST = "1900-01-01"
ROUND_DIGITS = 6


def rounded(df: DataFrame, digits: int = ROUND_DIGITS) -> DataFrame:
    """Doubles rounded to ``digits`` decimals, after snapping to 12 decimals.

    Sums in a different order differ in the last bits (0.04991849999999998 vs
    0.04991850000000001); the first rounding removes that noise so a value on a
    rounding boundary rounds the same way in every engine.
    """
    return df.select(
        *[
            F.round(F.round(qcol(f.name), 12), digits).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else qcol(f.name)
            for f in df.schema.fields
        ]
    )


def _census(spark, sf):
    return table(spark, sf, "census")


def _op(source, op, key=None, **kw) -> Query:
    return lambda spark, sf: rounded(op(source(spark, sf), key, **kw))


def _t(name):
    return lambda spark, sf: table(spark, sf, name)


DATE_KW = {"as_of": AS_OF, "earliest": EARLIEST}
CENSUS_KEY = "o_orderkey"
STAY_KEY = ["l_orderkey", "l_linenumber", "l_partkey"]


def _date_layouts(spark, sf):
    return table(spark, sf, "date_layouts").select("o_orderkey", to_timestamp_lenient(F.col("fecha")).alias("at"))


def _persisted_summary(spark, sf):
    """The summary of a persisted frame, settled before the frame is released: later queries on events scan files."""
    checkpoint_dir(spark)
    events = table(spark, sf, "events").persist()
    try:
        return rounded(O.numeric_summary(events, "event_id")).checkpoint(eager=True)
    finally:
        events.unpersist()


def _converted_dates(spark, sf):
    frame, _ = O.with_converted_dates(_census(spark, sf), CENSUS_KEY, **DATE_KW)
    return frame


def _normalized(spark, sf):
    renamed, _ = O.normalize_columns(table(spark, sf, "messy_orders"))
    return rounded(renamed)


def _values_preserved(spark, sf):
    original = table(spark, sf, "messy_orders")
    renamed, _ = O.normalize_columns(original)
    return O.values_preserved(original, renamed)


def _fold(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", fold_text(F.col("text")).alias("folded"))


def _category_key(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", category_key(F.col("text")).alias("key"))


def _summary(spark, sf):
    return rounded(O.validation_summary(_census(spark, sf), CENSUS_KEY, **DATE_KW))


def _flagged(spark, sf):
    return O.flagged_columns(O.empty_constant_columns(_census(spark, sf), CENSUS_KEY))


def _status_counts(spark, sf):
    return O.status_counts(O.validation_summary(_census(spark, sf), CENSUS_KEY, **DATE_KW))


def _pending(spark, sf):
    return O.pending_validations(O.validation_summary(_census(spark, sf), CENSUS_KEY, **DATE_KW))


def _scratch(spark, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _profile_job(spark, sf):
    """All evidence of the census from two intermediates, in long form; the tables read from names alone are left out."""
    tables = profile_job(_census(spark, sf), _scratch(spark, "profile"), CENSUS_KEY, **DATE_KW)
    tables.pop("classification")
    return rounded(as_findings(tables, CENSUS_KEY))


def _nullify(spark, sf):
    return rounded(nullify_markers(_census(spark, sf)))


def _stringify(spark, sf):
    return stringify_mixed(_census(spark, sf), ["id_cliente", "valor_total"])


QUERIES: dict[str, Query] = {
    # D: dimensions and nulls
    "dimensions": _op(_census, O.dimensions, CENSUS_KEY),
    "nulls_by_column": _op(_census, O.nulls_by_column, CENSUS_KEY),
    "row_completeness": _op(_census, O.row_completeness, CENSUS_KEY),
    "nulls_per_row": _op(_census, O.nulls_per_row, CENSUS_KEY),
    "missing_ranking": _op(_census, O.missing_ranking, CENSUS_KEY),
    # E: duplicates
    "exact_duplicates_documents": _op(_t("documents"), O.exact_duplicates, "doc_id"),
    "exact_duplicates_rows": _op(_t("lineitem"), O.exact_duplicates),
    "exact_duplicates_dup_orders": _op(_t("dup_orders"), O.exact_duplicates),
    "date_layouts": _date_layouts,
    "numeric_summary_persisted": _persisted_summary,
    "duplicate_examples_documents": _op(_t("documents"), O.duplicate_examples, "doc_id"),
    "duplicate_examples_dup_orders": _op(_t("dup_orders"), O.duplicate_examples),
    "duplicate_row_keys_documents": _op(_t("documents"), O.duplicate_row_keys, "doc_id"),
    # C / F: column shape
    "column_inventory": _op(_census, O.column_inventory, CENSUS_KEY),
    "identifier_candidates": _op(_census, O.identifier_candidates),
    "identifier_candidates_customer": _op(_t("customer"), O.identifier_candidates),
    "empty_constant_columns": _op(_census, O.empty_constant_columns, CENSUS_KEY),
    "flagged_columns": _flagged,
    "type_profile": _op(_census, O.type_profile, CENSUS_KEY),
    "mixed_type_columns": _op(_census, O.mixed_type_columns, CENSUS_KEY),
    # G: text
    "fold_text": _fold,
    "category_key": _category_key,
    "text_problems": _op(_census, O.text_problems, CENSUS_KEY),
    "text_problems_documents": _op(_t("documents"), O.text_problems, "doc_id"),
    "textual_nulls": _op(_census, O.textual_nulls, CENSUS_KEY),
    # H: categories
    "category_summary": _op(_census, O.category_summary, CENSUS_KEY),
    "category_summary_events": _op(_t("events"), O.category_summary, "event_id"),
    "category_frequencies": _op(_census, O.category_frequencies, CENSUS_KEY),
    "category_frequencies_events": _op(_t("events"), O.category_frequencies, "event_id"),
    "equivalent_categories": _op(_census, O.equivalent_categories, CENSUS_KEY),
    "category_variants": _op(_census, O.category_variants, CENSUS_KEY),
    # I: numeric
    "numeric_summary": _op(_t("events"), O.numeric_summary, "event_id"),
    "numeric_summary_documents": _op(_t("documents"), O.numeric_summary, "doc_id"),
    "numeric_summary_lineitem": _op(_t("lineitem"), O.numeric_summary),
    "numeric_outliers": _op(_t("events"), O.numeric_outliers, "event_id"),
    "numeric_outliers_documents": _op(_t("documents"), O.numeric_outliers, "doc_id"),
    # I: dates and time
    "date_candidates": _op(_census, O.date_candidates, CENSUS_KEY, **DATE_KW),
    "date_conversion": _op(_census, O.date_conversion, CENSUS_KEY, **DATE_KW),
    "date_failures": _op(_census, O.date_failures, CENSUS_KEY, **DATE_KW),
    "converted_dates": lambda spark, sf: rounded(_converted_dates(spark, sf)),
    "temporal_consistency": _op(_t("stay"), O.temporal_consistency, STAY_KEY, **DATE_KW),
    "temporal_inconsistencies": _op(_t("stay"), O.temporal_inconsistencies, STAY_KEY, **DATE_KW),
    "temporal_consistency_census": _op(_census, O.temporal_consistency, CENSUS_KEY, **DATE_KW),
    # C: names, schema, storage
    "normalize_columns": _normalized,
    "values_preserved": _values_preserved,
    "storage_footprint": _op(_census, O.storage_footprint, CENSUS_KEY),
    # J: consolidation
    "validation_summary": _summary,
    "status_counts": _status_counts,
    "pending_validations": _pending,
    "profile_job": _profile_job,
    # A / B: markers and text columns
    "nullify_markers": _nullify,
    "stringify_mixed": _stringify,
}


# ---------------------------------------------------------------- tier 2 and sources


def _stay_hours(spark, sf):
    return rounded(OC.length_of_stay(table(spark, sf, "stay"), "fecha_ingreso", "fecha_salida"))


def _scored_docs(spark, sf):
    # A monotone score of document length; quality labels as the outcome.
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    scored = lab.join(d, "doc_id")
    return scored.select("doc_id", "quality", (F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + F.col("n_chars") / F.lit(1000.0))).alias("score"))


def _classification(spark, sf):
    return rounded(M.classification_metrics(_scored_docs(spark, sf), "quality", "score", threshold=0.5))


def _regression(spark, sf):
    s = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("target"), (F.col("l_quantity") * F.lit(1000.0)).alias("prediction")
    )
    return rounded(M.regression_metrics(s, "target", "prediction"))


def _split_report(spark, sf):
    split = ML.assign_split(table(spark, sf, "stay"), "l_orderkey")
    return rounded(ML.split_report(split))


def _split_leakage(spark, sf):
    return ML.split_leakage(ML.assign_split(table(spark, sf, "stay"), "l_orderkey"), "l_orderkey")


def _explore(spark, sf):
    return rounded(OC.explore(table(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"], ["c_acctbal"], k_min=10))


def _correlations(spark, sf):
    return rounded(OC.correlations(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


def _clean(spark, sf):
    cleaned, _ = OC.clean(_census(spark, sf), CENSUS_KEY)
    return rounded(cleaned)


def _clean_report(spark, sf):
    _, report = OC.clean(_census(spark, sf), CENSUS_KEY)
    return report


def _data_dictionary(spark, sf):
    return rounded(OC.data_dictionary(_census(spark, sf), CENSUS_KEY).drop("missing_fields"))


def _classified(spark, sf):
    """Proposed groups with what is known of their columns: how much of each is informed."""
    census = _census(spark, sf)
    groups = O.classify_variables(census, CENSUS_KEY)
    return rounded(groups.join(F.broadcast(O.nulls_by_column(census, CENSUS_KEY).select("column", "non_nulls", "completeness_pct")), "column"))


def _infer_types(spark, sf):
    census = _census(spark, sf)
    as_text = census.select(*[F.col(c).cast("string").alias(c) for c in census.columns])
    return rounded(infer_types(as_text))


def _members(spark, sf):
    """The tables of the folder with their rows."""
    names = sorted(r["name"] for r in list_members(spark, sf).collect())  # a name per table
    parts = [spark.read.parquet(f"{sf}/{n}.parquet").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n in names]
    return balanced(DataFrame.unionByName, parts)


def _baseline(spark, sf):
    scored = ML.assign_split(_scored_docs(spark, sf), "doc_id")
    train, valid = scored.where("split = 'train'"), scored.where("split = 'validation'")
    return rounded(ML.baseline(train, valid, ["score"], "quality"))


def _scored_by_lang(spark, sf):
    lang = table(spark, sf, "documents").select("doc_id", "lang")
    return _scored_docs(spark, sf).join(lang, "doc_id")


def _time_split_report(spark, sf):
    split = ML.time_split(table(spark, sf, "orders"), "o_orderdate", *TIME_CUTS)
    return rounded(ML.split_report(split.withColumn("open", (F.col("o_orderstatus") == "O").cast("int")), "open"))


def _calibration(spark, sf):
    return rounded(ML.calibration(_scored_docs(spark, sf), "quality", "score", bins=10))


def _subgroup_metrics(spark, sf):
    return rounded(ML.subgroup_metrics(_scored_by_lang(spark, sf), "quality", "lang"))


def _subgroup_effects(spark, sf):
    return rounded(ML.subgroup_effects(_scored_by_lang(spark, sf), "lang", "quality"))


def _intervals(spark, sf):
    return rounded(EV.bootstrap_intervals(_scored_docs(spark, sf), "doc_id", "quality"))


def _explained(spark, sf):
    """Shares of two features in a score that is no sum of them."""
    score = F.log1p(F.col("o_totalprice") / 1000.0) * (1.0 + F.col("o_custkey") / 1000.0)
    explained = EV.contributions(table(spark, sf, "orders"), "o_orderkey", list(BACKGROUND), lambda df: df.withColumn("prediction", score), BACKGROUND, orders=2)
    off = F.max(F.abs(F.col("whole") - (F.col("prediction") - F.col("base"))))
    rows = explained.groupBy("o_orderkey", "prediction", "base").agg(F.sum("contribution").alias("whole")).agg((off < 1e-9).alias("adds_up"))
    return rounded(EV.contribution_summary(explained).withColumn("adds_up", rows.scalar()))


def _statements(spark, sf):
    scored = _scored_by_lang(spark, sf)
    metrics = EV.metric_rows({"test": M.classification_metrics(scored, "quality", "score"), "language": ML.subgroup_metrics(scored, "quality", "lang")}, {"language": "subgroup"})
    return rounded(EV.supported(STATEMENTS, metrics))


def _protected(spark, sf):
    return DC.protected_table(table(spark, sf, "customer"), "c_mktsegment", "c_nationkey", k_min=10)


def _cleaning(spark, sf):
    _, report = OC.clean_to(_census(spark, sf), _scratch(spark, "clean"), CENSUS_KEY, intervals=[("fecha_ingreso", "fecha_salida")], extremes={"valor_total": PRICE_LIMITS})
    return report


def _cleaned(spark, sf):
    cleaned, _ = OC.clean_to(_census(spark, sf), _scratch(spark, "clean"), CENSUS_KEY, intervals=[("fecha_ingreso", "fecha_salida")], extremes={"valor_total": PRICE_LIMITS})
    return rounded(cleaned)


def _priced_lines(spark, sf):
    """Order lines split by ship date: the price is to be told from the quantity."""
    return ML.time_split(table(spark, sf, "lineitem"), "l_shipdate", *TIME_CUTS)


def _baseline_regression(spark, sf):
    split = _priced_lines(spark, sf)
    train, valid = split.where("split = 'train'"), split.where("split = 'validation'")
    return rounded(ML.baseline(train, valid, ["l_quantity"], "l_extendedprice", task="regression"), 3)


def _measured_docs(spark, sf):
    """Labelled documents with features of their texts, split by a hash of the id."""
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != ""))
    docs = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), words.cast("double").alias("n_words"), (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))).cast("double").alias("capitals"))
    return ML.assign_split(table(spark, sf, "labels").join(docs, "doc_id"), "doc_id")


_MEASURES = ["n_chars", "n_words", "capitals"]


def _compared(spark, sf):
    split = _measured_docs(spark, sf)
    results, _ = ML.compare_models(split.where("split = 'train'"), split.where("split = 'validation'"), _MEASURES, "quality")
    return rounded(results)


def _importance(spark, sf):
    split = _measured_docs(spark, sf)
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    model = ML.fit_linear(train, _MEASURES, "quality")
    return rounded(ML.permutation_importance(model, test, _MEASURES, "quality", "doc_id"))


def _footprint_files(spark, sf):
    """The census with the size of its source and of what is written of it."""
    census, path = _census(spark, sf), _scratch(spark, "identified") + "/identified.parquet"
    write_identified(census, path)
    return rounded(O.storage_footprint(census, CENSUS_KEY, [f"{sf}/orders.parquet"], [path]))


QUERIES.update(
    {
        "baseline_regression": _baseline_regression,
        "compare_models": _compared,
        "permutation_importance": _importance,
        "storage_footprint_files": _footprint_files,
        "time_split_report": _time_split_report,
        "calibration": _calibration,
        "subgroup_metrics": _subgroup_metrics,
        "subgroup_effects": _subgroup_effects,
        "bootstrap_intervals": _intervals,
        "contribution_summary": _explained,
        "supported_statements": _statements,
        "protected_table": _protected,
        "cleaning_contract": _cleaning,
        "cleaned_table": _cleaned,
        "length_of_stay": _stay_hours,
        "classification_metrics": _classification,
        "regression_metrics": _regression,
        "split_report": _split_report,
        "split_leakage": _split_leakage,
        "explore": _explore,
        "correlations": _correlations,
        "clean": _clean,
        "clean_report": _clean_report,
        "data_dictionary": _data_dictionary,
        "classified_columns": _classified,
        "infer_types": _infer_types,
        "list_members": _members,
        "baseline": _baseline,
    }
)


# ---------------------------------------------------------------- lineage


def _table_paths(sf):
    return [f"{sf}/{t}.parquet" for t in BASE_TABLES]


def _fingerprints(spark, sf):
    return fingerprint_files(spark, _table_paths(sf))


def _manifest(spark, sf):
    """Evidence of the census written as CSV, and what the manifest and the files say of it."""
    census, folder = _census(spark, sf), _scratch(spark, "evidence")
    tables = {"dimensions": O.dimensions(census, CENSUS_KEY), "nulls": O.nulls_by_column(census, CENSUS_KEY), "date_failures": O.date_failures(census, CENSUS_KEY, **DATE_KW)}
    paths = {n: write_evidence_csv(t, f"{folder}/{n}.csv") for n, t in tables.items()}
    rows = [spark.read.option("header", True).csv(path).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n, path in paths.items()]
    listed = evidence_manifest(spark, [*paths.values(), f"{folder}/not_written.csv"])
    told = listed.select(F.regexp_extract("path", "([^/]+)[.]csv$", 1).alias("name"), "exists", (F.coalesce("bytes", F.lit(0)) > 0).alias("has_bytes"))
    return told.join(F.broadcast(balanced(DataFrame.unionByName, rows)), "name", "left")


def _ingestion(spark, sf):
    census = _census(spark, sf)
    meta = ingestion_metadata(
        census,
        [f"{sf}/orders.parquet"],
        None,
        produced=[f"{t}.parquet" for t in BASE_TABLES],
        required_member="orders",
        ignored_members=[t for t in BASE_TABLES if t != "orders"],
        run_time=AS_OF,
        key=CENSUS_KEY,
    )
    # Versions, hashes and paths differ from run to run; what the tables say does not.
    source = F.get("sources", F.lit(0))
    return meta.select("run_time", "member_used", F.array_join("members_ignored", ",").alias("members_ignored"), "rows", "columns", "null_cells", "duplicate_rows", F.array_join("produced", ",").alias("produced"), source["files"].alias("source_files"), (F.length(source["sha256"]) == 64).alias("source_hashed"))


def _report(spark, sf):
    census = _census(spark, sf)
    summary = O.validation_summary(census, CENSUS_KEY, **DATE_KW)
    report = validation_report(summary, O.row_completeness(census, CENSUS_KEY), run_time=AS_OF)
    return rounded(report.select("run_time", "all_null_rows", "rows_with_nulls", "complete_rows", F.inline("summary")))


QUERIES.update(
    {
        "fingerprint_files": _fingerprints,
        "evidence_manifest": _manifest,
        "ingestion_metadata": _ingestion,
        "validation_report": _report,
    }
)


def _headed_round_trip(spark, sf):
    """Census written as headed text (title row first) in the shared scratch folder, read back and typed."""
    folder = _scratch(spark, "headed")
    write_headed_text(_census(spark, sf), folder, title="Census export")
    typed = infer_types(nullify_markers(read_headed_table(spark, folder, header_row=1)))
    return rounded(typed)


QUERIES["read_headed_table"] = _headed_round_trip
