"""Profiling operators: each is ``f(df, key=None, ...) -> DataFrame`` and lazy.

``key`` names the row-key column(s): they identify rows in evidence tables and
are not profiled themselves.
"""

from tidemark.operators.categorical import category_frequencies, category_summary, category_variants, equivalent_categories
from tidemark.operators.dates import (
    date_candidates,
    date_conversion,
    date_failures,
    date_profile,
    temporal_consistency,
    temporal_inconsistencies,
    with_converted_dates,
)
from tidemark.operators.duplicates import duplicate_examples, duplicate_row_keys, exact_duplicates
from tidemark.operators.nulls import dimensions, missing_ranking, nulls_by_column, nulls_per_row, row_completeness
from tidemark.operators.numeric import numeric_outliers, numeric_summary
from tidemark.operators.schema import (
    classify_variables,
    mixed_type_columns,
    normalize_columns,
    storage_footprint,
    type_profile,
    values_preserved,
)
from tidemark.operators.shape import column_inventory, empty_constant_columns, flagged_columns, identifier_candidates
from tidemark.operators.summary import pending_validations, status_counts, validation_summary
from tidemark.operators.text import text_problems, textual_nulls

__all__ = [
    "category_frequencies",
    "category_summary",
    "category_variants",
    "classify_variables",
    "column_inventory",
    "date_candidates",
    "date_conversion",
    "date_failures",
    "date_profile",
    "dimensions",
    "duplicate_examples",
    "duplicate_row_keys",
    "empty_constant_columns",
    "equivalent_categories",
    "exact_duplicates",
    "flagged_columns",
    "identifier_candidates",
    "missing_ranking",
    "mixed_type_columns",
    "normalize_columns",
    "nulls_by_column",
    "nulls_per_row",
    "numeric_outliers",
    "numeric_summary",
    "pending_validations",
    "row_completeness",
    "status_counts",
    "storage_footprint",
    "temporal_consistency",
    "temporal_inconsistencies",
    "text_problems",
    "textual_nulls",
    "type_profile",
    "validation_summary",
    "values_preserved",
    "with_converted_dates",
]
