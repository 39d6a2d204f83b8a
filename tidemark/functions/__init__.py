"""Column-level helpers: missing cells, percentages, text folding, date parsing."""

from tidemark.functions.columns import (
    as_text,
    is_missing,
    missing_count_per_row,
    pct,
    present,
    profiled_fields,
    qcol,
)
from tidemark.functions.dates import hours_between, to_timestamp_lenient
from tidemark.functions.text import category_key, fold_text, normalize_name

__all__ = [
    "as_text",
    "category_key",
    "fold_text",
    "hours_between",
    "is_missing",
    "missing_count_per_row",
    "normalize_name",
    "pct",
    "present",
    "profiled_fields",
    "qcol",
    "to_timestamp_lenient",
]
