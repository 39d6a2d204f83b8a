"""Sources: headed delimited text, guards for required paths and members, markers and types."""

from tidemark.sources.guards import (
    infer_types,
    list_members,
    nullify_markers,
    read_identified,
    require_source,
    require_table,
)
from tidemark.sources.headed import read_headed_table

__all__ = [
    "infer_types",
    "list_members",
    "nullify_markers",
    "read_headed_table",
    "read_identified",
    "require_source",
    "require_table",
]
