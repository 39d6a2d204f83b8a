"""Source guards and markers: required paths and members, reader-style null markers, types."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import qcol
from tidemark.functions.dates import to_timestamp_lenient
from tidemark.functions.terms import DEFAULT_NA_MARKERS


def require_source(spark: SparkSession, path: str, instruction: str = "") -> str:
    """Raise ``FileNotFoundError`` naming the path and what to do when it does not exist."""
    try:
        spark.read.format("binaryFile").load(path).select("path").limit(1).collect()
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in str(err) or "Path does not exist" in str(err):
            raise FileNotFoundError(f"Missing {path}. {instruction}".strip()) from None
        raise
    return path


def list_members(spark: SparkSession, root: str, suffix: str = ".parquet") -> DataFrame:
    """Names of the tables (files or folders ending in ``suffix``) under ``root``, without reading data."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    member = F.regexp_extract(F.col("path"), "([^/]+)" + suffix.replace(".", "[.]") + "(/|$)", 1)
    return listing.select(member.alias("name")).where(F.col("name") != "").distinct()


def require_table(members: Iterable[str], required: str, source: str = "") -> tuple[str, list[str]]:
    """Exact, case-sensitive membership; returns (required, ignored members)."""
    found = list(members)
    if required not in found:
        where = f" in {source}" if source else ""
        raise ValueError(f"No table named {required!r}{where}; there are {len(found)}: {', '.join(sorted(found)) or 'none'}")
    return required, [m for m in found if m != required]


def read_identified(spark: SparkSession, path: str, instruction: str = "Run the identification step first.") -> DataFrame:
    """Parquet re-read of an identified table, with a clear error when it is missing."""
    require_source(spark, path, instruction)
    return spark.read.parquet(path)


def nullify_markers(df: DataFrame, markers: Sequence[str] = DEFAULT_NA_MARKERS) -> DataFrame:
    """Text cells equal to a missing-value marker become null (string columns only)."""
    values = list(markers)
    return df.select(
        *[
            F.when(qcol(f.name).isin(values), F.lit(None)).otherwise(qcol(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else qcol(f.name)
            for f in df.schema.fields
        ]
    )


# --- fixed values: types tried on text columns, narrowest first, with the texts that may become one. A code
# such as 007, 2D or Y stays text.
_WHOLE = "[+-]?(0|[1-9][0-9]*)"
TYPE_LADDER = {
    "bigint": f"^{_WHOLE}\\z",
    "double": f"^({_WHOLE}([.][0-9]*)?|[+-]?[.][0-9]+)([eE][+-]?[0-9]+)?\\z",
    "boolean": "^(true|false|True|False|TRUE|FALSE)\\z",
    "timestamp_ntz": "^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([T ].*)?\\z",
}


def _as(c: Column, kind: str) -> Column:
    """The value as ``kind``, or null where its text is not one; offsets are turned to UTC."""
    value = to_timestamp_lenient(c) if kind == "timestamp_ntz" else c.try_cast(kind)
    return F.when(c.rlike(TYPE_LADDER[kind]), value)


def infer_types(df: DataFrame, ladder: Sequence[str] = tuple(TYPE_LADDER)) -> DataFrame:
    """Each text column as the first type that all its informed values are written as.

    One wide aggregate counts the values that are not, per (column, type); that
    single row is the only thing collected.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    misses = [F.count_if(qcol(c).isNotNull() & _as(qcol(c), t).isNull()).alias(f"f{i}_{t}") for i, c in enumerate(texts) for t in ladder]
    row = df.agg(*misses, *[F.count(qcol(c)).alias(f"n{i}") for i, c in enumerate(texts)]).first()
    kinds = {c: next((t for t in ladder if row[f"n{i}"] and not row[f"f{i}_{t}"]), None) for i, c in enumerate(texts)}
    return df.select(*[_as(qcol(c), kinds[c]).alias(c) if kinds.get(c) else qcol(c) for c in df.columns])
