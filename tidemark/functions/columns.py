"""Column helpers shared by every operator.

Everything here builds JVM-side ``Column`` expressions; no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.DecimalType,
)
FLOATING_TYPES = (T.FloatType, T.DoubleType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)
# Types that the value-level checks read; anything nested is only counted.
SCALAR_TYPES = NUMERIC_TYPES + DATETIME_TYPES + (T.StringType, T.BooleanType)


def qcol(name: str) -> Column:
    """Reference a column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_key_list(key: str | Sequence[str] | None) -> list[str]:
    if key is None:
        return []
    if isinstance(key, str):
        return [key]
    return list(key)


def profiled_fields(df: DataFrame, key: str | Sequence[str] | None = None) -> list[T.StructField]:
    """Fields that are profiled: every column except the row-key columns."""
    skip = set(as_key_list(key))
    return [f for f in df.schema.fields if f.name not in skip]


def is_numeric(field: T.StructField, include_bool: bool = False) -> bool:
    if isinstance(field.dataType, NUMERIC_TYPES):
        return True
    return include_bool and isinstance(field.dataType, T.BooleanType)


def is_string(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.StringType)


def is_datetime(field: T.StructField) -> bool:
    return isinstance(field.dataType, DATETIME_TYPES)


def is_missing(field: T.StructField) -> Column:
    """Missing cell: null, or NaN for floating columns (NaN is not null in Spark)."""
    c = qcol(field.name)
    if isinstance(field.dataType, FLOATING_TYPES):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def present(field: T.StructField) -> Column:
    """The value when informed, else null (so NaN drops out of counts and distincts)."""
    return F.when(~is_missing(field), qcol(field.name))


def pct(num: Column, den: Column) -> Column:
    """num / den * 100 as double; 0.0 when the denominator is 0 or null."""
    return F.coalesce(F.try_divide(num, den) * F.lit(100.0), F.lit(0.0))


def balanced(op, items: Sequence[Column], empty: Column | None = None) -> Column:
    """Combine many columns with ``op`` as a balanced tree (depth log2 n, not n).

    A left-deep chain over hundreds of columns overflows the JVM stack during
    analysis; a balanced tree does not.
    """
    items = list(items)
    if not items:
        if empty is None:
            raise ValueError("nothing to combine")
        return empty
    while len(items) > 1:
        items = [op(items[i], items[i + 1]) if i + 1 < len(items) else items[i] for i in range(0, len(items), 2)]
    return items[0]


def missing_count_per_row(fields: Iterable[T.StructField]) -> Column:
    """Number of missing cells in the row, over the given fields."""
    return balanced(add, [is_missing(f).cast("int") for f in fields], F.lit(0))


def as_text(field: T.StructField) -> Column:
    """The value as text, null when missing."""
    return present(field).cast("string")


def explode_structs(rows: Sequence[Column]) -> Column:
    """``inline`` an array of same-typed structs: one output row per struct."""
    return F.inline(F.array(*rows))


def type_name(field: T.StructField) -> str:
    return field.dataType.simpleString()
