"""Text defects and textual null markers (string columns only).

Both read the hashed frequency table (``operators.frequencies``): regexes and the fold
run once per distinct short value, and long texts are judged where they are read, so
none is shuffled. A caller that has the table already passes it as ``freq``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import is_string, profiled_fields
from tidemark.functions.terms import TEXT_NULL_TOKENS
from tidemark.operators.frequencies import DEFECTS, Frequencies, frequencies, has_defect

Key = str | Sequence[str] | None

TEXT_COUNTERS = (
    "leading_spaces",
    "trailing_spaces",
    "double_spaces",
    "spelling_groups",
    "empty_strings",
    "only_spaces",
    "non_printable",
)


def string_fields(df: DataFrame, key: Key = None) -> list[T.StructField]:
    return [f for f in profiled_fields(df, key) if is_string(f)]


def _spelling_groups(freq: Frequencies) -> DataFrame:
    """(c, spelling_groups): folded texts with more than one spelling."""
    texts = freq.table.where(F.col("c").isin(freq.of(is_string)))
    spelled = texts.groupBy("c", "fold1", "fold2").agg(F.count(F.lit(1)).alias("spellings"))
    return spelled.groupBy("c").agg(F.count_if(F.col("spellings") > 1).alias("spelling_groups"))


def text_problems(df: DataFrame, key: Key = None, freq: Frequencies | None = None) -> DataFrame:
    """Per string column: the seven text-defect counters."""
    fields = string_fields(df, key)
    if not fields:
        return df.sparkSession.createDataFrame(
            [], "column string, " + ", ".join(f"{c} long" for c in TEXT_COUNTERS)
        )
    freq = freq or frequencies(df, fields, {"defects", "fold"})
    columns = freq.of(is_string)
    cells = F.col("n")
    counted = freq.table.where(F.col("c").isin(columns)).groupBy("c").agg(*[F.sum(F.when(has_defect(d), cells).otherwise(0)).alias(d) for d in DEFECTS])
    zero = F.lit(0).cast("long")
    # One row per string column on every side: broadcasts of proven size.
    joined = freq.names(columns).join(F.broadcast(counted), "c", "left").join(F.broadcast(_spelling_groups(freq)), "c", "left")
    return joined.select("column", *[F.coalesce(F.col(c), zero).alias(c) for c in TEXT_COUNTERS])


def textual_nulls(df: DataFrame, key: Key = None, tokens: Sequence[str] = TEXT_NULL_TOKENS, freq: Frequencies | None = None) -> DataFrame:
    """(column, token, count): values that spell a missing value after fold + upper."""
    fields = string_fields(df, key)
    if not fields:
        return df.sparkSession.createDataFrame([], "column string, token string, count long")
    freq = freq or frequencies(df, fields, {"fold"})
    hits = freq.table.where(F.col("marker").isin(list(tokens))).groupBy("c", F.col("marker").alias("token")).agg(F.sum("n").alias("count"))
    return hits.join(F.broadcast(freq.names()), "c").select("column", "token", "count")


def text_issue_total(df: DataFrame, key: Key = None, tokens: Sequence[str] = TEXT_NULL_TOKENS, freq: Frequencies | None = None) -> DataFrame:
    """One row, ``affected``: all text-defect counters plus textual-null cells (the summary's text check)."""
    fields = string_fields(df, key)
    zero = F.lit(0).cast("long")
    if not fields:
        return df.sparkSession.range(1).select(zero.alias("affected"))
    freq = freq or frequencies(df, fields, {"defects", "fold"})
    texts = freq.table.where(F.col("c").isin(freq.of(is_string)))
    defects = F.aggregate(F.array(*[has_defect(d).cast("long") for d in DEFECTS]), zero, lambda a, x: a + x)
    marker = F.when(F.col("marker").isin(list(tokens)), 1).otherwise(0)
    # Spellings of one folded text make a group; defects and markers are counted per cell.
    by_fold = texts.groupBy("c", "fold1", "fold2").agg(F.count(F.lit(1)).alias("spellings"), F.sum(F.col("n") * (defects + marker)).alias("cells"))
    total = F.count_if(F.col("spellings") > 1) + F.coalesce(F.sum("cells"), zero)
    return by_fold.agg(total.alias("affected"))
