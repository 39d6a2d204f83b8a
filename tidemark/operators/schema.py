"""Names, types and storage: schema-level operators.

Column names are schema metadata, so naming rules run as plain Python on the
driver (no data is touched). Everything that reads values is a Spark
aggregate: type classes per value, byte sizes, file sizes.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import (
    as_key_list,
    balanced,
    explode_structs,
    is_datetime,
    is_missing,
    is_numeric,
    is_string,
    profiled_fields,
    qcol,
    type_name,
)
from tidemark.functions.terms import CLASSIFICATION_CRITERION, OTHER_GROUP, VARIABLE_GROUPS
from tidemark.functions.text import fold_value, normalize_name
from tidemark.operators.duplicates import canonical
from tidemark.operators.frequencies import Frequencies, frequencies, text_class

Key = str | Sequence[str] | None

#: First values of a text column whose classes are told apart from those of all values.
SAMPLE = 100
#: Hash buckets that two frames are compared in.
PRESERVED_BUCKETS = 4096

# --- fixed values: type classes, named like the Python types they stand for
_PY_NAMES = {
    T.ByteType: "int",
    T.ShortType: "int",
    T.IntegerType: "int",
    T.LongType: "int",
    T.FloatType: "float",
    T.DoubleType: "float",
    T.DecimalType: "Decimal",
    T.StringType: "str",
    T.BooleanType: "bool",
    T.TimestampType: "datetime",
    T.TimestampNTZType: "datetime",
    T.DateType: "date",
    T.BinaryType: "bytearray",
    T.ArrayType: "list",
    T.MapType: "dict",
    T.StructType: "Row",
}


def normalize_columns(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rename to normalised names (n-th repeat gets ``__n``); values untouched.

    Positional ``toDF`` is used because renaming by name is case-insensitive.
    Returns (renamed frame, mapping frame of position, original_name, normalized_name).
    """
    table = pd.DataFrame({"original_name": df.columns})
    table["normalized_name"] = table["original_name"].map(normalize_name)
    turn = table.groupby("normalized_name").cumcount()
    table.loc[turn > 0, "normalized_name"] += "__" + (turn[turn > 0] + 1).astype(str)
    table.insert(0, "position", range(1, len(table) + 1))
    mapping = df.sparkSession.createDataFrame(
        list(table.itertuples(index=False, name=None)), "position int, original_name string, normalized_name string"
    )
    return df.toDF(*table["normalized_name"]), mapping


def name_mapping(df: DataFrame) -> dict[str, str]:
    """{normalized: original} for the frame's columns."""
    _, mapping = normalize_columns(df)
    return {r["normalized_name"]: r["original_name"] for r in mapping.collect()}


def _row_hashes(df: DataFrame) -> DataFrame:
    """(bucket, rows, and two order-free sums of row hashes) of a frame's rows, whatever their order."""
    fields = df.schema.fields
    # Null, a missing value's type and -0.0 are told apart or not as EXCEPT ALL does.
    values = [c for f in fields for c in (canonical(f), qcol(f.name).isNull())]
    hashed = df.select(F.xxhash64(F.lit(41), *values).alias("_h"), F.xxhash64(F.lit(43), *values).alias("_g"))
    sums = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("_h", "_g")]
    return hashed.groupBy(F.pmod("_h", F.lit(PRESERVED_BUCKETS)).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"), *sums)


def values_preserved(a: DataFrame, b: DataFrame) -> DataFrame:
    """Row-multiset equality by position (null-safe): only_in_first, only_in_second, preserved.

    Each side is read once into order-free sums of two row hashes per hash bucket, a
    fixed number of rows. Equal sums prove equal multisets up to a collision of 128
    bits. Only rows of buckets that differ are compared as whole rows (EXCEPT ALL both
    ways), so equal frames shuffle no rows at all.
    """
    if len(a.columns) != len(b.columns):
        raise ValueError("frames differ in column count")
    names = [f"c{i}" for i in range(len(a.columns))]
    a, b = a.toDF(*names), b.toDF(*names)
    other = _row_hashes(b).toDF("_bucket", "_n2", "_h2", "_g2")
    same = F.col("_n").eqNullSafe(F.col("_n2")) & F.col("_h").eqNullSafe(F.col("_h2")) & F.col("_g").eqNullSafe(F.col("_g2"))
    differing = _row_hashes(a).join(other, "_bucket", "full").where(~same).select("_bucket")
    wanted = [r["_bucket"] for r in differing.collect()]  # at most PRESERVED_BUCKETS numbers
    if not wanted:
        zero = F.lit(0).cast("long")
        return a.sparkSession.range(1).select(zero.alias("only_in_first"), zero.alias("only_in_second"), F.lit(True).alias("preserved"))

    def rows(df: DataFrame) -> DataFrame:
        values = [c for f in df.schema.fields for c in (canonical(f), qcol(f.name).isNull())]
        bucket = F.pmod(F.xxhash64(F.lit(41), *values), F.lit(PRESERVED_BUCKETS))
        return df if len(wanted) == PRESERVED_BUCKETS else df.where(bucket.isin(wanted))

    first, second = rows(a), rows(b)
    only_a = first.exceptAll(second).agg(F.count(F.lit(1)).alias("only_in_first"))
    only_b = second.exceptAll(first).agg(F.count(F.lit(1)).alias("only_in_second"))
    both = only_a.select("only_in_first", only_b.select(F.first("only_in_second")).scalar().alias("only_in_second"))
    return both.withColumn("preserved", (F.col("only_in_first") == 0) & (F.col("only_in_second") == 0))


def _py_name(field: T.StructField) -> str:
    for t, name in _PY_NAMES.items():
        if isinstance(field.dataType, t):
            return name
    return type_name(field)


def variant_class(c: Column) -> Column:
    """Per-value class of a VARIANT value from ``schema_of_variant``, named like the Python type."""
    t = F.upper(F.schema_of_variant(c))
    return (
        F.when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.lit("int"))
        .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), F.lit("float"))
        .when(t == "BOOLEAN", F.lit("bool"))
        .when(t == "DATE", F.lit("date"))
        .when(t.startswith("TIMESTAMP"), F.lit("datetime"))
        .when(t.startswith("OBJECT"), F.lit("dict"))
        .when(t.startswith("ARRAY"), F.lit("list"))
        .when(t == "STRING", F.lit("str"))
        .otherwise(F.lower(t))
    )


def _is_variant(field: T.StructField) -> bool:
    return field.dataType.typeName() == "variant"


def _first_classes(df: DataFrame, keys: list[str], texts: Sequence[T.StructField], sample: int) -> DataFrame:
    """(column, class) of the first ``sample`` informed values per column: a bounded heap per task, no sort."""
    parts = []
    for f in texts:
        c = qcol(f.name)
        value = c.cast("string").alias("_v")
        first = df.where(c.isNotNull()).select(*[qcol(k) for k in keys], value, (variant_class(c) if _is_variant(f) else text_class(c)).alias("class"))
        parts.append(first.orderBy(*[qcol(k) for k in keys], "_v").limit(sample).select(F.lit(f.name).alias("column"), "class"))
    return balanced(DataFrame.unionByName, parts)


def type_profile(df: DataFrame, key: Key = None, sample: int = SAMPLE, freq: Frequencies | None = None, first: DataFrame | None = None) -> DataFrame:
    """Per column: type flags, classes in the first ``sample`` values and in all values, mixed flag.

    Typed columns hold one class. Text values are classed once per distinct value, in
    the frequency table; the class sets are bounded (five names). ``first`` has the
    classes of the first values (column, class) where the caller knows them already.
    """
    keys = as_key_list(key)
    fields = profiled_fields(df, key)
    if not fields:
        return df.sparkSession.createDataFrame([], _TYPE_SCHEMA)
    texts = [f for f in fields if is_string(f) or _is_variant(f)]
    typed = [f for f in fields if f not in texts]
    spark = df.sparkSession
    flags = spark.createDataFrame(
        [
            (
                i + 1,
                f.name,
                type_name(f),
                is_numeric(f, include_bool=True),
                is_string(f),
                isinstance(f.dataType, T.BooleanType),
                is_datetime(f),
                not (is_numeric(f, include_bool=True) or is_datetime(f)),
                None if f in texts else _py_name(f),
            )
            for i, f in enumerate(fields)
        ],
        "position int, column string, data_type string, is_numeric boolean, is_text boolean, "
        "is_boolean boolean, is_datetime boolean, is_object boolean, fixed_class string",
    )
    parts = []
    if typed:
        if freq is not None:
            has = freq.table.groupBy("c").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(freq.names(freq.of(lambda f: f in typed))), "c")
            some = has.select("column", F.lit(True).alias("_has"))
        else:
            nn = df.agg(*[F.count_if(~is_missing(f)).alias(f"_nn{i}") for i, f in enumerate(typed)])
            some = nn.select(explode_structs([F.struct(F.lit(f.name).alias("column"), (F.col(f"_nn{i}") > 0).alias("_has")) for i, f in enumerate(typed)]))
        parts.append(some.select("column", F.lit(None).cast("array<string>").alias("_all"), F.lit(None).cast("array<string>").alias("_sample"), "_has"))
    if texts:
        strings, variants = [f for f in texts if is_string(f)], [f for f in texts if _is_variant(f)]
        found = []
        if strings:
            of = freq or frequencies(df, strings, {"class"})
            which = of.of(is_string)
            found.append(of.table.where(F.col("c").isin(which)).select("c", "class").distinct().join(F.broadcast(of.names(which)), "c").select("column", "class"))
        if variants:
            cells = df.select(explode_structs([F.struct(F.lit(f.name).alias("column"), variant_class(qcol(f.name)).alias("class")) for f in variants]))
            found.append(cells.where(F.col("class").isNotNull()).distinct())
        every = balanced(DataFrame.unionByName, found).groupBy("column").agg(F.array_sort(F.collect_set("class")).alias("_all"))
        first = _first_classes(df, keys, texts, sample) if first is None else first
        sampled = first.groupBy("column").agg(F.array_sort(F.collect_set("class")).alias("_sample"))
        parts.append(every.join(F.broadcast(sampled), "column").select("column", "_all", "_sample", F.lit(True).alias("_has")))
    # Both sides hold at most one row per column.
    joined = flags.join(F.broadcast(balanced(DataFrame.unionByName, parts)), "column", "left")
    none = F.array().cast("array<string>")
    fixed = F.when(F.col("_has"), F.array(F.col("fixed_class"))).otherwise(none)
    is_fixed = F.col("fixed_class").isNotNull()
    all_c = F.coalesce(F.when(is_fixed, fixed).otherwise(F.col("_all")), none)
    sample_c = F.coalesce(F.when(is_fixed, fixed).otherwise(F.col("_sample")), none)
    return joined.select(
        "position",
        "column",
        "data_type",
        "is_numeric",
        "is_text",
        "is_boolean",
        "is_datetime",
        "is_object",
        F.array_join(sample_c, ", ").alias("sample_types"),
        F.array_join(all_c, ", ").alias("all_types"),
        (F.size(all_c) > 1).alias("mixed"),
    )


_TYPE_SCHEMA = (
    "position int, column string, data_type string, is_numeric boolean, is_text boolean, is_boolean boolean, "
    "is_datetime boolean, is_object boolean, sample_types string, all_types string, mixed boolean"
)


def mixed_type_columns(df: DataFrame, key: Key = None) -> DataFrame:
    """Text columns whose values fall in more than one class."""
    return type_profile(df, key).where(F.col("mixed")).select("column", "all_types")


def classify_variables(df: DataFrame, key: Key = None) -> DataFrame:
    """Proposed variable group per column from its folded name; always needs human review."""
    columns = df.sparkSession.createDataFrame(
        [(f.name, fold_value(f.name), type_name(f)) for f in profiled_fields(df, key)], "column string, folded string, data_type string"
    )
    hit = [F.when(F.col("folded").rlike("|".join(map(re.escape, terms))), F.lit(group)) for group, terms in VARIABLE_GROUPS]
    return columns.withColumn("groups", F.array_compact(F.array(*hit))).select(
        "column",
        F.coalesce(F.get("groups", F.lit(0)), F.lit(OTHER_GROUP)).alias("proposed_group"),
        F.array_join(F.slice("groups", 2, len(hit)), " | ").alias("alternative_groups"),
        "data_type",
        F.lit(CLASSIFICATION_CRITERION).alias("criterion"),
        F.lit(True).alias("needs_review"),
    )


# --- fixed values: bytes per value of fixed-width types (Spark's in-memory widths)
_WIDTHS = (
    (T.BooleanType, 1),
    (T.ByteType, 1),
    (T.ShortType, 2),
    (T.IntegerType, 4),
    (T.DateType, 4),
    (T.FloatType, 4),
    (T.LongType, 8),
    (T.DoubleType, 8),
    (T.TimestampType, 8),
    (T.TimestampNTZType, 8),
)


def _fixed_width(dt: T.DataType) -> int:
    if isinstance(dt, T.DecimalType):
        return 8 if dt.precision <= 18 else 16
    for t, width in _WIDTHS:
        if isinstance(dt, t):
            return width
    return 8


def _column_bytes(field: T.StructField) -> Column:
    c = qcol(field.name)
    dt = field.dataType
    if isinstance(dt, T.StringType):
        return F.coalesce(F.sum(F.octet_length(c)), F.lit(0).cast("long"))
    if isinstance(dt, T.BinaryType):
        return F.coalesce(F.sum(F.length(c)), F.lit(0).cast("long"))
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.sum(F.octet_length(c.cast("string"))), F.lit(0).cast("long"))
    return F.count(F.lit(1)) * F.lit(_fixed_width(dt)).cast("long")


def file_bytes(spark, paths: Sequence[str] | None) -> Column:
    """Total size of the files under ``paths``; ``binaryFile`` prunes the content column."""
    if not paths:
        return F.lit(None).cast("long")
    listing = spark.read.format("binaryFile").load(list(paths)).select("length")
    return listing.agg(F.sum("length")).scalar()


def storage_footprint(
    df: DataFrame,
    key: Key = None,
    source_paths: Sequence[str] | None = None,
    output_paths: Sequence[str] | None = None,
    freq: Frequencies | None = None,
) -> DataFrame:
    """Value bytes per column and in total, with source and output file sizes and their ratio.

    Strings count UTF-8 bytes, fixed-width types their width per row.
    """
    fields = profiled_fields(df, key)
    spark = df.sparkSession
    if freq is None:
        agg = df.agg(*[_column_bytes(f).alias(f"_b{i}") for i, f in enumerate(fields)])
    else:
        # Value bytes of text from the frequency table; fixed-width columns need the number of rows only.
        place = {f.name: i for i, f in enumerate(freq.fields)}
        text = [F.coalesce(F.sum(F.when(F.col("c") == place[f.name], F.col("n") * F.col("bytes"))), F.lit(0).cast("long")) if is_string(f) else None for f in fields]
        agg = freq.table.agg(*[(freq.rows * F.lit(_fixed_width(f.dataType)).cast("long") if t is None else t).alias(f"_b{i}") for i, (f, t) in enumerate(zip(fields, text, strict=True))])
    src = file_bytes(spark, source_paths)
    out = file_bytes(spark, output_paths)
    total = balanced(add, [F.col(f"_b{i}") for i in range(len(fields))], F.lit(0).cast("long"))
    none_l, none_d = F.lit(None).cast("long"), F.lit(None).cast("double")
    rows = [
        F.struct(
            F.lit("dataframe_total").alias("element"),
            F.lit(None).cast("string").alias("column"),
            total.alias("bytes"),
            src.alias("source_bytes"),
            out.alias("output_bytes"),
            F.try_divide(src, out).cast("double").alias("source_to_output_ratio"),
        )
    ]
    rows += [
        F.struct(
            F.lit("column").alias("element"),
            F.lit(f.name).alias("column"),
            F.col(f"_b{i}").alias("bytes"),
            none_l.alias("source_bytes"),
            none_l.alias("output_bytes"),
            none_d.alias("source_to_output_ratio"),
        )
        for i, f in enumerate(fields)
    ]
    return agg.select(explode_structs(rows))
