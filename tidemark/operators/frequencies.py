"""The hashed frequency table that the column checks share.

One row per column and distinct informed value. A value of at most ``SHORT`` bytes
is its own key; a longer one is named by two seeded 64-bit hashes, its checksum and
its length, so no long text enters a shuffle: what the checks need to know of it is
found where it is read and goes along as a few fixed-size attributes. Two long texts
count as one only if all four agree. Hot values are combined map-side.

Texts of long values are fetched from the source for the rows of a result alone
(``with_texts``), and the source is read for that only if such a row is there.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass, replace
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import DATETIME_TYPES, FLOATING_TYPES, NUMERIC_TYPES, balanced, explode_structs, is_string, present
from tidemark.functions.dates import to_timestamp_lenient
from tidemark.functions.terms import ALNUM_ID, DATE_OR_TIME_HINT, DIGITS_ONLY, NON_PRINTABLE, WS
from tidemark.functions.text import fold_text, strip_ascii_punctuation
from tidemark.session import checkpoint_dir

#: Longest value, in bytes, that is its own key, and the characters of a value that orders are begun with.
SHORT, HEAD = 128, 64
#: Longest folded text that is kept as text (null markers are shorter).
MARKER = 64

VALUE_KEY = ("c", "value", "h1", "h2", "check", "length")
DEFECTS = ("leading_spaces", "trailing_spaces", "double_spaces", "empty_strings", "only_spaces", "non_printable")
#: Attributes by the name a caller asks for them.
ATTRIBUTES = {
    "pattern": ("digits", "alnum"),
    "defects": ("defects",),
    "class": ("class",),
    "date": ("hint", "at"),
    "fold": ("fold1", "fold2", "marker"),
    "equivalent": ("key1", "key2"),
}


def groupable(field: T.StructField) -> bool:
    return not isinstance(field.dataType, T.MapType)


def value_identity(field: T.StructField) -> Column:
    """Informed value as canonical text: -0.0 and 0.0 are one value, as in grouping."""
    c = present(field)
    if isinstance(field.dataType, FLOATING_TYPES):
        c = F.when(c == 0, F.lit(0.0)).otherwise(c)
    return c.cast("string")


def _can_be_long(field: T.StructField) -> bool:
    return not isinstance(field.dataType, (*NUMERIC_TYPES, *DATETIME_TYPES, T.BooleanType))


def text_class(c: Column) -> Column:
    """Lexical class of a text value: int, float, bool, datetime or str."""
    return (
        F.when(c.rlike(INT_TEXT), F.lit("int"))
        .when(c.rlike(FLOAT_TEXT), F.lit("float"))
        .when(F.lower(c).isin(list(BOOL_TEXT)), F.lit("bool"))
        .when(c.rlike(DATETIME_TEXT), F.lit("datetime"))
        .otherwise(F.lit("str"))
    )


# What the lexical classes accept.
INT_TEXT = "^[+-]?[0-9]+\\z"
FLOAT_TEXT = "^[+-]?([0-9]+[.][0-9]*|[.][0-9]+|[0-9]+)([eE][+-]?[0-9]+)?\\z"
DATETIME_TEXT = "^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([T ][0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?)?\\z"
BOOL_TEXT = ("true", "false")


def _defects(v: Column) -> Column:
    tests = (v.rlike("^" + WS), v.rlike(WS + "\\z"), v.rlike(WS + "{2}"), v == "", v.rlike("^" + WS + "+\\z"), v.rlike(NON_PRINTABLE))
    return balanced(add, [F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)])


def has_defect(name: str) -> Column:
    return F.col("defects").bitwiseAND(1 << DEFECTS.index(name)) != 0


def _with_attributes(rows: DataFrame, fields: Sequence[T.StructField], want: Collection[str]) -> DataFrame:
    """``rows`` has ``c`` and ``value``; the attributes asked for are added."""
    v = F.col("value")
    texts = [i for i, f in enumerate(fields) if is_string(f)]
    stamps = [i for i, f in enumerate(fields) if isinstance(f.dataType, DATETIME_TYPES)]
    of_text = F.col("c").isin(texts)
    new = {"length": F.length(v), "bytes": F.octet_length(v), "head": F.left(v, F.lit(HEAD))}
    if "pattern" in want:
        new |= {"digits": v.rlike(DIGITS_ONLY), "alnum": v.rlike(ALNUM_ID)}
    if "defects" in want:
        new["defects"] = F.when(of_text, _defects(v))
    if "class" in want:
        new["class"] = F.when(of_text, text_class(v))
    if "date" in want:
        new |= {"hint": v.rlike(DATE_OR_TIME_HINT), "at": F.when(F.col("c").isin(stamps), v.try_cast("timestamp_ntz")).otherwise(to_timestamp_lenient(v))}
    out = rows.withColumns(new)
    if "fold" in want or "equivalent" in want:
        out = out.withColumn("folded", fold_text(F.when(of_text, v)))
        if "fold" in want:
            marker = F.when(F.length("folded") <= MARKER, F.upper("folded"))
            out = out.withColumns({"fold1": F.xxhash64("folded"), "fold2": F.xxhash64(F.lit(31), "folded"), "marker": marker})
        if "equivalent" in want:
            plain = F.nullif(strip_ascii_punctuation(F.col("folded")), F.lit(""))
            out = out.withColumns({"key1": F.when(plain.isNotNull(), F.xxhash64(plain)), "key2": F.when(plain.isNotNull(), F.xxhash64(F.lit(31), plain))})
        out = out.drop("folded")
    return out


def _cells(df: DataFrame, fields: Sequence[T.StructField], which: Collection[int]) -> DataFrame:
    structs = [F.struct(F.lit(i).alias("c"), value_identity(fields[i]).alias("value")) for i in which]
    return df.select(explode_structs(structs)).where(F.col("value").isNotNull())


def _long_cells(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame | None:
    """The long values, each with its key, one row per cell."""
    which = [i for i, f in enumerate(fields) if _can_be_long(f)]
    if not which:
        return None
    v = F.col("value")
    cells = _cells(df, fields, which).where(F.octet_length(v) > SHORT)
    return cells.withColumns({"h1": F.xxhash64(v), "h2": F.xxhash64(F.lit(31), v), "check": F.crc32(v.cast("binary"))})


@dataclass
class Frequencies:
    """The frequency table of some columns of a frame.

    ``table``: ``c`` (index into ``fields``), ``value`` (null if long), ``h1``, ``h2``,
    ``check`` (null if short), ``length`` (characters), ``bytes``, ``head`` (first
    characters), ``n``, and the attributes asked for. ``rows``: rows of the frame.
    """

    source: DataFrame
    fields: list[T.StructField]
    table: DataFrame
    rows: Column

    def names(self, of: Collection[int] | None = None) -> DataFrame:
        """(c, position, column): one row per column of the table."""
        rows = [(i, i + 1, f.name) for i, f in enumerate(self.fields) if of is None or i in of]
        return self.source.sparkSession.createDataFrame(rows, "c int, position int, column string")

    def of(self, want) -> list[int]:
        """Indexes of the columns whose field satisfies ``want``."""
        return [i for i, f in enumerate(self.fields) if want(f)]

    def settled(self) -> Frequencies:
        """The same table computed once, in the shared checkpoint folder, for checks that read it together."""
        checkpoint_dir(self.source.sparkSession)
        return replace(self, table=self.table.checkpoint(eager=True), rows=F.lit(self.source.count()))

    def written(self, path: str) -> Frequencies:
        """The same table as Parquet under ``path``."""
        self.table.write.parquet(path)
        return replace(self, table=self.source.sparkSession.read.parquet(path), rows=F.lit(self.source.count()))

    def with_texts(self, rows: DataFrame, few: bool = False) -> DataFrame:
        """``rows`` of the table with their whole ``text``; ``few`` if there is a bound on them."""
        cells = _long_cells(self.source, self.fields)
        if cells is None:
            return rows.withColumn("text", F.col("value"))
        key = ["c", "h1", "h2", "check", "length"]
        wanted = rows.where(F.col("value").isNull()).select(*key)
        wanted = F.broadcast(wanted) if few else wanted
        found = cells.withColumn("length", F.length("value")).join(wanted, key, "left_semi").groupBy(*key).agg(F.first("value").alias("long_text"))
        found = F.broadcast(found) if few else found
        return rows.join(found, key, "left").withColumn("text", F.coalesce("value", "long_text")).drop("long_text")


def frequencies(df: DataFrame, fields: Sequence[T.StructField], want: Collection[str] = ()) -> Frequencies:
    """The frequency table of ``fields``, lazily, with the attributes that ``want`` names."""
    fields = list(fields)
    attributes = ["length", "bytes", "head", *(a for name, names in ATTRIBUTES.items() if name in want for a in names)]
    short = _cells(df, fields, range(len(fields))).where(F.octet_length("value") <= SHORT).groupBy("c", "value").agg(F.count(F.lit(1)).alias("n"))
    none = {"h1": F.lit(None).cast("long"), "h2": F.lit(None).cast("long"), "check": F.lit(None).cast("long")}
    table = _with_attributes(short.withColumns(none), fields, want).select("c", "value", "h1", "h2", "check", "n", *attributes)
    cells = _long_cells(df, fields)
    if cells is not None:
        known = _with_attributes(cells, fields, want).drop("value")
        rest = [a for a in attributes if a != "length"]
        counted = known.groupBy("c", "h1", "h2", "check", "length").agg(F.count(F.lit(1)).alias("n"), *(F.first(a).alias(a) for a in rest))
        table = table.unionByName(counted.withColumn("value", F.lit(None).cast("string")))
    rows = df.agg(F.count(F.lit(1)).alias("rows")).scalar()
    return Frequencies(df, fields, table, rows)
