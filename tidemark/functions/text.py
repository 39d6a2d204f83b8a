"""Text folding.

ASCII text is folded by JVM functions. Spark has no NFKD normalisation, so other text
is folded in one ``arrow_udf``, value by value, so that a Python worker holds one batch's
texts as Arrow and only ``PIECE`` bytes of them as Python strings; ASCII text is not sent there. Checks of
whole columns apply it to *distinct* values (``operators.frequencies``), so the Python
cost grows with the number of distinct texts, not with rows.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.terms import EMPTY_COLUMN_NAME


@lru_cache(maxsize=1)
def _combining_marks() -> dict[int, None]:
    """Translation table that deletes every code point with a non-zero combining class."""
    return {cp: None for cp in range(sys.maxunicode + 1) if unicodedata.combining(chr(cp))}


def fold_series(values: pd.Series) -> pd.Series:
    """Compatibility-decompose, drop combining marks, lower-case, trim, collapse whitespace."""
    out = values.str.normalize("NFKD").str.translate(_combining_marks())
    return out.str.lower().str.strip().str.replace(r"\s+", " ", regex=True)


def fold_value(value: object) -> str:
    """Driver-side fold of one value (used on column names, never on data)."""
    return fold_series(pd.Series([str(value)], dtype=object)).iloc[0]


#: Bytes of folded texts that are gathered as Python strings.
PIECE = 1 << 20
_SPACES = re.compile(r"\s+")


def _fold(text: str) -> str:
    """One text, as ``fold_series``."""
    return _SPACES.sub(" ", unicodedata.normalize("NFKD", text).translate(_combining_marks()).lower().strip())


def fold_array(values: pa.Array) -> pa.Array:
    """``fold_series`` of Arrow strings, a piece at a time."""
    done, piece, size = [pa.array([], values.type)], [], 0
    for v in values:
        text = v.as_py()
        piece.append(None if text is None else _fold(text))
        size += len(piece[-1] or "")
        if size >= PIECE:
            done.append(pa.array(piece, values.type))
            piece, size = [], 0
    return pa.concat_arrays([*done, pa.array(piece, values.type)])


@F.arrow_udf(T.StringType())
def _fold_udf(values: pa.Array) -> pa.Array:
    return fold_array(values)


# The ASCII characters that count as white space in folding.
ASCII_SPACE = "[\\x09-\\x0D\\x1C-\\x20]+"


def fold_text(col: Column) -> Column:
    """Folded text of a string column (null stays null)."""
    from tidemark.session import ship_package

    ship_package()
    ascii_only = F.octet_length(col) == F.length(col)
    native = F.btrim(F.regexp_replace(F.lower(col), ASCII_SPACE, " "))
    return F.when(ascii_only, native).otherwise(_fold_udf(F.when(~ascii_only, col)))


def strip_ascii_punctuation(col: Column) -> Column:
    # Java's \p{Punct} without UNICODE_CHARACTER_CLASS is the 32 ASCII punctuation marks.
    return F.regexp_replace(col, "\\p{Punct}", "")


def category_key(col: Column) -> Column:
    """Comparable key for category variants: fold, then drop ASCII punctuation."""
    return strip_ascii_punctuation(fold_text(col))


_ASCII_RUN = re.compile("[a-z0-9]+")


def normalize_name(name: object) -> str:
    """ASCII snake-case column name: the folded name's runs of letters and digits, joined by ``_``."""
    return "_".join(_ASCII_RUN.findall(fold_value(name))) or EMPTY_COLUMN_NAME


def name_tokens(name: str) -> set[str]:
    """Whole-word tokens of a folded column name, underscores read as spaces."""
    return set(fold_value(name).replace("_", " ").split())
