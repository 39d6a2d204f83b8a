"""Delimited text whose header is not on the first line (a title row comes first).

Spark's CSV reader cannot skip a number of leading records per file, and does not split
a file whose values may hold line feeds. Here files are read in byte ranges, so a large
file is read by many tasks:

1. one pass counts the quotes of every range. In well-formed text the number of quotes
   before a place tells whether it lies inside a quoted value, so a running sum per file
   (a window over its ranges) gives the state that each range begins in;
2. each range is read from the first record that starts in it to the end of the last
   one; what leads up to the data of a file (``header_row`` records and the header) is
   left out of its first range. ``pyarrow.csv`` parses the pieces.

A quote that neither begins nor ends a value would mislead the count: a file that holds
one, or whose encoding is no superset of ASCII, is read as one stream instead.

Names are taken from record ``header_row`` (records, not lines: a quoted name may hold a
line feed); every value is text (types come later, see ``tidemark.sources.infer_types``).
A record with more or fewer cells than the header, or a file with another header than
the first file's, is an error that names the file: nothing is cut off.
"""

from __future__ import annotations

import codecs
import csv
import io
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

#: Bytes of a range.
RANGE = 64 << 20
# Encodings in which quotes, delimiters and line feeds are the bytes they are in ASCII.
ASCII_LIKE = ("utf-8", "ascii", "iso8859-1", "iso8859-15", "cp1252", "cp1250")


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:") and "://" not in path:
        path = path.replace("file:", "file://", 1)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _lines(stream, encoding: str) -> Iterator[tuple[str, int]]:
    """Each line of a byte stream and the number of bytes up to its end."""
    at = 0
    for line in io.BufferedReader(stream, 1 << 16):
        at += len(line)
        yield line.decode(encoding), at


def _header(path: str, header_row: int, delimiter: str, encoding: str) -> tuple[list[str], int]:
    """The names in record ``header_row``, and where the data starts (bytes)."""
    filesystem, inner = _open(path)
    with filesystem.open_input_stream(inner) as raw:
        end = 0

        def counted() -> Iterator[str]:
            nonlocal end
            for line, end in _lines(raw, encoding):  # noqa: B020
                yield line

        for i, record in enumerate(csv.reader(counted(), delimiter=delimiter)):
            if i == header_row:
                return unique_names(record), end
    raise ValueError(f"{path} has no record {header_row} to use as header")


def unique_names(names: list[str]) -> list[str]:
    """Blank names become ``Unnamed: i``; repeats get ``.1``, ``.2`` (as spreadsheet readers do)."""
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(names):
        name = name if name.strip() else f"Unnamed: {i}"
        if name in seen:
            seen[name] += 1
            name = f"{name}.{seen[name]}"
        else:
            seen[name] = 0
        out.append(name)
    return out


def _quote_counts(names: list[str], header_row: int, delimiter: str, encoding: str):
    """Adds to each range the start of its file's data, the quotes in it, and whether one stands inside a value."""
    mark = re.escape(delimiter.encode())
    stray = re.compile(rb'[^%b\r\n"]"[^%b\r\n"]' % (mark, mark))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                found, start = _header(r.path, header_row, delimiter, encoding)
                if found != names:
                    raise ValueError(f"{r.path} has the columns {found}, not {names}")
                filesystem, inner = _open(r.path)
                a, b = max(r.at, start), min(r.at + r.span, r.length)
                with filesystem.open_input_file(inner) as f:
                    # A byte on either side, so that quotes at the edges have their neighbours.
                    near = f.read_at(max(0, b + 1 - max(start, a - 1)), max(start, a - 1)) if b > a else b""
                inside = near[1 if a > start else 0 :][: max(0, b - a)]
                rows.append((r.path, r.length, r.at, r.span, start, inside.count(b'"'), stray.search(near) is not None))
            yield pd.DataFrame(rows, columns=["path", "length", "at", "span", "start", "quotes", "stray"])

    return run


def _record_start(f, at: int, start: int, length: int, inside: bool) -> int:
    """First place from ``at`` on where a record starts; ``inside``: whether ``at`` lies in a quoted value."""
    if at <= start:
        return start
    if at >= length:
        return length
    if not inside and f.read_at(1, at - 1) == b"\n":
        return at
    while at < length:
        block = f.read_at(1 << 16, at)
        for k, byte in enumerate(block):
            if byte == 0x22:
                inside = not inside
            elif byte == 0x0A and not inside:
                return at + k + 1
        at += len(block)
    return length


def _read_ranges(names: list[str], delimiter: str, encoding: str):
    from pyarrow import csv as pacsv

    def parsed(source, path: str) -> Iterator[pa.RecordBatch]:
        try:
            yield from pacsv.open_csv(
                source,
                read_options=pacsv.ReadOptions(column_names=names, encoding=encoding, block_size=8 << 20),
                parse_options=pacsv.ParseOptions(delimiter=delimiter, newlines_in_values=True),
                convert_options=pacsv.ConvertOptions(column_types={n: pa.string() for n in names}, null_values=[""], strings_can_be_null=True, quoted_strings_can_be_null=True),
            )
        except pa.ArrowInvalid as err:
            if "Empty CSV" not in str(err):  # blank lines alone
                raise ValueError(f"{path}: {err}") from None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                filesystem, inner = _open(r["path"])
                if r["whole"]:
                    with filesystem.open_input_stream(inner) as raw:
                        left = r["start"]
                        while left:
                            left -= len(raw.read(min(left, 1 << 20)))
                        if r["start"] < r["length"]:
                            yield from parsed(raw, r["path"])
                    continue
                with filesystem.open_input_file(inner) as f:
                    a = _record_start(f, r["at"], r["start"], r["length"], r["before"] % 2 == 1)
                    b = _record_start(f, r["at"] + r["span"], r["start"], r["length"], (r["before"] + r["quotes"]) % 2 == 1)
                    piece = f.read_at(b - a, a) if a < b else b""
                if piece:
                    yield from parsed(pa.BufferReader(piece), r["path"])

    return run


def read_headed_table(
    spark: SparkSession, path: str, header_row: int = 1, delimiter: str = ",", encoding: str = "utf-8", span: int = RANGE
) -> DataFrame:
    """Read delimited text, skipping ``header_row`` leading records per file; all columns text.

    Files are listed, and their quotes counted, when this is called; the ranges (one
    row each) are kept in the shared checkpoint folder.
    """
    from tidemark.session import checkpoint_dir, ship_package
    from tidemark.sinks import file_listing

    ship_package(spark)
    files = file_listing(spark, path).select("path", "length")
    first = files.orderBy("path").first()
    if first is None:
        raise FileNotFoundError(f"No files at {path}")
    names, _ = _header(first["path"], header_row, delimiter, encoding)
    last = F.greatest(F.col("length") - 1, F.lit(0).cast("long"))
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(span).cast("long"))).alias("at"), F.lit(span).cast("long").alias("span"))
    tasks = max(1, ranges.count())
    schema = "path string, length long, at long, span long, start long, quotes long, stray boolean"
    counted = ranges.repartition(tasks, "path", "at").mapInPandas(_quote_counts(names, header_row, delimiter, encoding), schema)
    of_file = Window.partitionBy("path")
    before = F.coalesce(F.sum("quotes").over(of_file.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    split = codecs.lookup(encoding).name in ASCII_LIKE
    whole = F.max("stray").over(of_file) if split else F.lit(True)
    placed = counted.select("*", before.alias("before"), whole.alias("whole")).where(~F.col("whole") | (F.col("at") == 0))
    checkpoint_dir(spark)
    placed = placed.checkpoint(eager=True)
    columns = StructType([StructField(n, StringType(), True) for n in names])
    return placed.repartition(tasks, "path", "at").mapInArrow(_read_ranges(names, delimiter, encoding), columns)
