"""Writers and lineage: Parquet, CSV evidence, JSON reports, file fingerprints, manifests.

Every writer takes a DataFrame and a path and never changes its input. File
listings and hashes use Spark's ``binaryFile`` source, so they run on the
executors next to the files; only one-row reports are assembled as structs.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import FLOATING_TYPES, qcol

# Files up to this size are hashed by Spark's own function; larger ones (whose content does
# not fit one JVM byte array from 2 GiB on) are read in blocks by a task.
WHOLE_FILE_BYTES = 256 << 20


def stringify_mixed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The listed columns as text (nulls stay null); other columns untouched."""
    wanted = set(columns)
    return df.select(*[qcol(c).cast("string").alias(c) if c in wanted else qcol(c) for c in df.columns])


def write_identified(df: DataFrame, path: str, mixed_columns: Sequence[str] = (), mode: str = "overwrite") -> str:
    """Write the identified table as Parquet (listed mixed columns as text)."""
    stringify_mixed(df, mixed_columns).write.mode(mode).parquet(path)
    return path


def write_evidence_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """UTF-8 CSV with a header; an empty table keeps its real header."""
    df.write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)
    return path


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in floating columns (JSON has no NaN)."""
    return df.select(
        *[
            F.when(~F.isnan(qcol(f.name)), qcol(f.name)).alias(f.name)
            if isinstance(f.dataType, FLOATING_TYPES)
            else qcol(f.name)
            for f in df.schema.fields
        ]
    )


def write_report_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """JSON lines with nulls written out, NaN as null, timestamps in ISO 8601."""
    (
        nan_to_null(df)
        .write.mode(mode)
        .option("ignoreNullFields", False)
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        .json(path)
    )
    return path


def file_listing(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """path, length, modificationTime of every file (content is pruned, not read)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format("binaryFile").load(paths).select("path", "length", "modificationTime")


def _hash_blocks(batches):
    import hashlib

    import pandas as pd
    from pyarrow import fs

    for pdf in batches:
        hashes = []
        for path in pdf["path"]:
            filesystem, inner = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
            digest = hashlib.sha256()
            with filesystem.open_input_stream(inner) as stream:
                while block := stream.read(8 << 20):
                    digest.update(block)
            hashes.append(digest.hexdigest())
        yield pd.DataFrame({"path": pdf["path"], "length": pdf["length"], "modificationTime": pdf["modificationTime"], "sha256": hashes})


def fingerprint_files(spark: SparkSession, paths: Sequence[str] | str, whole: int = WHOLE_FILE_BYTES) -> DataFrame:
    """SHA-256 of every file, of any size, computed on the executors.

    The length filters are pushed into the ``binaryFile`` scans, so a large file's
    content is never loaded whole.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").load(paths)
    facts = ["path", "length", "modificationTime"]
    small = files.where(F.col("length") <= whole).select(*facts, F.sha2(F.col("content"), 256).alias("sha256"))
    large = files.where(F.col("length") > whole).select(*facts).mapInPandas(_hash_blocks, "path string, length long, modificationTime timestamp, sha256 string")
    return small.unionByName(large)


def _plain_path(c):
    return F.regexp_replace(c, "^file:(//)?", "")


def evidence_manifest(spark: SparkSession, expected: Sequence[str]) -> DataFrame:
    """expected path, exists, bytes: each expected output with the files at it or anywhere below it."""
    parts = [spark.createDataFrame([(p, None) for p in expected], "path string, length long")]
    # Each expected output is listed on its own (a bounded number of paths), so a
    # missing one does not hide the others.
    for path in sorted(set(expected)):
        try:
            found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
        except AnalysisException as err:
            if "PATH_NOT_FOUND" not in str(err):
                raise
            continue
        parts.append(found.select(F.lit(path).alias("path"), "length"))
    listed = parts[0]
    for part in parts[1:]:
        listed = listed.unionByName(part)
    return listed.groupBy(_plain_path(F.col("path")).alias("path")).agg((F.count("length") > 0).alias("exists"), F.sum("length").alias("bytes"))


def ingestion_metadata(
    df: DataFrame,
    source_paths: Sequence[str],
    output_path: str | None,
    produced: Sequence[str] = (),
    required_member: str | None = None,
    ignored_members: Sequence[str] = (),
    stringified_columns: Sequence[str] = (),
    run_time: _dt.datetime | None = None,
    key=None,
) -> DataFrame:
    """One row: run time, versions, source fingerprint, members, dimensions, nulls, duplicates, outputs."""
    import platform

    import pyspark

    from tidemark.operators.duplicates import exact_duplicates
    from tidemark.operators.nulls import dimensions

    spark = df.sparkSession
    run_time = run_time or _dt.datetime.now(_dt.timezone.utc)
    dims = dimensions(df, key)
    dups = exact_duplicates(df, key)
    # One entry per path that the caller names: its files, their bytes, and the hash where it is a single file.
    sources = [
        fingerprint_files(spark, path).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("length"), F.max("sha256").alias("sha256")).select(
            F.struct(F.lit(path).alias("path"), "files", "length", F.when(F.col("files") == 1, F.col("sha256")).alias("sha256"))
        ).scalar()
        for path in source_paths
    ]
    out = dims.select(
        F.lit(run_time.isoformat()).alias("run_time"),
        F.lit(platform.python_version()).alias("python_version"),
        F.lit(pyspark.__version__).alias("spark_version"),
        F.array(*sources).alias("sources"),
        F.lit(required_member).cast("string").alias("member_used"),
        F.array(*[F.lit(m) for m in ignored_members]).cast("array<string>").alias("members_ignored"),
        F.col("rows"),
        F.col("columns"),
        F.col("null_cells"),
        dups.select("duplicate_rows").scalar().alias("duplicate_rows"),
        F.lit(output_path).cast("string").alias("output_path"),
        F.array(*[F.lit(c) for c in stringified_columns]).cast("array<string>").alias("stringified_columns"),
        F.array_sort(F.array(*[F.lit(p) for p in produced]).cast("array<string>")).alias("produced"),
    )
    return out


def validation_report(summary: DataFrame, completeness: DataFrame, run_time: _dt.datetime | None = None) -> DataFrame:
    """One row: run time, the (seven) summary rows, and the three row-completeness counts."""
    run_time = run_time or _dt.datetime.now(_dt.timezone.utc)
    rows = summary.agg(F.sort_array(F.collect_list(F.struct(*summary.columns))).alias("summary"))
    return completeness.select(
        F.lit(run_time.isoformat()).alias("run_time"),
        rows.select("summary").scalar().alias("summary"),
        "all_null_rows",
        "rows_with_nulls",
        "complete_rows",
    )


__all__ = [
    "evidence_manifest",
    "file_listing",
    "fingerprint_files",
    "ingestion_metadata",
    "nan_to_null",
    "stringify_mixed",
    "validation_report",
    "write_evidence_csv",
    "write_identified",
    "write_report_json",
]


def write_headed_text(df: DataFrame, path: str, title: str, delimiter: str = ",") -> str:
    """Write delimited text with a title line and a header line at the top of every part file.

    Each partition formats its own rows (``DataFrame.to_csv``) and ``write.text`` keeps
    them in order, one file per partition; nothing passes through one task or the
    driver. An empty partition still writes its title and header.
    """
    names = list(df.columns)

    def lines(batches):
        import itertools

        import pandas as pd

        for pdf in itertools.chain([pd.DataFrame(columns=names)], batches):
            head = "" if len(pdf) else title + "\n"
            text = head + pdf.to_csv(index=False, header=not len(pdf), sep=delimiter, lineterminator="\n", na_rep="")
            yield pd.DataFrame({"value": [text.rstrip("\n")]})

    as_text = df.select(*[qcol(c).cast("string").alias(c) for c in names])
    as_text.mapInPandas(lines, "value string").write.mode("overwrite").text(path)
    return path
