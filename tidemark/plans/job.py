"""The profile job: all evidence tables of one table from two shared intermediates.

The table is read twice. The first pass writes the hashed frequency table of every
column (``operators.frequencies``); everything that is said of a column comes from it:
nulls, distinct values, types, text, categories, numeric statistics, date conversion,
sizes. The second pass knows the outlier limits and date columns from there and writes
one thin row per row of the table: key, fingerprint, number of missing cells, type
classes of its texts, converted dates, outliers, dates that cannot be read. Everything
that is said of rows comes from that. Beyond the two passes only single rows and long
texts that a result shows are fetched.

Both intermediates lie in the output folder, so a lost executor recomputes from files.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark import operators as O
from tidemark.functions.columns import as_key_list, as_text, is_string, missing_count_per_row, pct, profiled_fields, qcol
from tidemark.functions.terms import EARLIEST_DATE, EXAMPLE_LIMIT
from tidemark.operators.dates import converted, date_profile, unconverted
from tidemark.operators.duplicates import canonical
from tidemark.operators.frequencies import ATTRIBUTES, Frequencies, frequencies, groupable, text_class
from tidemark.operators.numeric import numeric_stats_from, outlier_cells
from tidemark.operators.schema import SAMPLE
from tidemark.operators.summary import check_totals, column_checks, summarise

#: Hashes of a row's fingerprint.
SEEDS = (17, 31, 59)


@dataclass
class Rows:
    """The row facts: ``k0``, ``k1``, ... (the key), ``fp``, ``missing``, ``classes``, ``dates``, ``outliers``, ``failures``."""

    table: DataFrame
    keys: list[str]
    texts: list[T.StructField]
    dates: list[str]

    def key_columns(self) -> list[Column]:
        return [F.col(f"k{i}").alias(k) for i, k in enumerate(self.keys)]


def _fingerprint(fields: Sequence[T.StructField]) -> Column:
    values = [c for f in fields for c in (canonical(f), qcol(f.name).isNull())]
    return F.struct(*(F.xxhash64(F.lit(seed), *values).alias(f"h{i}") for i, seed in enumerate(SEEDS)))


def _row_facts(df: DataFrame, key, stats, dates: Sequence[str]) -> Rows:
    keys, fields = as_key_list(key), profiled_fields(df, key)
    texts = [f for f in fields if is_string(f)]
    by_name = {f.name: f for f in fields}
    none = F.array()
    outliers = F.filter(F.array(*outlier_cells(stats)), lambda x: x["_hit"]) if stats else none.cast("array<struct<column:string,_hit:boolean,value:double,lower_limit:double,upper_limit:double>>")
    failures = F.array(*(F.when(unconverted(by_name[c]), F.struct(F.lit(c).alias("column"), as_text(by_name[c]).alias("original_value"))) for c in dates)) if dates else none.cast("array<struct<column:string,original_value:string>>")
    table = df.select(
        *(qcol(k).alias(f"k{i}") for i, k in enumerate(keys)),
        _fingerprint([f for f in fields if groupable(f)]).alias("fp"),
        missing_count_per_row(fields).alias("missing"),
        (F.array(*(F.when(qcol(f.name).isNotNull(), text_class(qcol(f.name))) for f in texts)) if texts else none.cast("array<string>")).alias("classes"),
        (F.array(*(converted(by_name[c]) for c in dates)) if dates else none.cast("array<timestamp_ntz>")).alias("dates"),
        outliers.alias("outliers"),
        F.array_compact(failures).alias("failures"),
    )
    return Rows(table, keys, texts, list(dates))


def _missing(freq: Frequencies, fields: Sequence[T.StructField], rows: int) -> dict[str, int]:
    """Missing cells per column (a number per column, collected)."""
    informed = {r["column"]: r["n"] for r in freq.table.groupBy("c").agg(F.sum("n").alias("n")).join(F.broadcast(freq.names()), "c").collect()}
    return {f.name: rows - informed.get(f.name, 0) for f in fields}


def _null_tables(spark, missing: Mapping[str, int], rows: int) -> dict[str, DataFrame]:
    columns, cells = len(missing), rows * len(missing)
    nulls = sum(missing.values())
    share = lambda n, of: n / of * 100.0 if of else 0.0
    by_column = [(i, c, n, share(n, rows), rows - n, share(rows - n, rows)) for i, (c, n) in enumerate(missing.items(), 1)]
    ranked = sorted(by_column, key=lambda r: (-r[3], r[0]))
    return {
        "dimensions": spark.createDataFrame([(rows, columns, cells, cells - nulls, nulls, share(cells - nulls, cells))], "rows long, columns int, total_cells long, informed_cells long, null_cells long, completeness_pct double"),
        "nulls": spark.createDataFrame(by_column, "position int, column string, nulls long, nulls_pct double, non_nulls long, completeness_pct double"),
        "missing_ranking": spark.createDataFrame([(i, r[1], r[3]) for i, r in enumerate(ranked, 1)], "rank int, column string, nulls_pct double"),
    }


def _row_tables(facts: Rows, columns: int, rows: int) -> dict[str, DataFrame]:
    k = F.col("missing")
    counted = facts.table.groupBy(k.alias("nulls_in_row")).agg(F.count(F.lit(1)).alias("rows"))
    return {
        "nulls_per_row": counted.select("nulls_in_row", "rows", pct(F.col("rows"), F.lit(rows).cast("long")).alias("rows_pct")),
        "row_completeness": facts.table.agg(F.count_if(k == columns).alias("all_null_rows"), F.count_if(k > 0).alias("rows_with_nulls"), F.count_if(k == 0).alias("complete_rows")),
    }


def _duplicate_tables(df: DataFrame, key, facts: Rows, rows: int) -> dict[str, DataFrame]:
    # A row's fingerprint has 192 bits, so rows that share one are alike.
    groups = facts.table.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    zero = F.lit(0).cast("long")
    summary = groups.agg(F.coalesce(F.sum("n"), zero).alias("duplicate_rows"), F.count(F.lit(1)).alias("duplicate_groups"), F.coalesce(F.max("n"), zero).alias("largest_group"))
    out = {"duplicate_summary": summary.select("duplicate_rows", pct(F.col("duplicate_rows"), F.lit(rows).cast("long")).alias("duplicate_rows_pct"), "duplicate_groups", "largest_group")}
    if not facts.keys:
        return out | {"duplicate_examples": O.duplicate_examples(df)}
    members = facts.table.join(groups, "fp", "left_semi").select(*facts.key_columns())
    fields = [qcol(f.name) for f in profiled_fields(df, key)]
    order = [qcol(k) for k in facts.keys]
    first = F.broadcast(members.orderBy(*order).limit(EXAMPLE_LIMIT).distinct().toDF(*(f"_k{i}" for i in range(len(facts.keys)))))
    whole = df.join(first, [qcol(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(facts.keys)], "left_semi")
    return out | {"duplicate_row_keys": members, "duplicate_examples": whole.select(*order, *fields).orderBy(*order, *fields).limit(EXAMPLE_LIMIT)}


def _first_classes(freq: Frequencies, facts: Rows) -> DataFrame | None:
    """(column, class) of the first values per text column, by key; without a key, by value."""
    parts = []
    for i, f in enumerate(facts.texts):
        if facts.keys:
            found = facts.table.select(*facts.key_columns(), F.get("classes", F.lit(i)).alias("class")).where(F.col("class").isNotNull())
            first = found.orderBy(*(qcol(k) for k in facts.keys), "class").limit(SAMPLE)
        else:
            place = freq.of(lambda g, name=f.name: g.name == name)
            least = freq.table.where(F.col("c").isin(place)).orderBy("head", "value", "h1").limit(SAMPLE)
            before = F.coalesce(F.sum("n").over(Window.orderBy("head", "value", "h1").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            first = least.select("class", before.alias("before")).where(F.col("before") < SAMPLE)
        parts.append(first.select(F.lit(f.name).alias("column"), "class"))
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def _evidence_of_rows(df: DataFrame, facts: Rows) -> dict[str, DataFrame]:
    keys = facts.key_columns()
    names = [qcol(k) for k in facts.keys]
    outliers = facts.table.select(*keys, F.inline("outliers")).select("column", *names, "value", "lower_limit", "upper_limit")
    failing = facts.table.where(F.size("failures") > 0).select(*keys, F.inline("failures"))
    ranked = failing.withColumn("_rn", F.row_number().over(Window.partitionBy("column").orderBy(*names, "original_value")))
    failures = ranked.where(F.col("_rn") <= EXAMPLE_LIMIT).select("column", *names, "original_value")
    dated = facts.table.select(*keys, *(F.get("dates", F.lit(i)).alias(c) for i, c in enumerate(facts.dates)))
    kw = {"key": facts.keys or None, "candidates": facts.dates}
    return {
        "numeric_outliers": outliers,
        "date_failures": failures,
        "temporal_summary": O.temporal_consistency(dated, **kw),
        "temporal_inconsistencies": O.temporal_inconsistencies(dated, **kw),
    }


def profile_job(
    df: DataFrame,
    folder: str,
    key: str | Sequence[str] | None = None,
    earliest: str = EARLIEST_DATE,
    as_of: _dt.datetime | None = None,
    mapping: Mapping[str, str] | None = None,
    source_paths: Sequence[str] | None = None,
    output_paths: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Every evidence table of ``df``; the intermediates are written under ``folder``."""
    spark = df.sparkSession
    fields = profiled_fields(df, key)
    kw = {"earliest": earliest, "as_of": as_of}
    freq = frequencies(df, [f for f in fields if groupable(f)], set(ATTRIBUTES)).written(f"{folder}/frequencies")
    stats = numeric_stats_from(freq)
    dated = date_profile(df, key, freq=freq, **kw)
    candidates = sorted(dated.select("position", "column", "failed").collect())  # a row per candidate column
    facts = _row_facts(df, key, stats, [r["column"] for r in candidates])
    facts.table.write.parquet(f"{folder}/rows")
    facts.table = spark.read.parquet(f"{folder}/rows")
    rows = facts.table.count()
    missing = _missing(freq, fields, rows)
    empty = O.empty_constant_columns(df, key, freq=freq)
    tables = {
        **_null_tables(spark, missing, rows),
        **_row_tables(facts, len(fields), rows),
        **_duplicate_tables(df, key, facts, rows),
        "columns": O.column_inventory(df, key, mapping=mapping, freq=freq),
        "data_types": O.type_profile(df, key, freq=freq, first=_first_classes(freq, facts)),
        "identifiers": O.identifier_candidates(df, key, freq=freq),
        "empty_constants": empty,
        "flagged_columns": O.flagged_columns(empty),
        "text_problems": O.text_problems(df, key, freq=freq),
        "textual_nulls": O.textual_nulls(df, key, freq=freq),
        "category_summary": O.category_summary(df, key, freq=freq),
        "category_frequencies": O.category_frequencies(df, key, freq=freq),
        "category_variants": O.category_variants(df, key, freq=freq),
        "category_equivalences": O.equivalent_categories(df, key, freq=freq),
        "numeric_summary": O.numeric_summary(df, key, stats=stats),
        "date_candidates": O.date_candidates(df, key, freq=freq, **kw),
        "date_results": O.date_conversion(df, key, freq=freq, **kw),
        **_evidence_of_rows(df, facts),
        "classification": O.classify_variables(df, key),
        "memory": O.storage_footprint(df, key, source_paths, output_paths, freq=freq),
    }
    ids, constant, text = column_checks(df, key, freq)
    known = [spark.range(1).select(F.lit(n).cast("long").alias("affected")) for n in (sum(missing.values()), sum(r["failed"] for r in candidates))]
    temporal = tables["temporal_inconsistencies"].agg(F.count(F.lit(1)).alias("affected"))
    duplicates = tables["duplicate_summary"].select(F.col("duplicate_rows").alias("affected"))
    summary = summarise([known[0], duplicates, ids, constant, text, known[1], temporal], check_totals(rows, len(fields)))
    return tables | {"validation_summary": summary, "status_counts": O.status_counts(summary), "pending_validations": O.pending_validations(summary)}


def as_findings(tables: Mapping[str, DataFrame], key: str | Sequence[str] | None = None) -> DataFrame:
    """All evidence tables as one: table, item, metric, number, text. An item is what a row is about: its text columns and key."""
    parts = []
    keys = as_key_list(key)
    for name, table in tables.items():
        fields = table.schema.fields
        about = [f for f in fields if is_string(f) or f.name in keys]
        item = F.concat_ws("|", *(F.concat(F.lit(f"{f.name}="), qcol(f.name).cast("string")) for f in about)) if about else F.lit("")
        values = [f for f in fields if f not in about]
        stamped = [isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) for f in values]
        cells = [
            F.struct(F.lit(f.name).alias("metric"), (F.lit(None) if t else qcol(f.name)).cast("double").alias("number"), (F.date_format(qcol(f.name), "yyyy-MM-dd HH:mm:ss") if t else F.lit(None).cast("string")).alias("text"))
            for f, t in zip(values, stamped, strict=True)
        ] or [F.struct(F.lit("row").alias("metric"), F.lit(1.0).alias("number"), F.lit(None).cast("string").alias("text"))]
        parts.append(table.select(F.lit(name).alias("table"), item.alias("item"), F.inline(F.array(*cells))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
