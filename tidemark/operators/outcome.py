"""Tier 2: dictionary, cleaning, exploration and the length-of-stay target.

The profiled study only declares these stages (inputs, outputs and acceptance
criteria); the rules below are this repo's own choices, kept traceable: every
cleaning rule is named and reported with its before/after counts, and
exploration suppresses groups smaller than ``k_min``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import as_key_list, balanced, is_string, profiled_fields, qcol, type_name
from tidemark.functions.dates import hours_between, to_timestamp_lenient
from tidemark.functions.terms import TEXT_NULL_TOKENS, WS
from tidemark.functions.text import fold_text
from tidemark.operators.disclosure import K_MIN, small_groups
from tidemark.operators.nulls import nulls_by_column
from tidemark.operators.schema import classify_variables

Key = str | Sequence[str] | None

# --- fixed values: the configured prolonged-stay threshold in hours
PROLONGED_STAY_HOURS = 12.0


def length_of_stay(
    df: DataFrame,
    start: str,
    end: str,
    threshold: float = PROLONGED_STAY_HOURS,
    inclusive: bool = True,
    hours_col: str = "stay_hours",
    flag_col: str = "prolonged_stay",
) -> DataFrame:
    """Add hours from ``start`` to ``end`` and the prolonged-stay flag (``>=`` threshold unless ``inclusive=False``)."""
    fields = {f.name: f for f in df.schema.fields}
    a = to_timestamp_lenient(qcol(start), fields[start].dataType)
    b = to_timestamp_lenient(qcol(end), fields[end].dataType)
    hours = hours_between(a, b)
    flag = (hours >= F.lit(threshold)) if inclusive else (hours > F.lit(threshold))
    return df.withColumns({hours_col: hours, flag_col: flag})


def data_dictionary(
    df: DataFrame,
    key: Key = None,
    descriptions: Mapping[str, str] | None = None,
    units: Mapping[str, str] | None = None,
    availability: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per variable: name, type, description, unit, availability, group, informed rows and share, missing fields.

    Metadata as given (column comments in the schema serve as descriptions when none
    is) beside what the table says of its availability; no individual value is shown.
    """
    descriptions, units, availability = dict(descriptions or {}), dict(units or {}), dict(availability or {})
    groups = {r["column"]: r["proposed_group"] for r in classify_variables(df, key).collect()}
    rows = []
    for i, f in enumerate(profiled_fields(df, key)):
        desc = descriptions.get(f.name) or f.metadata.get("comment")
        unit, avail = units.get(f.name), availability.get(f.name)
        missing = [n for n, v in (("description", desc), ("unit", unit), ("availability", avail)) if not v]
        rows.append((i + 1, f.name, type_name(f), desc, unit, avail, groups.get(f.name), missing))
    known = df.sparkSession.createDataFrame(
        rows,
        "position int, variable string, data_type string, description string, unit string, "
        "availability string, proposed_group string, missing_fields array<string>",
    )
    if not rows:
        return known.select("*", F.lit(0).cast("long").alias("informed"), F.lit(0.0).alias("informed_pct"))
    informed = nulls_by_column(df, key).select(F.col("column").alias("variable"), F.col("non_nulls").alias("informed"), F.col("completeness_pct").alias("informed_pct"))
    # One row per variable on both sides.
    return known.join(F.broadcast(informed), "variable").select(*known.columns, "informed", "informed_pct")


def _trim_text(c):
    return F.regexp_replace(F.regexp_replace(c, f"^{WS}+|{WS}+\\z", ""), f"{WS}+", " ")


def clean(df: DataFrame, key: Key = None, tokens: Sequence[str] = TEXT_NULL_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Apply the named cleaning rules; returns (cleaned frame, report).

    Rules, in order: ``trim_text`` (ASCII whitespace trimmed, inner runs to one
    space), ``textual_nulls`` (values that fold to a missing-value token become
    null), ``exact_duplicates`` (one row kept per duplicate group, the one with
    the smallest key; a grouping, so hot groups are combined map-side).
    The report has rule order, rule, rows_before, rows_after, cells_changed.
    """
    keys = as_key_list(key)
    cols = [f.name for f in profiled_fields(df, key)]
    texts = [f.name for f in profiled_fields(df, key) if is_string(f)]
    is_token = {c: F.upper(fold_text(_trim_text(qcol(c)))).isin(list(tokens)) for c in texts}
    cleaned = df.withColumns({c: F.when(is_token[c], F.lit(None)).otherwise(_trim_text(qcol(c))) for c in texts})
    if keys:
        first = F.min(F.struct(*[qcol(k) for k in keys])).alias("_k")
        deduped = cleaned.groupBy(*[qcol(c) for c in cols]).agg(first).select(
            *[F.col("_k")[k].alias(k) for k in keys], *[qcol(c) for c in cols]
        )
    else:
        deduped = cleaned.dropDuplicates()
    zero = F.lit(0).cast("long")
    trim_cells = balanced(add, [(~_trim_text(qcol(c)).eqNullSafe(qcol(c))).cast("long") for c in texts], zero)
    null_cells = balanced(add, [F.coalesce(is_token[c], F.lit(False)).cast("long") for c in texts], zero)
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(trim_cells), zero).alias("trim"),
        F.coalesce(F.sum(null_cells), zero).alias("nulls"),
    )
    after = deduped.select(F.count(F.lit(1))).scalar()
    rows = F.col("rows")
    report = counts.select(
        F.inline(
            F.array(
                F.struct(
                    F.lit(1).alias("order"),
                    F.lit("trim_text").alias("rule"),
                    rows.alias("rows_before"),
                    rows.alias("rows_after"),
                    F.col("trim").alias("cells_changed"),
                ),
                F.struct(
                    F.lit(2).alias("order"),
                    F.lit("textual_nulls").alias("rule"),
                    rows.alias("rows_before"),
                    rows.alias("rows_after"),
                    F.col("nulls").alias("cells_changed"),
                ),
                F.struct(
                    F.lit(3).alias("order"),
                    F.lit("exact_duplicates").alias("rule"),
                    rows.alias("rows_before"),
                    after.alias("rows_after"),
                    zero.alias("cells_changed"),
                ),
            )
        )
    )
    return deduped, report


def clean_to(
    df: DataFrame,
    path: str,
    key: Key,
    intervals: Sequence[tuple[str, str]] = (),
    extremes: Mapping[str, tuple[float, float]] | None = None,
    tokens: Sequence[str] = TEXT_NULL_TOKENS,
) -> tuple[DataFrame, DataFrame]:
    """Write the cleaned table under ``path``; returns (the written table, report).

    Rules, in order, each applied to what the one before left:

    * ``trim_text`` and ``textual_nulls`` as in ``clean``;
    * ``incoherent_interval``: of each (start, end) pair of columns whose end is before its
      start, both are set to null (neither can be trusted more than the other);
    * ``extreme_value``: values outside the given limits of a column are set to null;
    * ``exact_duplicates``: one row per group of alike rows, the one with the least key.

    The report (order, rule, rows_before, rows_after, cells_changed) comes from numbers
    written beside the rows, so no rule is applied a second time to be counted. (Not
    from ``Observation``: once a session has one, MLlib's logistic models cannot be
    sent to tasks any more in Spark 4.1.)
    """
    keys = as_key_list(key)
    if not keys:
        raise ValueError("clean_to needs a row key")
    fields = {f.name: f for f in profiled_fields(df, key)}
    texts = [c for c, f in fields.items() if is_string(f)]
    zero = F.lit(0).cast("long")

    def changes(before: Sequence[str], after: Mapping[str, Column]) -> Column:
        return balanced(add, [(~after[c].eqNullSafe(qcol(c))).cast("long") for c in before], zero)

    steps: list[tuple[str, dict[str, Column]]] = [("trim_text", {c: _trim_text(qcol(c)) for c in texts})]
    steps.append(("textual_nulls", {c: F.when(F.upper(fold_text(qcol(c))).isin(list(tokens)), F.lit(None)).otherwise(qcol(c)) for c in texts}))
    for start, end in intervals:
        a, b = (to_timestamp_lenient(qcol(c), fields[c].dataType) for c in (start, end))
        steps.append(("incoherent_interval", {c: F.when(b < a, F.lit(None)).otherwise(qcol(c)) for c in (start, end)}))
    for c, (lo, hi) in (extremes or {}).items():
        x = qcol(c).cast("double")
        steps.append(("extreme_value", {c: F.when((x < lo) | (x > hi), F.lit(None)).otherwise(qcol(c))}))
    now = df
    for i, (_, after) in enumerate(steps):
        counted = now.withColumn(f"_n{i}", changes(list(after), after))
        now = counted.withColumns(dict(after))
    marks = [f"_n{i}" for i in range(len(steps))]
    now.write.parquet(f"{path}/rules")
    rules = df.sparkSession.read.parquet(f"{path}/rules")
    first = F.min(F.struct(*[qcol(k) for k in keys])).alias("_k")
    deduped = rules.groupBy(*[qcol(c) for c in fields]).agg(first).select(*[F.col("_k")[k].alias(k) for k in keys], *[qcol(c) for c in fields])
    deduped.select(*df.columns).write.parquet(f"{path}/cleaned")
    cleaned = df.sparkSession.read.parquet(f"{path}/cleaned")
    # Numbers that were written beside the rows: a scan of those columns alone, and of a file footer.
    counts = rules.agg(F.count(F.lit(1)).alias("rows"), *(F.coalesce(F.sum(m), zero).alias(m) for m in marks)).first()
    rows, after_rows = counts["rows"], cleaned.count()
    changed: dict[str, int] = {}
    for i, (rule, _) in enumerate(steps):
        changed[rule] = changed.get(rule, 0) + counts[marks[i]]
    report = [(i, rule, rows, rows, n) for i, (rule, n) in enumerate(changed.items(), 1)]
    report.append((len(report) + 1, "exact_duplicates", rows, after_rows, 0))
    table = df.sparkSession.createDataFrame(report, "order int, rule string, rows_before long, rows_after long, cells_changed long")
    return cleaned, table


def explore(
    df: DataFrame,
    groups: Sequence[str],
    measures: Sequence[str],
    k_min: int = K_MIN,
) -> DataFrame:
    """Aggregates per group with defined denominators; groups under ``k_min`` rows are suppressed.

    Returns group columns, rows, share_pct (of all rows), and mean / stddev per measure
    (no least or greatest value: those are single rows). Suppressed groups are folded
    into one row with null group values and ``suppressed = true`` so totals still add
    up; if it would be under ``k_min`` itself, the smallest shown group is folded too,
    and if there is none, the row is left out.
    """
    total = df.select(F.count(F.lit(1))).scalar()
    aggs = [F.count(F.lit(1)).alias("rows")]
    for m in measures:
        x = qcol(m).cast("double")
        aggs += [F.avg(x).alias(f"{m}_mean"), F.stddev_samp(x).alias(f"{m}_stddev")]
    marked = small_groups(df.groupBy(*[qcol(c) for c in groups]).agg(*aggs), list(groups), k_min=k_min)
    shown = marked.where(~F.col("small")).drop("small").withColumn("suppressed", F.lit(False))
    small = marked.where("small").agg(F.sum("rows").cast("long").alias("rows"))
    folded = small.where(F.col("rows") >= k_min).select(
        *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in groups],
        "rows",
        *[F.lit(None).cast("double").alias(f"{m}_{s}") for m in measures for s in ("mean", "stddev")],
        F.lit(True).alias("suppressed"),
    )
    both = shown.unionByName(folded)
    return both.withColumn("share_pct", F.coalesce(F.try_divide(F.col("rows"), total) * 100.0, F.lit(0.0)))


def correlations(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of measures (one aggregate)."""
    pairs = [(a, b) for i, a in enumerate(measures) for b in measures[i + 1 :]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "left string, right string, corr double")
    agg = df.agg(*[F.corr(qcol(a).cast("double"), qcol(b).cast("double")).alias(f"_c{i}") for i, (a, b) in enumerate(pairs)])
    return agg.select(
        F.inline(
            F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"_c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
        )
    )

