"""Exact order statistics by rank selection over histograms.

Spark's ``percentile`` keeps a value->count map per group and merges it in one
final task, which cannot hold a continuous column of billions of values. Here each
requested rank is narrowed to the range of values that holds it, one pass over the
data per level for all columns and ranks together:

1. one wide aggregate gives each column's count, least and greatest value;
2. a level splits every range still open into ``2 ** LEVEL_BITS`` steps, counts the
   values per step (combined map-side) and keeps their least and greatest value. The
   running count inside a range, a window over its steps, tells which step holds a
   rank; that step's least and greatest value are the range of the next level;
3. a range whose least and greatest value are equal is the answer. A hot value
   settles its range in the first level, however many rows have it.

Only one row per rank and level reaches the driver. Values keep their own type all
the way: whole numbers are split by shifts of the value itself, so ``2**53 + 1`` is
told from its neighbours; decimals and floating values are split by a monotone step
function of their double value, and decimals that are one double by the values
themselves. Counts decide every step, so results do not depend on partitions,
caching or exchange reuse. A quantile interpolates linearly between the order
statistics at ``floor(h)`` and ``ceil(h)`` with ``h = p * (N - 1)``, as pandas and
Spark's ``percentile`` do. Nulls, NaN and infinities are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from fractions import Fraction
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import FLOATING_TYPES, balanced

LEVEL_BITS = 12
#: A level that leaves more than this share of a range's rows in one step is followed by steps of magnitude.
UNEVEN = 1 / 16
Value = int | float | Decimal | Fraction
_SCHEMA = "column string, prob double, value double"


def own_type(v: Column, dtype: T.DataType) -> tuple[Column, T.DataType]:
    """The expression as long, decimal or finite double."""
    if isinstance(dtype, FLOATING_TYPES):
        x = v.cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) != F.lit(math.inf)), x), T.DoubleType()
    if isinstance(dtype, T.DecimalType):
        return v, dtype
    return v.cast("long"), T.LongType()


@dataclass
class _Range:
    """Values of one column between two values that occur, and the ranks (within the column) to find there."""

    column: str
    lo: Value
    hi: Value
    below: int
    rows: int
    ranks: list[int]
    by_magnitude: bool = False
    whole: bool = False

    def splits(self, dtype: T.DataType) -> bool:
        """Whether a step function tells ``lo`` from ``hi``; if not, the values themselves are the steps."""
        if isinstance(dtype, T.LongType):
            return True
        half = float(self.hi) / 2 - float(self.lo) / 2
        return half > 0 and math.isfinite((1 << LEVEL_BITS) / half)


def _step(ranges: list[_Range], dtype: T.DataType) -> Column:
    """The step of value ``v`` inside range ``range``; a range's own numbers are looked up by its index."""

    def own(numbers: list, kind: str) -> Column:
        return F.get(F.array(*(F.lit(x).cast(kind) for x in numbers)), F.col("range"))

    if isinstance(dtype, T.LongType):
        shifts = [max(0, (r.hi - r.lo).bit_length() - LEVEL_BITS) for r in ranges]
        first = [r.lo >> n for r, n in zip(ranges, shifts, strict=True)]
        return F.call_function("shiftright", F.col("v"), own(shifts, "int")) - own(first, "long")
    x = F.col("v").cast("double")
    halves = [float(r.lo) / 2 for r in ranges]
    scales = [(1 << LEVEL_BITS) / (float(r.hi) / 2 - h) for r, h in zip(ranges, halves, strict=True)]
    even = F.floor((x / 2 - own(halves, "double")) * own(scales, "double"))
    # 32 steps per power of two; log2 of the least double is -1074.
    magnitude = F.coalesce(F.signum(x) * (F.floor(F.log2(F.abs(F.nullif(x, F.lit(0.0)))) * 32) + 40_000), F.lit(0))
    return F.when(own([r.by_magnitude for r in ranges], "boolean"), magnitude).otherwise(even).cast("long")


@dataclass
class _Search:
    """The named expressions with their types, and the ranks settled so far."""

    values: dict[str, Column]
    types: dict[str, T.DataType]
    weight: Column | None
    found: dict[tuple[str, int], Value] = field(default_factory=dict)


def _cells(df: DataFrame, search: _Search, ranges: list[_Range], dtype: T.DataType) -> DataFrame:
    """(range, v, w) of the values of one type inside the ranges."""
    by_column: dict[str, list[int]] = {}
    for k, r in enumerate(ranges):
        by_column.setdefault(r.column, []).append(k)
    weight = (F.lit(1).cast("long") if search.weight is None else search.weight).alias("w")
    if len(by_column) == len(ranges) and all(r.below == 0 and r.whole for r in ranges):
        # The first level: every value of a column is in its range.
        wide = df.select(weight, *(search.values[r.column].alias(str(k)) for k, r in enumerate(ranges)))
        long = wide.unpivot(["w"], [str(k) for k in range(len(ranges))], "range", "v")
        return long.where(F.col("v").isNotNull()).select(F.col("range").cast("int").alias("range"), "v", "w")
    wide, structs, inside = [], [], []
    for i, (column, ks) in enumerate(by_column.items()):
        wide.append(search.values[column].alias(f"v{i}"))
        which = F.lit(None).cast("int")
        for k in ks:
            held = (F.col(f"v{i}") >= F.lit(ranges[k].lo).cast(dtype)) & (F.col(f"v{i}") <= F.lit(ranges[k].hi).cast(dtype))
            inside.append(F.coalesce(held, F.lit(False)))
            which = F.when(held, F.lit(k)).otherwise(which)
        structs.append(F.struct(which.alias("range"), F.col(f"v{i}").alias("v")))
    rows = df.select(weight, *wide).where(balanced(or_, inside))  # most rows are in no range after the first level
    return rows.select("w", F.inline(F.array(*structs))).where(F.col("range").isNotNull())


def _level(df: DataFrame, search: _Search, ranges: list[_Range], dtype: T.DataType, split: bool) -> list[_Range]:
    """The narrower range around each rank; ranks that are settled go to ``search.found``."""
    cells = _cells(df, search, ranges, dtype)
    cells = cells.withColumn("step", _step(ranges, dtype) if split else F.col("v"))
    steps = cells.groupBy("range", "step").agg(F.sum("w").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    running = steps.withColumn("upto", F.sum("n").over(Window.partitionBy("range").orderBy("step")))
    wanted = df.sparkSession.createDataFrame([(k, r, r - x.below) for k, x in enumerate(ranges) for r in x.ranks], "range int, rank long, place long")
    # A few ranks per column: a broadcast of known size.
    hits = running.join(F.broadcast(wanted), "range").where((F.col("place") >= F.col("upto") - F.col("n")) & (F.col("place") < F.col("upto")))
    out: dict[tuple[int, int], _Range] = {}
    for r in hits.collect():
        old, before = ranges[r["range"]], r["upto"] - r["n"]
        if r["lo"] == r["hi"]:
            search.found[old.column, r["rank"]] = r["lo"]
            continue
        new = out.setdefault((r["range"], before), _Range(old.column, r["lo"], r["hi"], old.below + before, r["n"], []))
        new.by_magnitude = r["n"] > UNEVEN * old.rows and not old.by_magnitude
        new.ranks.append(r["rank"])
    return list(out.values())


def order_statistics(
    df: DataFrame,
    values: Mapping[str, Column],
    ranks: Callable[[int], Sequence[int]],
    facts: Mapping[str, tuple[int, Value, Value]] | None = None,
    weight: Column | None = None,
) -> tuple[dict[str, int], dict[tuple[str, int], Value]]:
    """Counts per named expression, and {(name, rank): value} for the ranks asked for (0 is the least value).

    ``ranks`` gives the ranks from a column's count. ``facts`` has (count, least,
    greatest) per name where the caller knows them already. ``weight`` says how often
    a row counts (a long).
    """
    schema = df.select(*(v.alias(f"c{i}") for i, v in enumerate(values.values()))).schema if values else []
    typed = {name: own_type(v, f.dataType) for (name, v), f in zip(values.items(), schema, strict=True)}
    search = _Search({n: v for n, (v, _) in typed.items()}, {n: t for n, (_, t) in typed.items()}, weight)
    if facts is None and values:
        counted = [F.count(v) if weight is None else F.coalesce(F.sum(F.when(v.isNotNull(), weight)), F.lit(0)) for v in search.values.values()]
        row = df.agg(*(a for i, v in enumerate(search.values.values()) for a in (counted[i].alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")))).first()
        facts = {name: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, name in enumerate(search.values)}
    facts = facts or {}
    ranges = []
    for name, (n, lo, hi) in facts.items():
        wanted = sorted({r for r in ranks(n) if 0 <= r < n}) if n else []
        search.found.update({(name, r): lo for r in wanted if lo == hi or r == 0})
        search.found.update({(name, n - 1): hi} if n - 1 in wanted else {})
        left = [r for r in wanted if (name, r) not in search.found]
        if left:
            ranges.append(_Range(name, lo, hi, 0, n, left, whole=True))
    while ranges:
        # One job per type: each reads its own columns only, and values keep their type.
        alike: dict[tuple[str, bool], list[_Range]] = {}
        for r in ranges:
            dtype = search.types[r.column]
            alike.setdefault((dtype.simpleString(), r.splits(dtype)), []).append(r)
        ranges = [new for (_, split), part in alike.items() for new in _level(df, search, part, search.types[part[0].column], split)]
    return {name: n for name, (n, _, _) in facts.items()}, search.found


def _between(lo: Value, hi: Value, share: float) -> Value:
    if lo == hi or share == 0:
        return lo
    if isinstance(lo, float) or isinstance(hi, float):
        return (1 - share) * lo + share * hi
    return Fraction(lo) + (Fraction(hi) - Fraction(lo)) * Fraction(share)


def quantile_values(
    df: DataFrame,
    values: Mapping[str, Column],
    probs: Sequence[float],
    facts: Mapping[str, tuple[int, Value, Value]] | None = None,
    weight: Column | None = None,
) -> dict[str, list[Value | None]]:
    """{column: [q for each prob]}: whole numbers and decimals exact (a ``Fraction`` where between two), None without values."""

    def ranks(n: int) -> list[int]:
        return [r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))]

    counts, found = order_statistics(df, values, ranks, facts, weight)
    out: dict[str, list[Value | None]] = {}
    for name in values:
        n = counts.get(name, 0)
        h = [p * (n - 1) for p in probs]
        out[name] = [_between(found[name, math.floor(x)], found[name, math.ceil(x)], x - math.floor(x)) if n else None for x in h]
    return out


def quantile_map(df: DataFrame, values: Mapping[str, Column], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """{column: [q for each prob]} as doubles."""
    return {c: [None if q is None else float(q) for q in qs] for c, qs in quantile_values(df, values, probs).items()}


def exact_quantiles(df: DataFrame, values: Mapping[str, Column], probs: Sequence[float]) -> DataFrame:
    """(column, prob, value): exact quantiles of each named expression; columns with no value give no rows."""
    rows = [(c, float(p), q) for c, qs in quantile_map(df, values, probs).items() for p, q in zip(probs, qs, strict=True) if q is not None]
    return df.sparkSession.createDataFrame(rows, _SCHEMA)
