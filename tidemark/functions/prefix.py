"""Distributed running totals (prefix sums) over a global order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def running_totals(table: DataFrame, order: str, cols: list[str], descending: bool = False, ranges: int = RANGES) -> DataFrame:
    """Add ``{c}_before`` = sum of ``c`` over all rows strictly before each row in the order of column ``order``.

    Rows are put in ranges by literal cut points, so a row's range follows from its
    value alone and every use of the table agrees on it. Offsets come from a window
    over the ranges' totals (``ranges`` rows), the rest from a window inside each
    range. ``order`` is numeric, null-free and distinct.
    """
    cuts = table.agg(F.percentile_approx(order, F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), 4 * ranges)).first()[0] or []
    cuts = sorted(set(cuts))
    if cuts:
        literal = F.array(*[F.lit(c) for c in cuts])
        place = F.size(F.filter(literal, lambda c: c <= F.col(order)))
    else:
        place = F.lit(0)
    ranged = table.withColumn("_r", -place if descending else place)
    totals = ranged.groupBy("_r").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    upto = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_r", *[F.coalesce(F.sum(f"_t_{c}").over(upto), F.lit(0)).alias(f"_o_{c}") for c in cols])
    by = F.col(order).desc() if descending else F.col(order)
    inside = Window.partitionBy("_r").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    # ``offsets`` has one row per range: a broadcast of proven size.
    joined = ranged.join(F.broadcast(offsets), "_r")
    return joined.select(
        *table.columns,
        *[(F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_before") for c in cols],
    )
