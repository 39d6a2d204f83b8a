"""Filter interaction audit: what each filter removes under every order of the filters.

1. ``failures``: per document row, a mask with bit ``k`` set if filter ``k`` fails it.
   The row-wise filters read the text in the tasks; the last one, "identical to the
   text of a smaller id", comes from the least id per text digest.
2. ``cells``: documents counted per part and mask (at most 32 masks a part).
3. ``interactions``: in lexicographic order, the permutations with a common prefix are
   neighbours. A document is removed by the first filter of an order that it fails, so
   for one mask the orders that remove it at a given step are a few intervals of
   ranks, found from the Lehmer digits of the prefixes (``removal_intervals``). Each
   cell adds its counts at the starts of its mask's intervals and takes them off at
   the ends; a prefix sum over the ranks gives the documents removed for every order
   and step, without going through the orders of each mask.

A text that a third of all rows share is one row per task and combination of part
and labels before it meets its other copies; a part's group has 32 cells, then one
row per order and step.

Results for odd input: a null text is empty, a null part is the empty string; of
documents that share the smallest id of a text none is its copy; rows without an id
are copies of any row that has one, and not of each other; labels without an id or
for other ids do not count; several labels of an id count as one that says 1 if any
does; an empty table gives no rows; columns beside those named are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import durable, with_python

FILTERS = "ABCDE"
FEWEST_WORDS = 200
#: Counts that the audit follows through the orders.
COUNTS = ("n", "good", "toxic")

_UPPER = bytes(range(65, 91))
_INNER = bytes(range(0x80, 0xC0))  # all bytes of a character but its first
_SYMBOL = re.compile(rb"[#$%&*|]")


def text_mask(text: bytes) -> int:
    """Filters A to D on a UTF-8 text: bit k is set if the k-th fails it."""
    words = text.split()
    points = len(text.translate(None, _INNER))
    capitals = len(text) - len(text.translate(None, _UPPER))
    fails = (
        len(words) < FEWEST_WORDS,
        100 * len(set(words)) < 50 * len(words),
        100 * capitals > 2 * points,
        _SYMBOL.search(text) is not None,
    )
    return sum(1 << k for k, failed in enumerate(fails) if failed)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").to_pylist()]
        masks = pa.array([text_mask(t) for t in texts], pa.int32())
        digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), masks, digests], names=["id", "part", "mask", "digest"])


def failures(docs: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``part``, ``mask`` (row-wise filters only) and ``digest`` of the text, per row."""
    with_python(docs.sparkSession)
    part = F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")
    rows = docs.select(F.col(id_col).alias("id"), part, F.col(text_col).cast("binary").alias("text"))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("mask", T.IntegerType()), T.StructField("digest", T.BinaryType())])
    return rows.mapInArrow(_measure, schema)


def cells(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``part``, ``mask`` and the counts ``n``, ``good``, ``toxic`` of the documents with that mask, all filters included."""
    own = failures(docs, part_col, id_col, text_col).groupBy("id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(*(F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))))
    marked = own.join(marks, "id", "left").fillna(0, ["good", "toxic"])
    # The least id of each combination of text, part and labels goes along with its rows, to be compared with the text's.
    least = F.struct(F.col("id").isNull().alias("none"), "id", "n")
    alike = marked.groupBy("digest", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.min(least).alias("first"))
    alike = durable(alike.select("*", F.struct("first.none", "first.id").alias("own"), F.col("first.n").alias("n_first")).drop("first"))
    first = alike.groupBy("digest").agg(F.min("own").alias("least"))
    joined = alike.join(first, "digest")
    originals = F.when(F.col("least.none"), F.col("n")).when(F.col("own") == F.col("least"), F.col("n_first")).otherwise(0)
    bit = 1 << FILTERS.index("E")
    split = joined.select(
        "part",
        "good",
        "toxic",
        F.explode(F.array(F.struct(F.col("mask"), originals.alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - originals).alias("n")))).alias("c"),
    )
    of = split.select("part", "c.mask", "c.n", (F.col("c.n") * F.col("good")).alias("good"), (F.col("c.n") * F.col("toxic")).alias("toxic"))
    return of.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in COUNTS))


def removal_intervals(filters: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first, end): orders ``first`` to ``end - 1`` in lexicographic rank remove the mask's documents at that step."""
    out: list[tuple[int, int, int, int]] = []
    for mask in range(1, 1 << filters):
        found: list[tuple[int, int, int]] = []

        def walk(rank: int, left: tuple[int, ...], step: int, mask: int = mask, found: list = found) -> None:
            width = factorial(len(left) - 1)  # orders that share the next filter too
            for digit, f in enumerate(left):
                start = rank + digit * width
                if mask >> f & 1:
                    found.append((step, start, start + width))
                else:
                    walk(start, (*left[:digit], *left[digit + 1 :]), step + 1)

        walk(0, tuple(range(filters)), 1)
        joint: list[tuple[int, int, int]] = []
        for step, start, end in sorted(found):
            if joint and joint[-1][0] == step and joint[-1][2] == start:
                joint[-1] = (step, joint[-1][1], end)
            else:
                joint.append((step, start, end))
        out += [(mask, *run) for run in joint]
    return out


def interactions(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per part, order and step: ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost``, ``shapley``.

    ``counted`` is what ``cells`` returns, bit ``k`` of its masks standing for the
    k-th letter of ``filters``.
    """
    spark = counted.sparkSession
    size, ranks = len(filters), factorial(len(filters))
    counted = durable(counted)
    # One row per mask and run of orders: 840 at most for five filters, whatever the input.
    runs = F.broadcast(spark.createDataFrame(removal_intervals(size), "mask int, step int, start int, end int"))
    ends = F.array(*(F.struct(F.col(at).alias("rank"), *((F.col(c) * sign).alias(c) for c in COUNTS)) for at, sign in (("start", 1), ("end", -1))))
    changes = counted.join(runs, "mask").select("part", "step", F.inline(ends))
    parts = counted.groupBy("part").agg(
        F.sum("n").alias("documents"),
        F.array(*(F.sum(F.when(F.col("mask").bitwiseAND(1 << k) != 0, F.col("n")).otherwise(0)) for k in range(size))).alias("failing"),
        F.array(*(F.sum(F.when(F.col("mask") == 1 << k, F.col("n")).otherwise(0)) for k in range(size))).alias("alone"),
    )
    steps = parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step"))
    grid = steps.select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))).alias("rank"), *(F.lit(0).cast("long").alias(c) for c in COUNTS))
    array = changes.unionByName(grid).groupBy("part", "step", "rank").agg(*(F.sum(c).alias(c) for c in COUNTS))
    upto = Window.partitionBy("part", "step").orderBy("rank")
    totals = array.select("part", "step", "rank", *(F.sum(c).over(upto).alias(c) for c in COUNTS)).where(F.col("rank") < ranks)
    orders = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    named = totals.withColumn("filter_order", F.get(orders, F.col("rank"))).withColumn("letter", F.substr("filter_order", F.col("step"), F.lit(1)))
    place = F.instr(F.lit(filters), F.col("letter")) - 1
    before = Window.partitionBy("part", "rank").orderBy("step")
    return named.join(parts, "part").select(
        "part",
        "filter_order",
        "step",
        (F.col("documents") - F.sum("n").over(before)).alias("kept"),
        F.col("n").alias("removed"),
        (F.get("failing", place) - F.col("n")).alias("redundant"),
        F.get("alone", place).alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "letter")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The interactions of the five filters on a table of documents, per part."""
    return interactions(cells(docs, labels, part_col, id_col, text_col))
