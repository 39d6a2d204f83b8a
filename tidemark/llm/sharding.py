"""Sharding by minimax contiguous partition of atomic groups.

Equal texts form a group, and a group goes to one shard whole. The groups stand in
the order of a 64-bit hash of their text. The smallest capacity is searched for at
which a greedy fill, shard by shard along that order, takes all groups; the shards
are cut where that fill cuts.

A group larger than an even share would set the capacity for all shards, so such
groups (fewer than there are shards) each get a shard of their own, largest first,
and the others are divided over the shards that are left.

The search never sees the groups themselves. It works on a histogram over ranges of
the hash (``Cells``): a greedy fill over ranges has a lower and an upper bound for
each cut, so a capacity is feasible, infeasible or undecided. While the answer or a
cut is undecided, only the ranges around the undecided cuts are counted again in
finer ranges, down to single groups, so the capacity and the cuts are exact. What
reaches the driver is the first histogram (``16 * shards**2`` ranges, 4,096 at
least) and a few finer ranges per cut and level, whatever the size of the input.

A row's shard follows from its text's hash and the cuts alone. Slots are numbered
per shard in the order of a hash of id and text: rows are counted per range of that
hash, and only rows of one range are ordered together. Rows alike in id and text are
one row with a count until they have their slots, so copies never pile up.

Results for odd input: a null text has no bytes and is in the group of the empty
text; a null id takes part like any other; repeated rows get a slot each; a table
with fewer groups than shards leaves shards empty; an empty table gives no rows;
other columns are carried by ``write_shards`` only.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import durable

SHARDS = 40
#: Bytes that a row takes in a shard besides its text.
OVERHEAD = 16
#: A finer level has 2 ** FINER ranges for each open one.
FINER = 5
#: Ranges (as a power of two) that a shard's rows are numbered in, at least, and the rows of one range, about.
RANGE_BITS = 6
ORDERED = 100_000
#: Slots that one counted row is given at once.
CHUNK = 100_000


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def group_of(text: Column) -> Column:
    """The group's place in the order: a 64-bit hash of the text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


@dataclass
class Cells:
    """Ranges of hashes in order: first hash, bits that all hashes of the range share, bytes, groups."""

    first: np.ndarray
    bits: np.ndarray
    size: np.ndarray
    groups: np.ndarray

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.size)


def fill(cells: Cells, capacity: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds, in bytes, of where a greedy fill stands after each shard.

    A cut is at the end of some group. The ends of ranges are such places; inside a
    range of one group there is none, inside others one may be anywhere.
    """
    ends = cells.ends
    total = int(ends[-1]) if len(ends) else 0
    low, high, lows, highs = 0, 0, [], []
    for _ in range(shards):
        low, high = min(low + capacity, total), min(high + capacity, total)
        k = int(np.searchsorted(ends, low, side="right"))
        low = int(ends[k - 1]) if k else 0
        k = int(np.searchsorted(ends, high, side="right"))
        if k < len(ends) and cells.groups[k] == 1:
            high = int(ends[k - 1]) if k else 0
        lows.append(low)
        highs.append(high)
    return np.array(lows, np.int64), np.array(highs, np.int64)


def _least(good, low: int, high: int) -> int:
    """The smallest whole number from ``low`` to ``high`` for which ``good`` holds; it does for ``high``."""
    return low + bisect.bisect_left(range(low, high), True, key=good)


def search(cells: Cells, shards: int) -> tuple[int, int, np.ndarray]:
    """Bounds of the smallest feasible capacity, and the ranges that must be finer to settle it and its cuts."""
    total = int(cells.size.sum())
    possible = _least(lambda c: fill(cells, c, shards)[1][-1] >= total, 0, total)
    feasible = _least(lambda c: fill(cells, c, shards)[0][-1] >= total, possible, total)
    # A cut moves up with the capacity, so all cuts in question are between these.
    lows, highs = fill(cells, possible, shards)[0], fill(cells, feasible, shards)[1]
    ends = cells.ends
    starts = ends - cells.size
    unsettled = np.zeros(len(ends), bool)
    for a, b in zip(lows, highs, strict=True):
        if a < b:
            unsettled[np.searchsorted(ends, a, side="right") : np.searchsorted(starts, b, side="left")] = True
    return possible, feasible, unsettled & (cells.groups > 1)


def _histogram(groups: DataFrame, bits: Column) -> Cells:
    """The groups counted in ranges that share the given number of leading bits."""
    shift = 64 - bits
    keep = F.call_function("shiftleft", F.call_function("shiftright", F.col("group"), shift.cast("int")), shift.cast("int"))
    rows = groups.select(keep.alias("first"), bits.alias("bits"), "size").groupBy("first", "bits").agg(F.sum("size").alias("size"), F.count("*").alias("groups"))
    found = sorted(rows.collect())  # bounded: see the module's docstring
    return Cells(*(np.array([r[k] for r in found], np.int64) for k in ("first", "bits", "size", "groups")))


def cut_points(groups: DataFrame, shards: int) -> list[int]:
    """Lowest hash of each shard but the first; ``groups`` has ``group`` and ``size``, one row per group."""
    start = min(62, max(12, (16 * shards * shards - 1).bit_length()))
    cells = _histogram(groups, F.lit(start))
    if not len(cells.first) or shards <= 1:
        return []
    while True:
        possible, feasible, unsettled = search(cells, shards)
        if not unsettled.any():
            break
        # The groups of the unsettled ranges; the table of those ranges has the size of the first histogram at most.
        open_first, open_bits = cells.first[unsettled], cells.bits[unsettled]
        table = groups.sparkSession.createDataFrame([(int(a), int(b)) for a, b in zip(open_first, open_bits, strict=True)], "of long, of_bits int")
        parts = []
        for width in sorted({int(b) for b in open_bits}):
            mine = table.where(F.col("of_bits") == width)
            parts.append(groups.join(F.broadcast(mine), F.shiftleft(F.shiftright("group", 64 - width), 64 - width) == F.col("of"), "inner"))
        inner = parts[0]
        for part in parts[1:]:
            inner = inner.unionByName(part)
        finer = _histogram(inner, F.least(F.col("of_bits") + FINER, F.lit(64)))
        kept = ~unsettled
        merged = Cells(*(np.concatenate([getattr(cells, f)[kept], getattr(finer, f)]) for f in ("first", "bits", "size", "groups")))
        order = np.argsort(merged.first, kind="stable")
        cells = Cells(*(getattr(merged, f)[order] for f in ("first", "bits", "size", "groups")))
    cuts = fill(cells, feasible, shards)[0]
    at = np.searchsorted(cells.ends, cuts, side="right")
    return [int(cells.first[k]) for k in at if k < len(cells.first)]


@dataclass
class Plan:
    """``alone``: hashes of the groups that have a shard of their own (shards 0, 1, ...); ``cuts``: lowest hash of each further shard but the first."""

    alone: list[int]
    cuts: list[int]
    shards: int

    def shard(self, group: Column) -> Column:
        """The shard of a group, from its hash alone."""
        place = F.lit(len(self.alone))
        if self.cuts:
            place += F.size(F.filter(F.array(*map(F.lit, self.cuts)), lambda c: c <= group))
        if self.alone:
            own = F.array_position(F.array(*map(F.lit, self.alone)), group).cast("int")
            place = F.when(own > 0, own - 1).otherwise(place)
        return place.cast("int")


def plan_shards(docs: DataFrame, shards: int = SHARDS, text_col: str = "text") -> Plan:
    """Shards with near equal bytes for the rows of ``docs``, equal texts together."""
    if shards < 1:
        raise ValueError("at least one shard")
    text = F.col(text_col)
    groups = durable(docs.select(group_of(text).alias("group"), size_of(text).alias("size")).groupBy("group").agg(F.sum("size").alias("size")))
    left, open_shards, alone = groups.agg(F.sum("size")).first()[0] or 0, shards, []
    for r in groups.orderBy(F.desc("size"), "group").limit(shards).collect():
        if open_shards == 1 or r["size"] * open_shards <= left:
            break
        alone.append(r["group"])
        left, open_shards = left - r["size"], open_shards - 1
    rest = groups.where(~F.col("group").isin(alone)) if alone else groups
    return Plan(alone, cut_points(rest, open_shards), shards)


def assign(docs: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``size``, ``text_crc32``, ``group``, ``shard`` and ``slot`` (0, 1, ... in each shard) of every row."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        size_of(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        group_of(text).alias("group"),
    )
    alike = rows.groupBy("id", "size", "text_crc32", "group").agg(F.count("*").alias("n"))
    alike = durable(alike.select("*", plan.shard(F.col("group")).alias("shard"), F.xxhash64("id", "group", "text_crc32").alias("at")))
    largest = alike.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    bits = max(RANGE_BITS, (largest // ORDERED).bit_length())
    ranged = alike.withColumn("range", F.shiftright("at", 64 - bits))
    upto = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("shard", "range").agg(F.sum("n").alias("rows")).select("shard", "range", F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "range").orderBy("at", "id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    placed = ranged.join(offsets, ["shard", "range"]).select("id", "size", "text_crc32", "group", "shard", "n", start.alias("start"))
    columns = ["id", "size", "text_crc32", "group", "shard"]
    single = placed.where(f"n <= {CHUNK}").select(*columns, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("slot"))
    # Many rows alike: dealt in chunks over the tasks.
    chunks = placed.where(f"n > {CHUNK}").select(*columns, (F.col("start") + F.col("n")).alias("end"), F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1, F.lit(CHUNK))).alias("from"))
    many = chunks.repartition("from").select(*columns, F.explode(F.sequence(F.col("from"), F.least(F.col("from") + CHUNK, F.col("end")) - 1)).alias("slot"))
    return single.unionByName(many)


def write_shards(docs: DataFrame, plan: Plan, path: str, id_col: str = "doc_id", text_col: str = "text", files: int = 8) -> None:
    """Write the rows as Parquet, one folder ``shard=k`` per shard with up to ``files`` files.

    A column of the rows that is called ``shard`` is replaced by the shard. Rows are
    dealt by a hash of id and text inside their shard, so a shard that one large group
    fills is written by several tasks too.
    """
    of = docs.withColumn("shard", plan.shard(group_of(F.col(text_col))))
    salt = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(files))
    of.repartition(plan.shards * files, F.col("shard"), salt).write.partitionBy("shard").parquet(path)
