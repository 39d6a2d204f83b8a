"""Mixing sources to target weights by min-cost flow over membership patterns.

1. ``targets``: each source's target share of all words, by weight, at most
   ``most`` times its size; what a source cannot take is shared out again by
   weight among the others until none is above.
2. Documents are aggregated by membership pattern (the set of sources a document
   counts for). Words flow from patterns to sources up to the sources' targets,
   at a convex cost for repeats: the first pass over a pattern is free, each
   further pass dearer than the one before, ``most`` passes at most. Patterns that
   share no source, even by way of others, don't act on each other, so the flow is
   solved per connected set of sources, each in a group of its own: a group holds
   patterns, never documents.
3. A pattern's flow is whole passes plus a rest. The rest goes to documents in the
   order of a seeded hash of their ids, up to a cut-off found from a histogram of
   hashes; only the one bucket that holds the cut-off is ordered. What is left
   because the next document is too large goes to smaller ones in the same way.

Results for odd input: a null or empty text has size 0 and is taken 0 times; a
null source is a source of its own, last in order; rows that share an id are taken
alike; a document without any source is not taken; an empty table gives an empty
mix; reruns and other partitionings give the same mix.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import durable, with_python, word_count
from tidemark.llm.components import components

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 42
BUCKETS = 4096


def member_key(source: Column) -> Column:
    """A key that tells a null source from every text."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source.cast("string")))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``key``, ``rank``, ``source_size`` and ``target`` from ``key`` and ``source_size``, one row per source.

    The level x at which targets are min(weight * x, most * size) and add up to all
    words: sources fill up in the order of most * size / weight, so the full ones are
    found with running sums over sources.
    """
    by_name = Window.orderBy(F.col("key") == "-", "key")
    ranked = sources.withColumn("rank", F.row_number().over(by_name).cast("long"))
    repeating = F.array(*(F.lit(w) for w in weights))
    weighed = ranked.withColumn("weight", F.get(repeating, ((F.col("rank") - 1) % len(weights)).cast("int"))).withColumn("most", F.col("source_size") * most)
    filling = Window.orderBy((F.col("most") / F.col("weight")), "rank")
    below = filling.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    led = weighed.select(
        "*",
        F.sum("source_size").over(whole).alias("all_words"),
        F.coalesce(F.sum("most").over(below), F.lit(0)).alias("full_words"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(below), F.lit(0))).alias("open_weight"),
    )
    # Counting a source as full raises the level as long as it is one that overflows, and
    # lowers it after that, so the highest of these levels is the one that fits.
    level = (F.col("all_words") - F.col("full_words")).cast("double") / F.col("open_weight")
    settled = led.withColumn("level", F.max(level).over(whole))
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.col("level"))
    return settled.select("key", "rank", "source_size", target.alias("target"))


def min_cost_flow(capacity: dict[str, int], members: dict[str, list[str]], quota: dict[str, int], most: int = MOST) -> dict[str, int]:
    """Words each pattern gives, by successive cheapest paths.

    Arcs: start to pattern (one per pass, cost 0, 1, 3, 6, ...), pattern to each of
    its sources (free), source to end (its quota).
    """
    arcs: list[list[int]] = []  # to, free capacity, cost; an arc's reverse is its neighbour
    out: dict[object, list[int]] = {}
    number: dict[object, int] = {}

    def node(x: object) -> int:
        if x not in number:
            number[x] = len(number)
            out[number[x]] = []
        return number[x]

    def arc(a: object, b: object, room: int, cost: int) -> None:
        for u, v, r, c in ((node(a), node(b), room, cost), (node(b), node(a), 0, -cost)):
            out[u].append(len(arcs))
            arcs.append([v, r, c])

    start, end = node("start"), node("end")
    for p in sorted(capacity):
        for k in range(most):
            arc("start", ("pattern", p), capacity[p], k * (k + 1) // 2)
        for s in sorted(members[p]):
            arc(("pattern", p), ("source", s), most * capacity[p], 0)
    for s in sorted(quota):
        arc(("source", s), "end", quota[s], 0)
    potential = [0] * len(number)
    while True:
        best, via, heap = {start: 0}, {}, [(0, start)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > best[u]:
                continue
            for e in out[u]:
                v, room, cost = arcs[e]
                step = d + cost + potential[u] - potential[v]
                if room > 0 and (v not in best or step < best[v]):
                    best[v], via[v] = step, e
                    heapq.heappush(heap, (step, v))
        if end not in best:
            break
        for v, d in best.items():
            potential[v] += d
        path, v = [], end
        while v != start:
            path.append(via[v])
            v = arcs[via[v] ^ 1][0]
        push = min(arcs[e][1] for e in path)
        for e in path:
            arcs[e][1] -= push
            arcs[e ^ 1][1] += push
    given = dict.fromkeys(capacity, 0)
    for p in capacity:
        for e in out[number[("pattern", p)]]:
            if arcs[e][0] == start:
                given[p] += arcs[e][1]
    return given


def _solve(most: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        capacity, members, quota = {}, {}, {}
        for r in rows.itertuples():
            capacity[r.pattern] = int(r.words)
            members.setdefault(r.pattern, []).append(r.key)
            quota[r.key] = int(round(r.target))
        given = min_cost_flow(capacity, members, quota, most)
        return pd.DataFrame({"pattern": list(given), "words": [capacity[p] for p in given], "given": [given[p] for p in given]})

    return run


def mix_plan(sized: DataFrame, targets: DataFrame, most: int = MOST, seed: int = SEED) -> DataFrame:
    """How often each pattern's documents are taken, one row per pattern.

    ``sized`` has ``id`` (string), ``members`` (sorted array of member keys),
    ``pattern`` (its text) and ``size``; ``targets`` has ``key``, ``rank``, ``target``.
    A document is taken ``passes`` times, and once more where ``_taken`` holds or its
    id is ``extra_id``.
    """
    with_python(sized.sparkSession)
    patterns = durable(sized.where(F.size("members") > 0).groupBy("pattern", "members").agg(F.sum("size").alias("words")))
    arms = durable(patterns.select("pattern", "words", F.explode("members").alias("key")).join(targets.select("key", "rank", "target"), "key"))
    firsts = arms.groupBy("pattern").agg(F.min("rank").alias("b"))
    joint = components(arms.join(firsts, "pattern").select(F.col("rank").alias("a"), "b"))
    sets = arms.join(joint.select(F.col("node").alias("rank"), "root"), "rank", "left").withColumn("root", F.coalesce("root", "rank"))
    flows = durable(sets.groupBy("root").applyInPandas(_solve(most), "pattern string, words long, given long"))
    rows = sized.where("size > 0").select("pattern", "id", "size", _order_hash(seed).alias("hash"))
    passes = F.floor(F.col("given") / F.greatest(F.col("words"), F.lit(1))).cast("long")
    rest = flows.select("pattern", passes.alias("passes"), (F.col("given") - passes * F.col("words")).alias("rest"))
    plan = durable(rest.join(_cut(rows, rest, "1"), "pattern", "left"))
    # What the first document beyond the cut-off was too large for goes to smaller ones, again in
    # hash order, and at last to the one that fits best.
    smaller = rows.join(small(plan), "pattern").where(~_taken_by("1") & (F.col("size") <= F.col("gap1"))).select(*rows.columns)
    plan = durable(plan.join(_cut(smaller, plan.select("pattern", F.col("gap1").alias("rest")), "2"), "pattern", "left"))
    gap = F.coalesce("gap2", "gap1")
    off = F.abs(F.col("size") - gap)
    beyond = rows.join(small(plan), "pattern").where(~_taken() & (off < gap))
    extra = beyond.groupBy("pattern").agg(F.min(F.struct(off.alias("off"), "hash", "id"))["id"].alias("extra_id"))
    return plan.join(extra, "pattern", "left").drop("rest")


def _cut(rows: DataFrame, rest: DataFrame, n: str) -> DataFrame:
    """Per pattern, the last (hash, id) up to which rows in that order fit into its rest, and the gap left.

    A histogram of hashes finds the bucket; only its rows are ordered.
    """
    hashed = rows.withColumn("bucket", _bucket())
    histogram = hashed.groupBy("pattern", "bucket").agg(F.sum("size").alias("in_bucket"))
    upto = Window.partitionBy("pattern").orderBy("bucket")
    running = histogram.withColumn("upto", F.sum("in_bucket").over(upto)).join(rest.select("pattern", "rest"), "pattern")
    # The first bucket that does not fit whole, or one past the end.
    over = F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bucket", (F.col("upto") - F.col("in_bucket")).alias("before"))))
    edges = running.groupBy("pattern", "rest").agg(F.coalesce(over, F.struct(F.lit(BUCKETS).alias("bucket"), F.max("upto").alias("before"))).alias("e"))
    edge = durable(edges.select("pattern", "rest", "e.bucket", "e.before"))
    inside = hashed.join(edge, ["pattern", "bucket"]).groupBy("pattern", "before", "rest", "hash", "id").agg(F.sum("size").alias("size"))
    so_far = F.sum("size").over(Window.partitionBy("pattern").orderBy("hash", "id"))
    chosen = inside.withColumn("sum", F.col("before") + so_far).where(F.col("sum") <= F.col("rest"))
    cut = chosen.groupBy("pattern").agg(F.max(F.struct("hash", "id")).alias("c"), F.max("sum").alias("sum"))
    # Where no row of the bucket fits, the cut-off is just before it.
    return edge.join(cut, "pattern", "left").select(
        "pattern",
        F.coalesce(F.col("c.hash"), _bucket_start(F.col("bucket")) - 1).alias(f"hash{n}"),
        F.coalesce(F.col("c.id"), F.lit("")).alias(f"id{n}"),
        (F.col("rest") - F.coalesce("sum", "before")).alias(f"gap{n}"),
    )


def _taken_by(n: str) -> Column:
    hit = (F.col("hash") < F.col(f"hash{n}")) | ((F.col("hash") == F.col(f"hash{n}")) & (F.col("id") <= F.col(f"id{n}")))
    return F.coalesce(hit, F.lit(False))


def _taken() -> Column:
    """Whether a row gets one pass more than its pattern's whole passes."""
    return _taken_by("1") | (_taken_by("2") & (F.col("size") <= F.col("gap1")))


def _order_hash(seed: int) -> Column:
    """A seeded hash of the id, from 0 to 2**62."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 2)


def _bucket() -> Column:
    return F.shiftright("hash", 62 - BUCKETS.bit_length() + 1).cast("int")


def _bucket_start(bucket: Column) -> Column:
    return F.shiftleft(bucket.cast("long"), 62 - BUCKETS.bit_length() + 1)


def mix(docs: DataFrame, members: Column, id_col: str = "doc_id", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix and the targets.

    ``members`` is an array column: the sources a document counts for. The mix has
    ``row`` (the input columns as a struct), ``members`` (their keys), ``size`` and
    ``taken`` (words taken, repeats counted; 0 for documents left out). The targets
    have ``key``, ``rank``, ``source_size`` and ``target``.
    """
    keys = F.array_sort(F.array_distinct(F.transform(members, member_key)))
    base = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(keys, F.array().cast("array<string>")).alias("members"), word_count(F.col(text_col)).alias("size"))
    base = base.withColumn("pattern", F.to_json("members"))
    sized = durable(base.drop("row"))
    sources = sized.select(F.explode("members").alias("key"), "size").groupBy("key").agg(F.sum("size").alias("source_size"))
    targets = durable(source_targets(sources, weights, most))
    plan = durable(mix_plan(sized, targets, most, seed))
    joined = base.withColumn("hash", _order_hash(seed)).join(small(plan), "pattern", "left")
    again = _taken() | F.col("id").eqNullSafe(F.col("extra_id"))
    taken = F.coalesce(F.col("size") * (F.col("passes") + F.when(again, 1).otherwise(0)), F.lit(0).cast("long"))
    return joined.select("row", "members", "size", taken.alias("taken")), targets


def small(table: DataFrame, rows: int = 10_000) -> DataFrame:
    """The table, with a broadcast hint if it was counted to be small; else Spark joins it by shuffle."""
    return F.broadcast(table) if table.count() <= rows else table


