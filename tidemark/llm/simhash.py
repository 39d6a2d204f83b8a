"""SimHash near-duplicates: a binary-trie self-join on 64-bit fingerprints.

Fingerprint: a text is lower-cased (A-Z), cut into words and shingled; a bit is
set if it is set in more than half of the shingles' XXH64 values (seed 42,
repeats included). Distinct fingerprints that differ in at most ``max_bits`` bits
are linked.

Routing. Two fingerprints within ``max_bits`` bits agree on at least one of
``max_bits + 1`` bands, so each distinct fingerprint goes to one group per band.
A group of more than ``GROUP`` fingerprints is routed on by bands of its free
bits, with the same argument, until the groups are small: nothing is capped.

Join. Within a block of groups the sorted fingerprints are a binary trie whose
nodes are index ranges. Pairs of nodes are walked down together; a pair carries
the number of bits in which its two paths differ and is dropped as soon as that
exceeds ``max_bits``. Two single leaves are compared at once. Leaf pairs that
survive are links. A pair of nodes whose leaves are all in one component already
can add nothing and is dropped too, so a large group of near copies does not cost
the square of its size. Each block returns a spanning forest of its links, which
has the same components and at most one row per fingerprint.

Results for odd input: a text without words has fingerprint 0 and is linked like
any other; a row without an id gets its fingerprint and component null; rows that
share an id share their component; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, with_python
from tidemark.llm.components import components

SEED = 42
SHINGLE = 3
MAX_BITS = 3
GROUP = 1_000_000  # fingerprints of one routing group that a task joins; larger groups are routed on
BLOCK = 65_536  # rows joined at a time, whole groups
PAIRS = 250_000  # node pairs walked down at a time


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a UTF-8 text."""
    from xxhash import xxh64_intdigest

    w = (text or b"").lower().split()  # on bytes: A-Z, and ASCII white space
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        m = min(n - k, 1 << 16)
        pieces = map(b" ".join, zip(*(w[k + i : k + i + m] for i in range(shingle)), strict=True)) if len(w) >= shingle else [b" ".join(w)]
        h = np.fromiter(map(xxh64_intdigest, pieces, repeat(SEED)), "<u8", m)
        bits = np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` (long) and ``fp`` (the fingerprint's bits as a signed long), one row per row."""
    with_python(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "id bigint, fp bigint")


def trie_links(group: np.ndarray, fp: np.ndarray, max_bits: int) -> np.ndarray:
    """Component labels (an index into the input) of the links within each group.

    ``group`` and ``fp`` (unsigned) are sorted together; fingerprints are distinct
    within a group.
    """
    label = np.arange(len(fp))
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(fp) else np.zeros(0, int)
    ends = np.append(edges[1:], len(fp))
    # Neighbours in order are linked first: in a group of near copies most of them are near.
    beside = np.flatnonzero((group[1:] == group[:-1]) & (np.bitwise_count(fp[1:] ^ fp[:-1]) <= max_bits))
    label = _unite(label, beside, beside + 1)
    many = ends - edges > 1
    lo, hi = edges[many], ends[many]
    # (bit, first node, second node, differing bits); a pair of a node with itself stands for all pairs inside it.
    stack = [(63, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        bit, a0, a1, b0, b1, err = stack.pop()
        if len(a0) == 0:
            continue
        if len(a0) > PAIRS:
            half = len(a0) // 2
            stack += [(bit, *(x[:half] for x in (a0, a1, b0, b1, err))), (bit, *(x[half:] for x in (a0, a1, b0, b1, err)))]
            continue
        changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        one = (changes[a1 - 1] == changes[a0]) & (changes[b1 - 1] == changes[b0]) & (label[a0] == label[b0])
        a0, a1, b0, b1, err = (x[~one] for x in (a0, a1, b0, b1, err))
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            near = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
            label = _unite(label, i[near], j[near])
            a0, a1, b0, b1, err = (x[~leaf] for x in (a0, a1, b0, b1, err))
        if bit < 0 or len(a0) == 0:
            continue
        ones = np.concatenate([[0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = (a0 == b0) & (a1 == b1)
        parts = [
            (a0, am, b0, bm, err, np.ones(len(a0), bool)),
            (am, a1, bm, b1, err, np.ones(len(a0), bool)),
            (a0, am, bm, b1, err + 1, err < max_bits),
            (am, a1, b0, bm, err + 1, (err < max_bits) & ~same),  # of a node with itself, the mirror image
        ]
        kept = []
        for p0, p1, q0, q1, e, ok in parts:
            # Empty nodes and a single leaf with itself end here.
            ok = ok & (p1 > p0) & (q1 > q0) & ~((p0 == q0) & (p1 - p0 == 1))
            kept.append([x[ok] for x in (p0, p1, q0, q1, e)])
        stack.append((bit - 1, *(np.concatenate(x) for x in zip(*kept, strict=True))))
    return label


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining i[k] with j[k]: hook the larger root on the smaller, then shorten paths."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _block_links(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(rows: np.ndarray) -> pa.RecordBatch:
            new = np.concatenate([[True], (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])])
            group, fp, node = np.cumsum(new), rows[:, 2].copy().view(np.uint64), rows[:, 3]
            order = np.lexsort((fp, group))
            group, fp, node = group[order], fp[order], node[order]
            label = trie_links(group, fp, max_bits)
            at = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[label[at]])], names=["a", "b"])

        for batch in batches:
            held.append(np.column_stack([np.asarray(batch.column(k)) for k in range(4)]))
            if sum(map(len, held)) >= BLOCK:
                rows = np.concatenate(held)
                # The last group may go on in the next batch.
                last = rows[-1, :2]
                cut = len(rows) - int(((rows[:, 0] == last[0]) & (rows[:, 1] == last[1])).sum())
                if cut:
                    yield links(rows[:cut])
                held = [rows[cut:]]
        rows = np.concatenate(held) if held else np.zeros((0, 4), np.int64)
        if len(rows):
            yield links(rows)

    return run


def _bands(free: list[int], n: int) -> list[int]:
    """``n`` bit masks (signed longs) that share the given bit positions out evenly."""
    masks = [sum(1 << b for b in free[k * len(free) // n : (k + 1) * len(free) // n]) for k in range(n)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _routes(mask: int, max_bits: int) -> list[int]:
    """The masks that a group of this mask is routed on by: the mask with one more band each."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | m for m in _bands(free, min(max_bits + 1, len(free)))]


def links(nodes: DataFrame, max_bits: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """Links ``a``, ``b`` between node numbers that connect the same nodes as all pairs within ``max_bits`` do.

    ``nodes`` has distinct ``fp`` and a ``node`` number each.
    """
    spark = with_python(nodes.sparkSession)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    masks = _routes(0, max_bits)
    todo = nodes.select(F.explode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("mask"), "fp", "node")
    todo = todo.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp", "node")
    ready = None
    while True:
        sizes = todo.groupBy("mask", "value").count()
        large = durable(sizes.where(F.col("count") > group).select("mask", "value"))
        if large.isEmpty():
            ready = todo if ready is None else ready.unionByName(todo)
            break
        small = todo.join(large, ["mask", "value"], "left_anti")
        ready = small if ready is None else ready.unionByName(small)
        onward = {m: _routes(m, max_bits) for m in masks}
        masks = sorted({c for cs in onward.values() for c in cs})
        table = F.create_map(*(x for m, cs in onward.items() for x in (F.lit(m).cast("long"), F.array(*(F.lit(c).cast("long") for c in cs)))))
        todo = todo.join(large, ["mask", "value"], "left_semi").select(F.explode(table[F.col("mask")]).alias("mask"), "fp", "node")
        todo = durable(todo.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp", "node"))
    dealt = ready.repartition(partitions, "mask", "value").sortWithinPartitions("mask", "value")
    return dealt.mapInArrow(_block_links(max_bits), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id``, ``fp`` and ``component_id``, the least id reachable over links of fingerprints."""
    rows = durable(fingerprints(docs, shingle, id_col, text_col))
    # Copies fall together before anything is routed: a node is a distinct fingerprint.
    nodes = durable(rows.where(F.col("id").isNotNull()).groupBy("fp").agg(F.min("id").alias("node")))
    root = components(links(nodes, max_bits))
    named = nodes.join(root, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    joined = rows.join(named, "fp", "left")
    return joined.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
