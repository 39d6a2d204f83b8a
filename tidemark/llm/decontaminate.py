"""Benchmark decontamination: broadcast hash set of normalised test n-grams.

A text is lower-cased (A-Z) and cut into words (letters, digits and all
characters beyond ASCII). A window is ``width`` consecutive words of a benchmark
item; an item of fewer words, but not none, is one window. Tasks look up the hash of
every run of known words of a document in the window set, verify the words, and mark
them.

The window set is kept small (``Windows``): the benchmark's words as numbers, once, and
a hash and a start per window. It is collected and broadcast in slices of at most
``SLICE`` windows, each counted first. The documents are read in one pass whatever the
number of slices: a task gathers documents up to ``GATHERED`` bytes and holds them
against one slice after the other, with one slice in memory at a time. Items are cut
into blocks of ``BLOCK`` windows and blocks are dealt by item and place, so neither a
long item nor a window that many items share makes a slice larger.

Results for odd input: null and empty texts have no words and no hits; benchmark
items without words or without an id are ignored; items that share an id count
once; a document that is in the table twice gives two rows; the result has the id,
the columns asked for in ``carry``, and its own three.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import durable, with_python

WIDTH = 13
SLICE = 200_000
BLOCK = 1_000
GATHERED = 8 << 20
#: A document is contaminated when hits * SHARE >= words.
SHARE = 20

# Every byte outside [0-9a-z\x80-\xff] separates words; A-Z become a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def tokens(text: bytes | None) -> list[bytes]:
    """The normalised words of a UTF-8 text."""
    return (text or b"").translate(_TABLE).split()


def _item_blocks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = tokens(text)
                size = min(width, len(w))
                windows = len(w) - size + 1 if w else 0
                for a in range(0, windows, BLOCK):
                    n = min(BLOCK, windows - a)
                    rows.append((item, a, n, size, b" ".join(w[a : a + n + size - 1])))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["item", "place", "windows", "size", "words"])

    return run


class Windows:
    """A slice of the window set: word numbers of its blocks, and the windows of each size by hash."""

    def __init__(self, blocks: list[tuple[str, int, bytes]]) -> None:
        """``blocks``: item, words of a window, and the words that the windows run over."""
        self.names = sorted({item for item, _, _ in blocks})
        number: dict[bytes, int] = {}
        place = {item: i for i, item in enumerate(self.names)}
        stream, starts, of, size, at = [], [], [], [], 0
        for item, n, words in blocks:
            w = bytes(words).split(b" ")
            stream += [number.setdefault(x, len(number)) for x in w]
            starts += range(at, at + len(w) - n + 1)
            of += [place[item]] * (len(w) - n + 1)
            size += [n] * (len(w) - n + 1)
            at += len(w)
        self.words, self.vocabulary = np.array(stream, np.int32), b" ".join(number)
        starts, of, size = np.array(starts, np.int64), np.array(of, np.int32), np.array(size, np.int32)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted(set(size.tolist())):
            mine = np.flatnonzero(size == n)
            hashes = _hashes(self.words, starts[mine], n)
            order = np.argsort(hashes, kind="stable")
            self.by_size[n] = (hashes[order], starts[mine][order].astype(np.int32), of[mine][order])
        self._number: dict[bytes, int] | None = None

    def hits(self, texts: list[list[bytes]]) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(text, first word, end, numbers of the items) for every place of a text that is a window."""
        if self._number is None:
            self._number = {w: i for i, w in enumerate(self.vocabulary.split(b" "))}
        get = self._number.get
        # Texts one after the other, each ended by an unknown word, so no window runs from one into the next.
        flat = np.fromiter((get(w, -1) for t in texts for w in (*t, b" ")), np.int32)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        unknown = np.concatenate([[0], np.cumsum(flat < 0)])
        for n, (hashes, starts, of) in self.by_size.items():
            if len(flat) < n:
                continue
            at = np.flatnonzero(unknown[n:] == unknown[:-n])
            found = _hashes(flat, at, n)
            left, right = np.searchsorted(hashes, found, "left"), np.searchsorted(hashes, found, "right")
            for k in np.flatnonzero(left < right).tolist():
                a = int(at[k])
                near = np.arange(left[k], right[k])
                same = (self.words[starts[near][:, None] + np.arange(n)] == flat[a : a + n]).all(axis=1)
                if same.any():
                    text = int(np.searchsorted(ends, a, "right"))
                    first = a - int(ends[text - 1] if text else 0)
                    yield text, first, first + n, np.unique(of[near[same]])


def _hashes(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the ``n`` word numbers from each place on."""
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = (out ^ (words[at + k].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _one_at_a_time(slices: list[Broadcast]) -> Iterator[Windows]:
    """The slices in turn; of several, each is let go before the next is loaded."""
    for s in slices:
        yield s.value if len(slices) == 1 else s.load_from_path(s._path)


def _gathered(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of together about ``GATHERED`` bytes."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or b"")
        if size > GATHERED or k == len(texts) - 1:
            yield start, k + 1
            start, size = k + 1, 0


def _scan(slices: list[Broadcast]):
    """Adds words, hits and items to each row and drops its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("__text").to_pylist()
            for a, b in _gathered(whole):
                words = [tokens(t) for t in whole[a:b]]
                spans: list[list[tuple[int, int]]] = [[] for _ in words]
                items: list[set[str]] = [set() for _ in words]
                for table in _one_at_a_time(slices):
                    for text, first, end, of in table.hits(words):
                        spans[text].append((first, end))
                        items[text].update(table.names[i] for i in of.tolist())
                new = [
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([[x for ab in _merged(s) for x in ab] for s in spans], pa.list_(pa.int32())),
                    pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                ]
                part = batch.slice(a, b - a)
                names = [c for c in batch.schema.names if c != "__text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *new], names=[*names, "n_words", "spans", "items"])

    return run


def window_blocks(benchmark: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item`` (id as string), ``place``, ``windows``, ``size`` (words of a window) and ``words`` of blocks of windows."""
    with_python(benchmark.sparkSession)
    rows = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_item_blocks(width), "item string, place long, windows long, size int, words binary").distinct()


def sliced(blocks: DataFrame) -> tuple[DataFrame, int]:
    """The blocks with their ``slice``, and the number of slices; none has more than ``SLICE`` windows (or a single block)."""
    size = blocks.agg(F.sum("windows")).first()[0] or 0
    slices = max(1, -(-size // SLICE))
    if slices == 1:
        return blocks.withColumn("slice", F.lit(0)), 1
    blocks = durable(blocks)
    while True:
        dealt = blocks.withColumn("slice", F.pmod(F.xxhash64("item", "place", "words"), F.lit(slices)))
        most = dealt.groupBy("slice").agg(F.sum("windows").alias("n"), F.count("*").alias("k")).where(f"n > {SLICE} AND k > 1")
        if most.isEmpty():
            return dealt, slices
        slices += -(-slices // 8)


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document row: id, the ``carry`` columns, ``n_words``, ``spans`` (word ranges hit, start and end in turn), ``items`` (ids, as strings).

    Names ``n_words``, ``spans`` and ``items`` are taken by the result.
    """
    spark = with_python(docs.sparkSession)
    blocks, slices = sliced(window_blocks(benchmark, width))
    tables = []
    for k in range(slices):
        mine = blocks.where(F.col("slice") == k).select("item", "size", "words").collect()
        tables.append(spark.sparkContext.broadcast(Windows([(r["item"], r["size"], r["words"]) for r in mine])))
    rows = docs.select(id_col, *carry, F.col(text_col).cast("binary").alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])
    return rows.mapInArrow(_scan(tables), schema)


def hit_words(spans: str = "spans") -> Column:
    """Number of words inside the spans, overlaps counted once."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(spans) - 2, F.lit(2)), lambda i: F.struct(F.col(spans)[i].alias("a"), F.col(spans)[i + 1].alias("b"))))
    total = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(F.greatest(acc["end"], p["b"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), p["b"] - F.greatest(acc["end"], p["a"]))).alias("n")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(spans) > 0, total).otherwise(F.lit(0).cast("long"))


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit") -> Column:
    return (F.col(n_hit) > 0) & (F.col(n_hit) * SHARE >= F.col(n_words))
