"""Target-distribution importance resampling over hashed n-grams.

Features of a text are all runs of one to ``LONGEST`` consecutive words (letters,
digits and all characters beyond ASCII, A-Z lower-cased), joined by one space,
repeats counted. A feature's bucket is the CRC-32 of its bytes modulo ``BUCKETS``.
From the features per bucket in the raw and in the target texts comes a gain per
bucket; a document's weight is the sum of its features' gains. Seeded Gumbel noise
is added to the weight, and the documents with the highest sums are drawn, which is
sampling without repetition in proportion to the importance weights.

Buckets are computed for many features at once (``buckets_of``): the texts of a
batch are laid out as one byte string with single spaces, words get numbers, runs of
words get keys, and each distinct feature is looked at once. Distinct features of
equal length form a two-dimensional byte array, whose rows' checksums are all updated
column by column; the buckets are then scattered back to all occurrences. A very
long text is worked on in pieces of ``PIECE`` words that overlap by two.

What reaches the driver: two sums per bucket, and ranges of scores with their row
counts. Ranks are numbered inside ranges of scores, whose cut points only steer how
many rows are ordered together: offsets come from counts.

Results for odd input: null and empty texts have no features, weight 0 and no rank;
a null id hashes like an empty one and comes last among equal scores; repeated rows
get a rank each; with an empty target all gains follow from its zero counts; an
empty table gives no rows; columns beside id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import durable, with_python

BUCKETS = 10_000
LONGEST = 3
PIECE = 1 << 19
SEED = 42
#: Fewest words of a document that may be drawn, and the share of those drawn, in percent.
LEAST_WORDS = 20
PERCENT = 5
SCALE = 1000
#: Ranges of scores that the drawn rows are ordered in, about.
RANGES = 256

# Fixed value: the reversed polynomial of CRC-32 (ISO-HDLC).
POLYNOMIAL = 0xEDB88320
# Every byte outside [0-9a-z\x80-\xff] separates words; A-Z become a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _crc_table() -> np.ndarray:
    rest = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rest = np.where(rest & 1, rest >> 1 ^ np.uint32(POLYNOMIAL), rest >> 1)
    return rest.astype(np.uint32)


_CRC = _crc_table()


def crc32_rows(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a two-dimensional ``uint8`` array, column by column."""
    crc = np.full(len(matrix), 0xFFFFFFFF, np.uint32)
    for column in matrix.T:
        crc = _CRC[(crc ^ column) & 0xFF] ^ (crc >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


def buckets_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of each feature, given as start and length in ``data``, through matrices of equal length."""
    out = np.empty(len(starts), np.int32)
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
    for a, b in zip(edges, edges[1:], strict=False):
        length = int(lengths[order[a]])
        step = max(1, (8 << 20) // max(1, length))  # a matrix has at most 8 MB
        for k in range(a, b, step):
            rows = order[k : min(k + step, b)]
            out[rows] = crc32_rows(data[starts[rows, None] + np.arange(length)]) % np.uint32(buckets)
    return out


def _features(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, first: int, last: int, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Document and bucket of all features that start at words ``first`` to ``last - 1``, by number of words."""
    end = min(len(doc), last + longest - 1)
    base = int(offsets[first])
    # Words keep the space behind them, so they are neighbours in the byte string.
    cut = pa.Array.from_buffers(pa.binary(), end - first, [None, pa.py_buffer((offsets[first : end + 1] - base).astype(np.int32)), pa.py_buffer(data[base : offsets[end]])])
    word = cut.dictionary_encode().indices.to_numpy().astype(np.int64)
    vocabulary = int(word.max()) + 1
    key = word
    for n in range(1, longest + 1):
        at = np.arange(min(last, len(doc) - n + 1) - first)
        at = at[doc[first + at] == doc[first + at + n - 1]]
        if n > 1:
            # The key of n words is that of n - 1 words (numbered from zero) and the last word.
            key = pd.factorize(key)[0][: len(word) - n + 1] * vocabulary + word[n - 1 :]
        if not len(at):
            continue
        codes, _ = pd.factorize(key[at])
        once = np.empty(int(codes.max()) + 1, np.int64)
        once[codes[::-1]] = at[::-1]  # first place of each distinct feature
        begin = offsets[first + once]
        found = buckets_of(data, begin, offsets[first + once + n] - begin - 1, buckets)
        yield doc[first + at], found[codes]


def batch_features(texts: list[bytes | None], longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Words per text, and document and bucket arrays that together hold every feature of the texts."""
    split = [(t or b"").translate(_TABLE).split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    joined = b" ".join(b" ".join(w) for w in split if w) + b" "
    del split
    data = np.frombuffer(joined, np.uint8)
    offsets = np.concatenate([[0], np.flatnonzero(data == 32) + 1]).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)

    def pieces() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for first in range(0, len(doc), PIECE):
            yield from _features(data, offsets, doc, first, min(first + PIECE, len(doc)), longest, buckets)

    return counts, pieces()


def _runs(texts: list[bytes | None], most: int = 16 << 20) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of together at most ``most`` bytes; a longer text stands alone."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or b"")
        if size > most and k > start:
            yield start, k
            start, size = k, len(t or b"")
    if texts:
        yield start, len(texts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in _runs(texts):
            for _, found in batch_features(texts[a:b])[1]:
                total += np.bincount(found, minlength=BUCKETS)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])


def bucket_counts(table: DataFrame, text_col: str = "text") -> np.ndarray:
    """Features per bucket over all texts of a table: ``BUCKETS`` numbers."""
    with_python(table.sparkSession)
    rows = table.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(_count, "bucket int, n bigint")
    out = np.zeros(BUCKETS, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row per bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain per bucket: the scaled log ratio of smoothed target and raw shares, rounded down."""
    all_raw, all_target = float(raw.sum()), float(target.sum())
    smooth = float(len(raw))
    of = zip(raw.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(SCALE * math.log((t + 1.0) * (all_raw + smooth) / ((s + 1.0) * (all_target + smooth)))) for s, t in of], np.int64)


def _weigh(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            words, n, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
            for a, b in _runs(texts):
                counts, found = batch_features(texts[a:b])
                words[a:b] = counts
                for doc, bucket in found:
                    n[a:b] += np.bincount(doc, minlength=b - a)
                    # Whole numbers below 2**53 are summed exactly as doubles.
                    weight[a:b] += np.bincount(doc, table[bucket], b - a).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words), pa.array(n), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    return run


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """``id``, ``n_words``, ``n_features`` and ``weight`` of every row of ``docs``."""
    with_python(docs.sparkSession)
    table = gains(bucket_counts(docs, text_col), bucket_counts(target, target_text))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = T.StructType([rows.schema.fields[0], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])
    return rows.mapInArrow(_weigh(table), schema)


def noise(id_: Column, seed: int = SEED) -> Column:
    """Scaled Gumbel noise from a seeded hash of the id, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _cuts(rows: DataFrame, wanted: int) -> list[int]:
    """Scores, falling, that cut about the 1.5 times ``wanted`` best rows into ranges."""
    share = min(1.0, 1.5 * wanted / max(1, rows.count()))
    lowest = rows.agg(F.percentile_approx("score", F.lit(1 - share), 10_000)).first()[0]
    if lowest is None:
        return []
    upper = rows.where(F.col("score") >= lowest)
    found = upper.agg(F.percentile_approx("score", F.array(*(F.lit(k / RANGES) for k in range(RANGES))), 4 * RANGES)).first()[0]
    return sorted(set(found), reverse=True)


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``id``, ``n_features``, ``weight``, ``score`` and ``rank`` (1 best; null if not drawn) of every row."""
    rows = weighed.select("*", (F.col("weight") + noise(F.col("id"), seed)).alias("score"))
    # Rows alike are one row with a count until they are ranked.
    alike = durable(rows.groupBy("id", "n_words", "n_features", "weight", "score").agg(F.count("*").alias("n")))
    may = alike.where(F.col("n_words") >= least_words)
    total = may.agg(F.sum("n")).first()[0] or 0
    wanted = percent * total // 100
    cuts = _cuts(may, wanted)
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col("score"))) if cuts else F.lit(0)
    eligible = F.col("n_words") >= least_words
    ranged = alike.withColumn("range", F.when(eligible, place))
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over one row per range
    totals = ranged.where("range IS NOT NULL").groupBy("range").agg(F.sum("n").alias("rows"))
    offsets = totals.select("range", F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("offset"))
    with_offset = ranged.join(F.broadcast(offsets), "range", "left")
    columns = ["id", "n_features", "weight", "score"]
    inside = Window.partitionBy("range").orderBy(F.desc("score"), F.asc_nulls_last("id"), "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.col("offset") < wanted, F.lit(False))
    first = with_offset.where(reached).select(*columns, "n", (F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + 1).alias("first"))
    taken = F.greatest(F.lit(0), F.least(F.col("n"), F.lit(wanted) - F.col("first") + 1))
    drawn = first.where(taken > 0).select(*columns, F.explode(F.sequence(F.col("first"), F.col("first") + taken - 1)).alias("rank"))
    none = F.lit(None).cast("long").alias("rank")
    beside = first.where(taken < F.col("n")).select(*columns, F.explode(F.sequence(taken + 1, F.col("n"))).alias("rank")).select(*columns, none)
    others = with_offset.where(~reached).select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("rank")).select(*columns, none)
    return drawn.unionByName(beside).unionByName(others)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents drawn so that they resemble ``target``: ``id``, ``n_features``, ``weight``, ``score``, ``rank`` of every row."""
    return draw(weights(docs, target, id_col, text_col))
