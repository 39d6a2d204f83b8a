"""Quality classifier by Bradley-Terry pairwise ranking.

A text's score is linear in its features. The weights minimise the mean logistic loss
over all preference pairs (every labelled text marked good with every one marked bad;
one row per id: the one whose text has the least hash). Pairs are not formed: a pair's
loss depends on the difference of two worths, so each Newton step shares every text
between the two nearest points of a grid of worths (``STEP`` apart), sums counts and
features per mark and point, and folds the sums of one mark with those of the other. A
pair's chance is right within ``STEP ** 2 / 40``. The driver gets one row per mark and
point. The cut is the exact score quantile at the share of bad marks among all training
labels; scores are given as a logistic value that is ``THRESHOLD`` at the cut.

Features come from the text alone and read the whole of it.

Results for odd input: null and empty texts have all features zero and get a score
like any other; ids whose labels contradict each other, null labels and labels
without a text are not learned from; if one of the two marks is missing, every
text scores ``THRESHOLD``; repeated rows are scored each on its own; columns beside
id and text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, with_python

STEP = 1 / 64
ROUNDS = 50
PARTS = 1024  # steps that a range of worths is split into on the way to the cut
PAIRS = 100_000
SEED = 42
THRESHOLD = 0.3
RIDGE = 1e-3

SYMBOLS = b"#*$%&|<>"
CLOSERS = (b".", b"!", b"?", b":", b";", b'"', b")")
FEATURES = (
    "words bytes word_length symbols bangs capitals digits beyond_ascii points stutter repeated_words repeated_pairs most_common"
    " repeated_lines open_lines line_length bad_words very_short short"
).split()

_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_HIGH = bytes(range(128, 256))


def _count(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def features(text: bytes | None) -> np.ndarray:
    """The features of a UTF-8 text, in the order of ``FEATURES``."""
    out = np.zeros(len(FEATURES))
    words = (text or b"").split()
    if not words:
        return out
    n = len(words)
    upper, lower = _count(text, _UPPER), _count(text, _LOWER)
    pairs = list(zip(words, words[1:], strict=False))
    again = sum(a == b for a, b in pairs)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x.strip() for x in text.split(b"\n") if x.strip()]
    bad = 0
    for line in lines:
        in_line = line.split()
        m = len(in_line)
        odd = 10 * _count(line, SYMBOLS) > 3 * m or 2 * line.count(b"!") > m or 2 * sum(a == b for a, b in zip(in_line, in_line[1:], strict=False)) > m
        bad += m if odd else 0
    out[:] = (
        np.log1p(n),
        np.log1p(len(text)),
        min(20.0, sum(map(len, words)) / n) / 10,
        min(3.0, _count(text, SYMBOLS) / n),
        min(2.0, text.count(b"!") / n),
        upper / max(1, upper + lower),
        _count(text, _DIGIT) / len(text),
        _count(text, _HIGH) / len(text),
        min(1.0, _count(text, b".,;:?") / n),
        again / n,
        1 - len(counts) / n,
        1 - len(set(pairs)) / max(1, len(pairs)),
        max(counts.values()) / n,
        1 - len(set(lines)) / len(lines),
        sum(not x.endswith(CLOSERS) for x in lines) / len(lines),
        np.log1p(n / len(lines)),
        bad / n,
        float(n < 20),
        float(n < 50),
    )
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t).tolist() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hash"), pa.array(rows, pa.list_(pa.float64()))], names=["id", "hash", "x"])


class Ranker:
    """Feature scale, weights, and the cut."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float) -> None:
        self.mean, self.scale, self.weights, self.cut = mean, scale, weights, cut

    def worth(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.worth(x) - self.cut, -30, 30) + np.log(THRESHOLD / (1 - THRESHOLD))
        return np.where(self.worth(x) >= self.cut, np.maximum(1 / (1 + np.exp(-z)), THRESHOLD), np.minimum(1 / (1 + np.exp(-z)), np.nextafter(THRESHOLD, 0)))


def fit(good: np.ndarray, bad: np.ndarray, bad_share: float, pairs: int = PAIRS, seed: int = SEED) -> Ranker:
    """The ranker of two small sets in memory, from ``pairs`` drawn with a seed; ``fit_all`` is that of all pairs."""
    d = len(FEATURES)
    if not len(good) or not len(bad):
        return Ranker(np.zeros(d), np.ones(d), np.zeros(d), 0.0)
    both = np.concatenate([good, bad])
    mean, scale = both.mean(axis=0), np.maximum(both.std(axis=0), 1e-6)
    rng = np.random.default_rng(seed)
    n = min(pairs, len(good) * len(bad))
    diff = (good[rng.integers(len(good), size=n)] - bad[rng.integers(len(bad), size=n)]) / scale
    w = np.zeros(d)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))  # chance that the pair is ordered wrongly
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / n + RIDGE * np.eye(d), diff.T @ p / n - RIDGE * w)
        w += step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    ranker = Ranker(mean, scale, w, 0.0)
    # The sample has other shares of the marks than the table; each side weighs as there.
    worth = np.concatenate([ranker.worth(good), ranker.worth(bad)])
    weight = np.concatenate([np.full(len(good), (1 - bad_share) / len(good)), np.full(len(bad), bad_share / len(bad))])
    order = np.argsort(worth)
    at = int(np.searchsorted(np.cumsum(weight[order]), bad_share - 1e-9))
    # Between the last score below the quantile and the next.
    ranker.cut = float(worth[order[[min(at, len(order) - 1), min(at + 1, len(order) - 1)]]].mean())
    return ranker


def _sums(mean: np.ndarray, scale: np.ndarray, w: np.ndarray):
    """Per mark and grid point: number of texts and sum of their scaled features, a text shared between the two points around its worth."""
    names = ["n", *FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mark, z in _scaled(batches, mean, scale):
            at = z @ w / STEP
            low = np.floor(at)
            share = np.concatenate([low + 1 - at, at - low])
            keys, place = np.unique(np.stack([np.concatenate([mark, mark]), np.concatenate([low, low + 1])]), axis=1, return_inverse=True)
            values = np.zeros((keys.shape[1], len(names)))
            ones = np.concatenate([np.ones((len(z), 1)), z], axis=1)
            np.add.at(values, place.ravel(), np.concatenate([ones, ones]) * share[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(keys[0].astype("int32")), pa.array(keys[1].astype("int64")), *(pa.array(v) for v in values.T)], names=["mark", "point", *names])

    return run, "mark int, point bigint, " + ", ".join(f"`{n}` double" for n in names)


def _scaled(batches: Iterator[pa.RecordBatch], mean: np.ndarray, scale: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            x = np.array(batch.column("x").to_pylist()).reshape(-1, len(FEATURES))
            yield batch.column("mark").to_numpy(), (x - mean) / scale


def _squares(mean: np.ndarray, scale: np.ndarray, w: np.ndarray, first: int, chances: dict[int, np.ndarray]):
    """Sum over texts of the products of their scaled features, each text weighted by ``chances`` of its mark at its worth."""
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for mark, z in _scaled(batches, mean, scale):
            at = z @ w / STEP - first
            for m, values in chances.items():
                mine = z[mark == m]
                total += (mine * np.interp(at[mark == m], np.arange(len(values)), values)[:, None]).T @ mine
        yield pa.RecordBatch.from_arrays([pa.array(range(d * d), pa.int32()), pa.array(total.ravel())], names=["place", "value"])

    return run, "place int, value double"


def _fold(sums: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """``out[j] = sum over k of sums[k] * kernel(k - j)``; ``kernel`` runs from ``1 - len(sums)`` to ``len(sums) - 1``."""
    m = len(sums)
    size = 1 << (3 * m).bit_length()
    return np.fft.irfft(np.fft.rfft(sums, size) * np.fft.rfft(kernel[::-1], size), size)[m - 1 : 2 * m - 1]


def fit_all(rows: DataFrame, bad_share: float) -> Ranker:
    """Weights by Newton's method on the logistic loss of all pairs of ``rows`` (``mark``, ``x``); the cut at the ``bad_share`` quantile."""
    d = len(FEATURES)
    column = [F.get("x", F.lit(i)) for i in range(d)]
    told = rows.agg(F.count_if(F.col("mark") == 1), F.count_if(F.col("mark") == 0), *map(F.avg, column), *map(F.stddev_pop, column)).first()
    n_good, n_bad = told[0], told[1]
    if not n_good or not n_bad:
        return Ranker(np.zeros(d), np.ones(d), np.zeros(d), 0.0)
    # Sums of doubles differ in their last digits by the order of the rows; the digits kept do not.
    mean, scale = np.round(told[2 : 2 + d], 12), np.maximum(np.round(told[2 + d :], 12), 1e-6)
    pairs = n_good * n_bad
    w = np.zeros(d)
    for _ in range(ROUNDS):
        run, schema = _sums(mean, scale, w)
        points = rows.mapInArrow(run, schema).groupBy("mark", "point").agg(F.sum("n"), *(F.sum(f).alias(f) for f in FEATURES)).collect()
        first = min(r["point"] for r in points)
        sums = {m: np.zeros((max(r["point"] for r in points) - first + 1, 1 + d)) for m in (0, 1)}
        for r in points:
            sums[r["mark"]][r["point"] - first] = r[2:]
        away = np.arange(1 - len(sums[0]), len(sums[0])) * STEP
        wrong = 1 / (1 + np.exp(-np.clip(away, -700, 700)))  # chance that a pair is ordered wrongly, by the bad text's worth less the good one's
        unsure = wrong * (1 - wrong)
        good, bad = _fold(sums[0][:, 0], wrong), _fold(sums[1][:, 0], wrong[::-1])
        gradient = (sums[1][:, 1:].T @ good - sums[0][:, 1:].T @ bad) / pairs - RIDGE * w
        cross = np.stack([sums[1][:, 1:].T @ _fold(sums[0][:, 1 + i], unsure) for i in range(d)], axis=1)
        run, schema = _squares(mean, scale, w, first, {1: _fold(sums[0][:, 0], unsure), 0: _fold(sums[1][:, 0], unsure)})
        squares = np.zeros(d * d)
        for r in rows.mapInArrow(run, schema).groupBy("place").agg(F.sum("value").alias("value")).collect():
            squares[r["place"]] = r["value"]
        step = np.linalg.solve((squares.reshape(d, d) - cross - cross.T) / pairs + RIDGE * np.eye(d), gradient)
        w += step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    ranker = Ranker(mean, scale, np.round(w, 6), 0.0)
    ranker.cut = _cut(rows, ranker, {1: (1 - bad_share) / n_good, 0: bad_share / n_bad}, bad_share)
    return ranker


def _worths(ranker: Ranker):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("mark"), pa.array(ranker.worth(x))], names=["mark", "worth"])

    return run


def _cut(rows: DataFrame, ranker: Ranker, weight: dict[int, float], share: float) -> float:
    """Midway between the least worth up to which the texts weigh ``share``, and the next.

    The range that holds it is split into ``PARTS`` until one value is left.
    """
    worths = durable(rows.mapInArrow(_worths(ranker), "mark int, worth double"))
    low, high = worths.agg(F.min("worth"), F.max("worth")).first()
    before = 0.0
    while True:
        part = F.floor((F.col("worth") - low) / max(high - low, 1e-300) * PARTS)
        inside = worths.where(F.col("worth").between(low, high)).groupBy(part.alias("part"))
        parts = inside.agg(F.count_if(F.col("mark") == 1).alias("good"), F.count_if(F.col("mark") == 0).alias("bad"), F.min("worth").alias("low"), F.max("worth").alias("high")).collect()
        for r in sorted(parts, key=lambda r: r["part"]):
            weighs = weight[1] * r["good"] + weight[0] * r["bad"]
            low, high, last = r["low"], r["high"], weight[0 if r["bad"] else 1]
            if before + weighs >= share - 1e-9:
                break
            before += weighs
        if low == high:
            break
    if before + weighs - last >= share - 1e-9:  # the share ends among equal worths
        return low
    after = worths.where(F.col("worth") > low).agg(F.min("worth")).first()[0]
    return low if after is None else (low + after) / 2


def train(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int | None = None) -> Ranker:
    """The ranker learned from ``labels`` (1 good, 0 bad) of ids that are not ``held_out`` (a condition on ``id``).

    All labelled texts are learned from, unless a caller asks for a ``sample`` of so
    many of each mark, the first by a seeded hash of the id.
    """
    with_python(docs.sparkSession)
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("mark")).where(F.col("mark").isin(0, 1) & F.col("id").isNotNull())
    marks = marks.where(~F.coalesce(held_out, F.lit(False))).groupBy("id").agg(F.min("mark").alias("mark"), F.max("mark").alias("most")).where("mark = most").select("id", "mark")
    counts = {r["mark"]: r["count"] for r in marks.groupBy("mark").count().collect()}
    bad_share = counts.get(0, 0) / max(1, sum(counts.values()))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    if sample is not None:
        marks = marks.where("mark = 1").orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(sample).unionByName(marks.where("mark = 0").orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(sample))
    # Features are made before rows meet labels or other rows of their id, so texts stay where they are.
    featured = texts.where(F.col("id").isNotNull()).select("id", F.xxhash64("text").alias("hash"), "text").mapInArrow(_features, "id bigint, hash bigint, x array<double>")
    rows = featured.groupBy("id").agg(F.min(F.struct("hash", "x")).alias("row")).join(marks, "id").select("mark", "row.x")
    if sample is None:
        return fit_all(durable(rows), bad_share)
    rows = sorted(rows.collect(), key=lambda r: (r["mark"], r["x"]))
    x = {m: np.array([r["x"] for r in rows if r["mark"] == m]).reshape(-1, len(FEATURES)) for m in (0, 1)}
    return fit(x[1], x[0], bad_share)


def _scores(ranker: Ranker):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            x = np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ranker.score(x))], names=["id", "score"])

    return run


def score(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``score`` (0 to 1) of every row."""
    with_python(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_scores(ranker), "id bigint, score double")
