"""Token counts: pieces counted once per distinct pre-token, joined to the
per-document pre-token frequencies and summed. No token ids are made.

1. ``postings``: each task pre-tokenises its texts with the tokenizer's own
   normaliser and pre-tokeniser (once per distinct word of a task) and emits one
   row per block of texts and distinct pre-token: the rows that hold it, as gaps
   between row numbers, a row repeated as often as the pre-token occurs in it.
   So a frequent pre-token is one row per block, however many rows hold it.
2. These are dealt by pre-token. Each distinct pre-token is run through the
   tokenizer's model once, in the task that gets its rows.
3. The piece counts are summed per row number. A row's number is given where its text
   is read, and its id and size go along from there, so the table is read once.

Pre-tokens that are whole vocabulary entries need no shuffle: the table of their
piece counts has at most as many rows as the vocabulary (a fixed size), so every
task holds it and sums them at once.

White space is cut before the library is asked. That changes nothing: its
pre-tokeniser drops white space, and neither it nor its normaliser lets one word
act on the next (tests compare with the library on texts of every script).

Results for odd input: a null or empty text has 0 tokens; special strings of the
tokenizer inside a text are one token each, as the library's default has it;
every row of the table gives one row with the count of its own text, also where
rows share an id or have none; columns beside id and text are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import with_python

BLOCK_BYTES = 16 << 20
KEPT_WORDS = 400_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _special(path: str) -> re.Pattern | None:
    """Pattern of the tokenizer's special strings, which are cut out of a text first."""
    added = sorted((t.content for t in _tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, added))) if added else None


@lru_cache(maxsize=2)
def _known(path: str) -> dict[str, int]:
    """Piece counts of the pre-tokens that are vocabulary entries; one row per entry at most."""
    tok = _tokenizer(path)
    ends = (tok.model.end_of_word_suffix or "") if hasattr(tok.model, "end_of_word_suffix") else ""
    plain = {v[: -len(ends)] for v in tok.get_vocab(with_added_tokens=False) if ends and v.endswith(ends)}
    return {p: len(tok.model.tokenize(p)) for p in plain if p}


def pretokens(tok, special: re.Pattern | None, text: str) -> tuple[list[str], int]:
    """The pre-tokens of a text and the number of special strings in it."""
    parts = special.split(text) if special else [text]
    found: list[str] = []
    for part in parts:
        if part:
            plain = tok.normalizer.normalize_str(part) if tok.normalizer else part
            found += [p for p, _ in tok.pre_tokenizer.pre_tokenize_str(plain)]
    return found, len(parts) - 1


def _word_table(path: str):
    """Look-up of a word: the pieces settled by the vocabulary table, and the other pre-tokens."""
    tok, special, known, seen = _tokenizer(path), _special(path), _known(path), {}

    def look(word: bytes) -> tuple[int, tuple[str, ...]]:
        got = seen.get(word)
        if got is None:
            if len(seen) >= KEPT_WORDS:  # bounded memory; a later word is cut again
                seen.clear()
            found, settled = pretokens(tok, special, word.decode("utf-8", "replace"))
            rest = []
            for p in found:
                n = known.get(p)
                if n is None:
                    rest.append(p)
                else:
                    settled += n
            got = seen[word] = (settled, tuple(rest))
        return got

    return look


POSTING = (("pretoken", pa.string()), ("width", pa.int32()), ("first", pa.int64()), ("gaps", pa.binary()), ("settled", pa.int64()), ("n_bytes", pa.int64()))


def _row(n: int, columns: dict, id_type: pa.DataType) -> pa.RecordBatch:
    """A batch of postings with the given columns, the others null."""
    kinds = dict(POSTING) | {"id": id_type}
    arrays = [columns[k] if isinstance(columns.get(k), pa.Array) else pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in kinds.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(kinds))


def _packed(names: list[str], lengths: np.ndarray, flat: np.ndarray, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The postings of one block: ``flat`` holds the row numbers of each name in turn, in order."""
    if not len(flat):
        return
    starts = np.cumsum(lengths) - lengths
    gaps = np.diff(flat, prepend=0)
    gaps[starts] = 0
    most = np.maximum.reduceat(gaps, starts)
    width = np.select([most < 1 << 8, most < 1 << 16, most < 1 << 32], [1, 2, 4], 8)
    for w in (1, 2, 4, 8):
        pick = np.flatnonzero(width == w)
        for k in range(0, len(pick), 20_000):
            part = pick[k : k + 20_000]
            inside = np.repeat(starts[part], lengths[part]) + _within(lengths[part])
            ends = np.concatenate([[0], np.cumsum(lengths[part])]).astype(np.int32) * np.int32(w)
            blobs = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(gaps[inside].astype(f"<u{w}").tobytes())])
            columns = {"pretoken": [names[i] for i in part], "width": np.full(len(part), w, np.int32), "first": flat[starts[part]], "gaps": blobs}
            yield _row(len(part), columns, id_type)


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given lengths."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def _block(look, numbers: list[int], texts: list[bytes], ids: pa.Array) -> Iterator[pa.RecordBatch]:
    """The postings of a block of texts, and one row per text with what the vocabulary table settled."""
    joined, counts = [], []
    for text in texts:  # one text's words at a time: as objects they take many times the text's bytes
        words = text.split()
        joined.append(b" ".join(words))
        counts.append(len(words))
    sizes = np.array(counts, np.int64)
    data = np.frombuffer(b" ".join(filter(None, joined)) + b" ", np.uint8)
    del joined
    settled = np.zeros(len(texts), np.int64)
    if sizes.any():
        # Words keep the space behind them, so they are neighbours in one byte string.
        ends = np.concatenate([[0], np.flatnonzero(data == 32) + 1]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)]).dictionary_encode()
        word = coded.indices.to_numpy()
        found = [look(w[:-1]) for w in coded.dictionary.to_pylist()]
        doc = np.repeat(np.arange(len(texts)), sizes)
        alone = np.fromiter((n for n, _ in found), np.int64, len(found))
        settled = np.bincount(doc, alone[word], len(texts)).astype(np.int64)
        # The places of each word together, then the words of each pre-token together.
        order = np.argsort(word, kind="stable")
        often = np.bincount(word, minlength=len(found))
        begin = np.cumsum(often) - often
        words_of: dict[str, list[int]] = defaultdict(list)
        for w, (_, rest) in enumerate(found):
            for p in rest:
                words_of[p].append(w)
        pairs = np.fromiter((w for ws in words_of.values() for w in ws), np.int64)
        per_name = np.fromiter(map(len, words_of.values()), np.int64, len(words_of))
        places = order[np.repeat(begin[pairs], often[pairs]) + _within(often[pairs])]
        lengths = np.add.reduceat(often[pairs], np.cumsum(per_name) - per_name) if len(pairs) else np.zeros(0, np.int64)
        rows = np.asarray(numbers, np.int64)[doc[places]]
        of = np.repeat(np.arange(len(lengths)), lengths)
        if ((np.diff(rows) < 0) & (np.diff(of) == 0)).any():
            rows = rows[np.lexsort((rows, of))]
        yield from _packed(list(words_of), lengths, rows, ids.type)
    columns = {"first": numbers, "settled": settled, "n_bytes": [len(t) for t in texts], "id": ids}
    yield _row(len(texts), columns, ids.type)


def _postings(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _word_table(path)
        for batch in batches:
            numbers, texts, start, size = batch.column("row").to_pylist(), [t or b"" for t in batch.column("text").to_pylist()], 0, 0
            for k, text in enumerate(texts):
                size += len(text)
                if size > BLOCK_BYTES or k == len(texts) - 1:
                    yield from _block(look, numbers[start : k + 1], texts[start : k + 1], batch.column("id").slice(start, k + 1 - start))
                    start, size = k + 1, 0

    return run


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = _tokenizer(path).model, {}
        for batch in batches:
            names, widths = batch.column("pretoken").to_pylist(), batch.column("width").to_numpy(zero_copy_only=False)
            first, blobs = np.asarray(batch.column("first")), batch.column("gaps").to_pylist()
            plain = batch.filter(pc.is_null(batch.column("pretoken")))
            if plain.num_rows:
                yield pa.RecordBatch.from_arrays([plain.column(c) for c in ("first", "settled", "id", "n_bytes")], names=["row", "n_tokens", "id", "n_bytes"])
            rows, weights, pieces = [], [], np.zeros(len(names), np.int64)
            for k, p in enumerate(names):
                if p is not None:
                    got = counts.get(p)
                    if got is None:
                        if len(counts) >= KEPT_WORDS:  # bounded memory; a later row is counted again
                            counts.clear()
                        got = counts[p] = len(model.tokenize(p))
                    pieces[k] = got
            for w in (1, 2, 4, 8):
                pick = np.flatnonzero(widths == w)
                if len(pick):
                    mine = [blobs[k] for k in pick]
                    gaps = np.frombuffer(b"".join(mine), f"<u{w}").astype(np.int64)
                    lengths = np.fromiter(map(len, mine), np.int64, len(mine)) // w
                    run_up = np.cumsum(gaps)
                    starts = np.cumsum(lengths) - lengths
                    rows.append(run_up - np.repeat(run_up[starts], lengths) + np.repeat(first[pick], lengths))
                    weights.append(np.repeat(pieces[pick], lengths))
            if rows:
                at_rows, at = np.unique(np.concatenate(rows), return_inverse=True)  # summed before rows leave the task
                total = np.bincount(at, np.concatenate(weights), len(at_rows)).astype(np.int64)
                n = len(at_rows)
                yield pa.RecordBatch.from_arrays([pa.array(at_rows, pa.int64()), pa.array(total, pa.int64()), pa.nulls(n, batch.column("id").type), pa.nulls(n, pa.int64())], names=["row", "n_tokens", "id", "n_bytes"])

    return run


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_bytes`` (UTF-8) and ``n_tokens``, one row per row of ``docs``.

    ``path`` names a ``tokenizers`` JSON file present on every executor, with a
    pre-tokeniser that drops white space. Ids are of any type that has an order.
    """
    spark = with_python(docs.sparkSession)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).withColumn("row", F.monotonically_increasing_id())
    kind = texts.schema["id"].dataType.simpleString()
    postings = texts.mapInArrow(_postings(path), f"pretoken string, width int, first bigint, gaps binary, settled bigint, n_bytes bigint, id {kind}")
    # Rows without a pre-token are dealt by their number, so none pile up.
    key = F.when(F.col("pretoken").isNull(), F.xxhash64("first")).otherwise(F.xxhash64("pretoken"))
    pieces = postings.repartition(partitions, key).mapInArrow(_pieces(path), f"row bigint, n_tokens bigint, id {kind}, n_bytes bigint")
    return pieces.groupBy("row").agg(F.max("id").alias("id"), F.max("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens")).drop("row")
