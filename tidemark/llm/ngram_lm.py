"""Language-model scoring with a sharded Elias-Fano n-gram trie (order 2 or 3).

Model. With c the training counts, N tokens and V distinct tokens,

    P(w)        = (c(w) + 1) / (N + V + 1)
    P(w | v)    = c(v, w) / (c(v) + MU) + MU / (c(v) + MU) * P(w)
    P(w | u, v) = c(u, v, w) / (c(u, v) + MU) + MU / (c(u, v) + MU) * P(w | v)

which add up to one over the vocabulary and one unknown word (Dirichlet
smoothing). The trie holds the first terms and, of order 3, the weights of the
second ones, quantised downwards.

Trie. Tokens are named by 64-bit hashes. Level 1 is the sorted contexts, level 2
each context's successors (``SUCCESSOR`` bytes of their hash), level 3 each pair's
successors, all Elias-Fano coded: low bytes in an array, the rest in a bit vector in
unary, which is the monotone pointer of each node to its successors. A look-up finds
the context, takes its range from two selects and searches the successor inside that
range only, and so on from the pair found. Quantised probabilities lie beside the
levels. The levels of a shard are one memory map, built and queried in the task that
owns the shard.

Flow. The trie is never whole in one place:

1. Word counts are grouped by hash; they give N, V and the few contexts that are
   more than a fair share of a shard (at most ``8 x shards`` of them).
2. Each block of texts sends every shard one packed row: its words and its
   distinct pairs (and what follows them), with their counts in the block's training
   texts. A frequent pair is one entry per block. The pairs of a frequent context are
   dealt to many shards by successor. Blocks grow with the number of shards
   (``ROW_BYTES`` of text each), so there are as many packed rows as the corpus has
   such pieces, however many shards hold the trie.
3. A shard adds the counts up, builds its trie, looks every block's words and
   pairs up and sends each block one packed row with the answers.
4. A block's texts are scored from the answers.

Results for odd input: null and empty texts are one end token; rows without an id
are trained on and scored; repeated rows count and are scored each on its own; an
empty table gives an empty result; columns beside id and text are left out.
"""

from __future__ import annotations

import mmap
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, with_python

MU = 100.0
BLOCK_BYTES = 12 << 20
#: Bytes of text, at least, that a block has for every shard it writes a row to.
ROW_BYTES = 12 << 10
START, END = b" ", b"\n"  # no word is one of these
SUCCESSOR = 5
STEP = 256  # quantised probabilities: steps per decade


# ---- packing -----------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: like bytes of the numbers side by side, then zstd."""
    import zstandard

    plain = [(str(a.dtype), np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()) for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(plain, protocol=5))


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    out = []
    for kind, data in pickle.loads(zstandard.ZstdDecompressor().decompress(blob)):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1))
    return out


def _gaps(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=sorted_values.dtype.type(0))


# ---- the trie ----------------------------------------------------------------


class EliasFano:
    """Sorted distinct unsigned numbers: ``low`` bytes each, the rest in unary.

    Bit vector: for each value of the upper part, a one per number that has it, then
    a zero. So the numbers with upper part u lie between the zeros u-1 and u.
    """

    @staticmethod
    def parts(values: np.ndarray, low: int, uppers: int) -> list[np.ndarray]:
        """The arrays to store: low bytes, bit vector words, zeros before each word."""
        upper = (values >> np.uint64(8 * low)).astype(np.int64)
        bits = np.zeros(-(-(len(values) + uppers + 1) // 64) * 64, np.uint8)
        bits[upper + np.arange(len(values))] = 1
        vector = np.packbits(bits, bitorder="little").view("<u8")
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(vector).astype(np.int64))])
        small = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :low]
        return [np.ascontiguousarray(small).reshape(-1), vector, zeros]

    def __init__(self, small: np.ndarray, vector: np.ndarray, zeros: np.ndarray, low: int) -> None:
        self.small, self.vector, self.zeros, self.low = small.reshape(-1, low), vector, zeros, low
        self.scale = np.uint64(1) << (np.arange(low, dtype=np.uint64) * np.uint64(8))

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero (from 0)."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        left = (k - self.zeros[word]).astype(np.int64)
        free = np.unpackbits((~self.vector[word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return word * 64 + (np.cumsum(free, axis=1, dtype=np.int8) <= left[:, None]).sum(axis=1)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, or -1."""
        out = np.full(len(values), -1, np.int64)
        for k in range(0, len(values), 1 << 18):
            part = values[k : k + (1 << 18)]
            upper = (part >> np.uint64(8 * self.low)).astype(np.int64)
            low = part & np.uint64((1 << 8 * self.low) - 1)
            # The range of this upper part: the context's pointer and the next one's.
            distinct, at = np.unique(upper, return_inverse=True)
            ends = self._zero(distinct) - distinct
            starts = np.where(distinct > 0, self._zero(np.maximum(distinct - 1, 0)) - np.maximum(distinct - 1, 0), 0)
            lo, stop = starts[at], ends[at]
            hi = stop.copy()
            while (lo < hi).any():
                mid = (lo + hi) // 2
                less = (lo < hi) & (self._low(np.minimum(mid, len(self.small) - 1)) < low)
                lo, hi = np.where(less, mid + 1, lo), np.where(less | (lo >= hi), hi, mid)
            inside = lo < stop
            hit = np.zeros(len(part), bool)
            hit[inside] = self._low(lo[inside]) == low[inside]
            out[k : k + len(part)][hit] = lo[hit]
        return out

    def _low(self, at: np.ndarray) -> np.ndarray:
        return (self.small[at].astype(np.uint64) * self.scale).sum(axis=1, dtype=np.uint64)


class Trie:
    """Levels of one shard in one anonymous memory map."""

    CONTEXT_LOW = 6

    def __init__(self, contexts: np.ndarray, pairs: np.ndarray, codes: np.ndarray, rest: np.ndarray | None = None, triples: np.ndarray | None = None, triple_codes: np.ndarray | None = None) -> None:
        """``contexts``: sorted hashes; ``pairs``: sorted (context's rank, successor) keys; ``codes``: of the pairs.

        For order 3 also ``rest`` (codes of the pairs' weights as contexts), ``triples``
        (sorted (pair's rank, successor) keys) and their codes.
        """
        levels = [
            *EliasFano.parts(contexts, self.CONTEXT_LOW, 1 << 8 * (8 - self.CONTEXT_LOW)),
            *EliasFano.parts(pairs, SUCCESSOR, max(1, len(contexts))),
            codes,
        ]
        if triples is not None:
            levels += [*EliasFano.parts(triples, SUCCESSOR, max(1, len(pairs))), triple_codes, rest]
        self.size = sum(-(-a.nbytes // 8) * 8 for a in levels)
        self.memory = mmap.mmap(-1, max(8, self.size))
        views, at = [], 0
        for a in levels:
            self.memory[at : at + a.nbytes] = a.tobytes()
            views.append(np.frombuffer(self.memory, a.dtype, a.size, at))
            at += -(-a.nbytes // 8) * 8
        self.contexts = EliasFano(*views[0:3], low=self.CONTEXT_LOW)
        self.pairs = EliasFano(*views[3:6], low=SUCCESSOR)
        self.codes = views[6]
        if triples is not None:
            self.triples = EliasFano(*views[7:10], low=SUCCESSOR)
            self.triple_codes, self.rest = views[10:12]

    def _below(self, level: EliasFano, parents: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """Place in a level of each successor of its parent's place; -1 if the parent or the successor is not there."""
        out = np.full(len(parents), -1, np.int64)
        known = np.flatnonzero(parents >= 0)
        out[known] = level.find((parents[known].astype(np.uint64) << np.uint64(8 * SUCCESSOR)) | successors[known])
        return out

    def find_pairs(self, contexts: np.ndarray, of: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """Places of pairs; pair k has context ``contexts[of[k]]``."""
        return self._below(self.pairs, self.contexts.find(contexts)[of], successors)

    def look(self, contexts: np.ndarray, of: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """Codes of pairs (0: not in the trie)."""
        return _coded(self.codes, self.find_pairs(contexts, of, successors))

    def look_on(self, pairs: np.ndarray, of: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the pairs' weights, and of triples; triple k goes on from the pair at place ``pairs[of[k]]``."""
        return _coded(self.rest, pairs), _coded(self.triple_codes, self._below(self.triples, pairs[of], successors))


def _coded(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    out = np.zeros(len(places), np.uint16)
    out[places >= 0] = codes[places[places >= 0]]
    return out


def code(p: np.ndarray) -> np.ndarray:
    """Probabilities as steps below one, rounded towards zero probability; 0 is kept for "none"."""
    return np.minimum(np.ceil(-np.log10(p) * STEP - 1e-9), 65_000).astype(np.uint16) + np.uint16(1)


def decode(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** (-(codes.astype(np.float64) - 1) / STEP), 0.0)


# ---- blocks ------------------------------------------------------------------


def _hash(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def _numbered(joined: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The words of all texts in turn as numbers from 2 on, and the distinct words in order of their numbers.

    ``joined`` has each text's words joined by single spaces.
    """
    data = b" ".join(filter(None, joined)) + b" "
    if len(data) == 1:
        return np.zeros(0, np.int64), []
    # Words keep the space behind them, so they are neighbours in one byte string.
    flat = np.frombuffer(data, np.uint8)
    ends = np.concatenate([[0], np.flatnonzero(flat == 32) + 1]).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)]).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64) + 2, [w[:-1] for w in coded.dictionary.to_pylist()]


class Block:
    """Texts as numbers: ``vocab`` (sorted hashes), ``tokens`` (START, words, END of each text in turn)."""

    def __init__(self, vocab: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, train: np.ndarray) -> None:
        self.vocab, self.tokens, self.lengths, self.train = vocab, tokens, lengths, train

    @classmethod
    def of(cls, texts: list[bytes | None], train: list[bool]) -> Block:
        joined, counts = [], []
        for text in texts:  # one text's words at a time: as objects they take many times the text's bytes
            words = (text or b"").lower().split()
            joined.append(b" ".join(words))
            counts.append(len(words))
        lengths = np.array(counts, np.int64) + 2
        last = np.cumsum(lengths) - 1
        tokens = np.zeros(int(lengths.sum()), np.int64)  # START is number 0, END 1
        tokens[last] = 1
        inside = np.ones(len(tokens), bool)
        inside[last] = inside[last - lengths + 1] = False
        tokens[inside], distinct = _numbered(joined)
        hashes = _hash([START, END, *distinct])
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        return cls(hashes[order], rank[tokens], lengths, np.array(train, bool))

    def token_train(self) -> np.ndarray:
        return np.repeat(self.train, self.lengths)

    def pair_ends(self) -> np.ndarray:
        """Positions of the tokens that are predicted: all but each text's START."""
        first = np.cumsum(self.lengths) - self.lengths
        is_first = np.zeros(len(self.tokens), bool)
        is_first[first] = True
        return np.flatnonzero(~is_first)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens, self.token_train(), len(self.vocab)).astype(np.int64)

    def requests(self, shards: int, hot: tuple[np.ndarray, np.ndarray], length: int = 2) -> tuple[dict, np.ndarray, np.ndarray]:
        """Per shard its words, pairs and triples (indices), and per predicted token the index of its pair and triple (or -1)."""
        at = self.pair_ends()
        ctx, nxt = self.tokens[at - 1].astype(np.int64), self.tokens[at].astype(np.int64)
        keys, of = np.unique(ctx * len(self.vocab) + nxt, return_inverse=True)
        counts = np.bincount(of, self.token_train()[at], len(keys)).astype(np.int64)
        ctx, nxt = keys // len(self.vocab), keys % len(self.vocab)
        home = (self.vocab >> np.uint64(17)) % np.uint64(shards)
        spread = np.ones(len(self.vocab), np.uint64)
        hot_hash, hot_spread = hot
        where = np.searchsorted(self.vocab, hot_hash)
        present = (where < len(self.vocab)) & (self.vocab[np.minimum(where, len(self.vocab) - 1)] == hot_hash)
        spread[where[present]] = hot_spread[present]
        shard = ((home[ctx] + (self.vocab[nxt] >> np.uint64(3)) % spread[ctx]) % np.uint64(shards)).astype(np.int64)
        succ = self.vocab[nxt] & np.uint64((1 << 8 * SUCCESSOR) - 1)
        order = np.lexsort((succ, ctx, shard))
        word_order = np.lexsort((np.arange(len(self.vocab)), home))
        pair_cut = np.searchsorted(shard[order], np.arange(shards + 1))
        word_cut = np.searchsorted(home[word_order], np.arange(shards + 1, dtype=np.uint64))
        triple_order, triple_cut, of_triple = self._triples(at, of, order, pair_cut) if length > 2 else (order[:0], np.zeros(shards + 1, np.int64), np.full(len(at), -1))
        asked = {}
        for s in range(shards):
            p, w = order[pair_cut[s] : pair_cut[s + 1]], word_order[word_cut[s] : word_cut[s + 1]]
            if len(p) or len(w):
                asked[s] = (w, p, triple_order[triple_cut[s] : triple_cut[s + 1]])
        self.pair_ctx, self.pair_succ, self.pair_counts = ctx, succ, counts
        return asked, of, of_triple

    def _triples(self, at: np.ndarray, of: np.ndarray, order: np.ndarray, pair_cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Triples in the order of their first pair in ``order``, where each shard's begin, and per predicted token its triple or -1."""
        on = np.flatnonzero(np.diff(at, prepend=-2) == 1)  # the token before is predicted too
        keys, of_key = np.unique(of[on - 1].astype(np.int64) * len(self.vocab) + self.tokens[at[on]], return_inverse=True)
        self.triple_counts = np.bincount(of_key, self.token_train()[at[on]], len(keys)).astype(np.int64)
        self.triple_pair = keys // len(self.vocab)
        self.triple_succ = self.vocab[keys % len(self.vocab)] & np.uint64((1 << 8 * SUCCESSOR) - 1)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        first = place[self.triple_pair]
        by = np.lexsort((self.triple_succ, first))
        of_triple = np.full(len(at), -1)
        of_triple[on] = of_key
        return by, np.searchsorted(first[by], pair_cut), of_triple

    def following(self, p: np.ndarray, t: np.ndarray) -> list[np.ndarray]:
        """Of a shard's pairs, how many triples go on from each, and those triples' successors and counts."""
        place = np.full(len(self.pair_ctx), -1, np.int64)
        place[p] = np.arange(len(p))
        return [np.bincount(place[self.triple_pair[t]], minlength=len(p)).astype(np.uint32), self.triple_succ[t], self.triple_counts[t].astype(np.uint32)]


SCHEMA = "shard int, block string, answer boolean, data binary"


def _row(rows: list[tuple]) -> pa.RecordBatch:
    shard, block, answer, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(block, pa.string()), pa.array(answer, pa.bool_()), pa.array(data, pa.binary())], names=["shard", "block", "answer", "data"])


def _blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK_BYTES) -> Iterator[tuple[list, Block]]:
    """Ids and numbered texts of the input, some megabytes at a time."""
    ids: list = []
    train: list[bool] = []
    texts: list[bytes | None] = []
    held = 0
    for batch in batches:
        for i, held_out, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            ids.append(i)
            train.append(not held_out)
            texts.append(text)
            held += len(text or b"")
            if held >= size:
                yield ids, Block.of(texts, train)
                ids, train, texts, held = [], [], [], 0
    if ids:
        yield ids, Block.of(texts, train)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, block in _blocks(batches, 4 * BLOCK_BYTES):
        n = block.word_counts()
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(block.vocab[seen].view(np.int64)), pa.array(n[seen])], names=["word", "n"])


def _ask(shards: int, hot, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh64_hexdigest, xxh64_intdigest

        spread = (hot.value[0], hot.value[1])
        for number, (ids, block) in enumerate(_blocks(batches, max(BLOCK_BYTES, shards * ROW_BYTES))):
            asked, _, _ = block.requests(shards, spread, order)
            missing = np.array([i is None for i in ids], bool)
            own = pack(np.array([0 if i is None else i for i in ids], np.int64), missing, block.train, block.lengths, block.tokens, _gaps(block.vocab))
            # The name ties answers to the block's own row. It has the contents' hash, so answers to
            # other contents (a task run again on rows in another order) fail instead of being mixed up.
            name = f"{TaskContext.get().partitionId()}.{number}.{xxh64_hexdigest(own)}"
            rows = [(xxh64_intdigest(name) % shards, name, None, own)]
            counts = block.word_counts()
            for s, (w, p, t) in asked.items():
                ctx, per = np.unique(block.pair_ctx[p], return_counts=True)
                more = block.following(p, t) if order > 2 else []
                rows.append((s, name, False, pack(_gaps(block.vocab[w]), counts[w].astype(np.uint32), _gaps(block.vocab[ctx]), per.astype(np.uint32), block.pair_succ[p], block.pair_counts[p].astype(np.uint32), *more)))
                if len(rows) >= 64:
                    yield _row(rows)
                    rows = []
            if rows:
                yield _row(rows)

    return run


def _answer(hot, mu: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = []
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True))
            own = [r for r in rows if r[2] is None]
            if own:
                yield _row(own)
            asked += [r for r in rows if r[2] is not None]
        if not asked:
            return
        parts = []
        for _, _, _, data in asked:
            words, n, ctx, per, succ, m, *more = unpack(data)
            parts.append((np.cumsum(words, dtype=np.uint64), n.astype(np.int64), np.cumsum(ctx, dtype=np.uint64), per.astype(np.int64), succ, m.astype(np.int64), *more))
        words, of_word = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        totals = np.bincount(of_word, np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64)
        trie = _trie(parts, words, totals, hot.value, mu)
        done = 0
        for (s, name, _, _), (w, _, ctx, per, succ, _, *more) in zip(asked, parts, strict=True):
            own = totals[of_word[done : done + len(w)]]
            done += len(w)
            found = trie.find_pairs(ctx, np.repeat(np.arange(len(ctx)), per), succ)
            on = trie.look_on(found, np.repeat(np.arange(len(succ)), more[0].astype(np.int64)), more[1]) if more else ()
            yield _row([(s, name, True, pack(own.astype(np.uint64), _coded(trie.codes, found), *on))])

    return run


def _trie(parts: list[tuple], words: np.ndarray, totals: np.ndarray, hot: tuple, mu: float) -> Trie:
    """The trie of all pairs that training texts have, from every block's counts."""
    low = np.uint64(8 * SUCCESSOR)
    contexts, of = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
    of_pair = np.repeat(of, np.concatenate([p[3] for p in parts]))
    keys, of_key = np.unique((of_pair.astype(np.uint64) << low) | np.concatenate([p[4] for p in parts]), return_inverse=True)
    counts = np.bincount(of_key, np.concatenate([p[5] for p in parts]), len(keys)).astype(np.int64)
    place = np.cumsum(counts > 0) - 1
    keys, counts = keys[counts > 0], counts[counts > 0]
    # A frequent context's count is known from the word counts; any other is at home here.
    whole = np.zeros(len(contexts), np.int64)
    at = np.minimum(np.searchsorted(words, contexts), max(0, len(words) - 1))
    mine = words[at] == contexts if len(words) else np.zeros(len(contexts), bool)
    whole[mine] = totals[at[mine]]
    hot_hash, _, hot_count = hot
    if len(hot_hash):
        at = np.minimum(np.searchsorted(hot_hash, contexts), len(hot_hash) - 1)
        is_hot = hot_hash[at] == contexts
        whole[is_hot] = hot_count[at[is_hot]]
    p = counts / (whole[(keys >> low).astype(np.int64)] + mu)
    if len(parts[0]) == 6:
        return Trie(contexts, keys, code(p))
    per, succ, n = (np.concatenate([part[k] for part in parts]) for k in (6, 7, 8))
    trained = n > 0  # then the pair has a place of its own
    of_triple = place[np.repeat(of_key, per.astype(np.int64))][trained]
    triples, of_key3 = np.unique((of_triple.astype(np.uint64) << low) | succ[trained], return_inverse=True)
    counts3 = np.bincount(of_key3, n[trained].astype(np.int64), len(triples))
    p3 = counts3 / (counts[(triples >> low).astype(np.int64)] + mu)
    return Trie(contexts, keys, code(p), code(mu / (counts + mu)), triples, code(p3))


def _score(total: int, distinct: int, shards: int, hot, mu: float, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block_scores(own: bytes, answers: dict[int, bytes]) -> pa.RecordBatch:
            ids, missing, train, lengths, tokens, gaps = unpack(own)
            block = Block(np.cumsum(gaps, dtype=np.uint64), tokens, lengths, train)
            asked, of, of_triple = block.requests(shards, (hot.value[0], hot.value[1]), order)
            counts, codes = np.zeros(len(block.vocab), np.int64), np.zeros(len(block.pair_ctx), np.uint16)
            rest, codes3 = np.zeros(len(codes), np.uint16), np.zeros(int(of_triple.max(initial=-1)) + 1, np.uint16)
            for s, (w, p, t) in asked.items():
                got_counts, codes[p], *on = unpack(answers[s])
                counts[w] = got_counts.astype(np.int64)
                if on:
                    rest[p], codes3[t] = on
            at = block.pair_ends()
            text = np.repeat(np.arange(len(ids)), lengths)[at]
            c = counts[tokens[at]]
            p_word = (c + 1) / (total + distinct + 1)
            before = counts[tokens[at - 1]]
            p = decode(codes[of]) + mu / (before + mu) * p_word
            on = np.flatnonzero(of_triple >= 0)
            weight = rest[of[on - 1]]  # of the pair before; a pair that training lacks leaves all to the shorter context
            p[on] = decode(codes3[of_triple[on]]) + np.where(weight > 0, decode(weight), 1.0) * p[on]
            n = len(ids)
            arrays = [
                pa.array(np.ma.array(ids, mask=missing), pa.int64(), from_pandas=True) if not missing.any() else pa.array([None if m else int(i) for i, m in zip(ids, missing, strict=True)], pa.int64()),
                pa.array(~train),
                pa.array(np.bincount(text, minlength=n).astype(np.int64)),
                pa.array(np.bincount(text, c > 0, n).astype(np.int64)),
                pa.array(np.bincount(text, np.log10(p_word), n)),
                pa.array(np.bincount(text, np.log10(p), n)),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

        own, answers, now = None, {}, None
        for batch in batches:  # rows come in order of their block
            for s, name, answer, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if name != now:
                    if own is not None:
                        yield block_scores(own, answers)
                    own, answers, now = None, {}, name
                if answer is None:
                    own = data
                else:
                    answers[s] = data
        if own is not None:
            yield block_scores(own, answers)

    return run


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", mu: float = MU, order: int = 2) -> DataFrame:
    """Per row: ``id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    ``held_out`` says which rows are scored only; all others are learned from. ``order``
    is 2 or 3. Ids are whole numbers.
    """
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = with_python(docs.sparkSession)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = 4 * partitions
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    counts = durable(texts.where(~F.col("held_out")).mapInArrow(_count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    start = int(_hash([START]).view(np.int64)[0])
    tokens = counts.where(F.col("word") != start)
    got = tokens.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    total, distinct = int(got["n"]), int(got["v"])
    share = max(1, total // (8 * shards))
    often = counts.where(F.col("n") > share).orderBy(F.col("n").desc(), "word").limit(16 * shards).collect()  # fewer than 8 x shards words can be so frequent
    hashes = np.array([r["word"] for r in often], np.int64).view(np.uint64)
    by = np.argsort(hashes)
    spread = np.array([min(shards, 1 + r["n"] // share) for r in often], np.uint64)
    hot = spark.sparkContext.broadcast((hashes[by], spread[by], np.array([r["n"] for r in often], np.int64)[by]))
    asked = texts.mapInArrow(_ask(shards, hot, order), SCHEMA).repartition(partitions, "shard")
    answered = asked.mapInArrow(_answer(hot, mu), SCHEMA).repartition(partitions, "block").sortWithinPartitions("block")
    scored = answered.mapInArrow(_score(total, distinct, shards, hot, mu, order), "id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
