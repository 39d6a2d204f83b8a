"""Filter audit, sharding and importance resampling against brute force, with odd rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import filter_audit, importance, sharding

WORD = "[^\x20\x09-\x0d]+"
BENCH_WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
EMPTY = "doc_id long, text string, source string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def table():
    rng = random.Random(5)
    vocabulary = ["the", "of", "Über", "naïve", "日本", "end.", "a-b", "42", "É"] + [f"w{i}" for i in range(300)]
    texts = [None, "", " \t\n", "$", "SHOUT", "one two", "a\x1cb c\x85d"]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (5, 19, 20, 150, 220, 260, 300, 400)]
    texts += [" ".join(["again and again"] * 90), "LOUD " * 60 + " ".join(f"x{i}" for i in range(250)), " ".join(rng.choice(vocabulary) for _ in range(30_000))]
    rows = [(i, t, f"s{i % 3}" if i % 4 else None, "n") for i, t in enumerate(texts)]
    rows += [(100 + i, texts[12], "s1", "n") for i in range(25)]  # copies
    rows += [(200, texts[11], "", "n"), (11, texts[11], "s9", "n"), (11, texts[11], "s9", "n")]  # repeated ids and rows
    rows += [(None, texts[13], "s1", "n"), (None, "nothing else is like this", "s1", "n"), (None, "nothing else is like this", "s1", "n")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    # "mask", "part" and "group" clash with names that the operators use.
    rows = [(*r, 1, "p", 2) for r in table()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n string, mask int, part string, `group` int").repartition(3)


LABELS = [(10, 1, 0), (11, 1, 1), (11, 0, 0), (12, None, 1), (100, 1, None), (103, 0, 1), (None, 1, 1), (9999, 1, 1), (200, 1, 0)]


def masks():
    first = {}
    for i, t, _, _ in table():
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, source, _ in table():
        t = t or ""
        w = re.findall(WORD, t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": t in first and (i is None or i > first[t]),
        }
        marks = [x for x in LABELS if i is not None and x[0] == i]
        yield source or "", {f for f, bad in fails.items() if bad}, any(x[1] == 1 for x in marks), any(x[2] == 1 for x in marks)


def test_audit_is_what_each_order_removes(spark, docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(docs, labels).collect()}
    rows = list(masks())
    parts = {p for p, *_ in rows}
    assert len(got) == len(parts) * 600
    shapley = collections.Counter()
    want = {}
    for part in parts:
        mine = [r for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left, gone = mine, []
            for step, f in enumerate(order, 1):
                out = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                want[part, order, step] = (len(left), len(out), sum(f in r[1] for r in gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in out), sum(r[3] for r in out))
                shapley[part, f] += len(out)
                gone += out
    for k, r in got.items():
        assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) == want[k], k
        assert r.shapley == shapley[r.part, r.filter_order[r.step - 1]]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_removal_intervals_are_every_order_once(n):
    at = collections.defaultdict(list)
    for mask, step, start, end in filter_audit.removal_intervals(n):
        for rank in range(start, end):
            at[mask, rank].append(step)
    orders = list(itertools.permutations(range(n)))
    for mask in range(1, 1 << n):
        for rank, order in enumerate(orders):
            assert at[mask, rank] == [next(k for k, f in enumerate(order, 1) if mask >> f & 1)]


def least_capacity(sizes, shards):
    """Smallest capacity of a division into runs, by dynamic programming."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    best = upto.copy()
    for _ in range(shards - 1):
        best = np.array([0, *(min(max(best[j], upto[i] - upto[j]) for j in range(i)) for i in range(1, len(upto)))])
    return int(best[-1])


def test_search_is_the_least_capacity_at_every_coarseness():
    for seed in range(40):
        rng = random.Random(seed)
        groups = sorted((rng.getrandbits(64) - (1 << 63), rng.choice([1, 5, 20, int(rng.paretovariate(1.2)) + 1])) for _ in range(rng.randint(1, 60)))
        shards = rng.randint(1, 9)

        def cells(bits, groups=groups):
            held = collections.defaultdict(lambda: [0, 0])
            for h, s in groups:
                cell = held[h >> (64 - bits) << (64 - bits)]
                cell[0] += s
                cell[1] += 1
            return sharding.Cells(np.array(list(held)), np.full(len(held), bits), np.array([c[0] for c in held.values()]), np.array([c[1] for c in held.values()]))

        want = least_capacity([s for _, s in groups], shards)
        for bits in (1, 3, 6, 64):
            low, high, open_cells = sharding.search(cells(bits), shards)
            assert low <= want <= high
            if not open_cells.any():
                assert low == high == want


def test_cut_points_refine_to_the_least_capacity(spark):
    rng = random.Random(1)
    # Hashes that agree in many leading bits, so that several levels are needed.
    near = [(k << 3) + rng.getrandbits(2) for k in range(300)]
    groups = sorted({*near, *(rng.getrandbits(64) - (1 << 63) for _ in range(200))})
    rows = [(h, rng.randint(1, 90)) for h in groups]
    cuts = sharding.cut_points(spark.createDataFrame(rows, "group long, size long"), 5)
    assert cuts == sorted(cuts) and len(cuts) == 4
    sums = collections.Counter()
    for h, s in rows:
        sums[sum(c <= h for c in cuts)] += s
    assert max(sums.values()) == least_capacity([s for _, s in rows], 5)


@pytest.mark.parametrize("shards", [1, 4, 40])
def test_shards_keep_groups_and_number_slots(docs, shards):
    plan = sharding.plan_shards(docs, shards)
    rows = sharding.assign(docs, plan).collect()
    assert collections.Counter((r.id, r.text_crc32) for r in rows) == collections.Counter((i, zlib.crc32((t or "").encode())) for i, t, *_ in table())
    sizes = {zlib.crc32((t or "").encode()): len((t or "").encode()) + 16 for _, t, *_ in table()}
    assert all(r["size"] == sizes[r.text_crc32] and 0 <= r.shard < shards for r in rows)
    shard_of, slots, held, group_size = {}, collections.defaultdict(list), collections.Counter(), collections.Counter()
    for r in rows:
        assert shard_of.setdefault(r.text_crc32, r.shard) == r.shard
        slots[r.shard].append(r.slot)
        held[r.shard] += r["size"]
        group_size[r.group, r.text_crc32] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    left, open_shards, alone = sum(held.values()), shards, []
    for (g, _), size in sorted(group_size.items(), key=lambda x: (-x[1], x[0][0])):
        if open_shards == 1 or size * open_shards <= left:
            break
        alone.append(g)
        left, open_shards = left - size, open_shards - 1
    rest = [size for (g, _), size in sorted(group_size.items()) if g not in alone]
    assert plan.alone == alone
    assert max([held[s] for s in range(len(alone), shards)], default=0) == least_capacity(rest, open_shards)
    again = sharding.assign(docs.repartition(5), plan).collect()
    assert sorted((r.id or -1, r.text_crc32, r.shard, r.slot) for r in rows) == sorted((r.id or -1, r.text_crc32, r.shard, r.slot) for r in again)


def test_rows_alike_get_slots_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 7)
    docs = spark.createDataFrame([(1, "hot")] * 30 + [(k, f"t{k}") for k in range(40)], "doc_id long, text string")
    rows = sharding.assign(docs, sharding.plan_shards(docs, 3)).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == 70 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_written_shards_hold_every_row(spark, docs, tmp_path):
    plan = sharding.plan_shards(docs, 4)
    sharding.write_shards(docs, plan, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    want = collections.Counter((r.id, r.shard) for r in sharding.assign(docs, plan).collect())
    assert collections.Counter((r.doc_id, r.shard) for r in back.select("doc_id", "shard").collect()) == want
    assert set(back.columns) == {*docs.columns, "shard"}


def grams(t):
    w = re.findall(BENCH_WORD, lower(t or ""))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10_000


def test_crc_matrices():
    rng = random.Random(8)
    words = ["".join(rng.choice("abé日9") for _ in range(rng.randint(1, 60))).encode() for _ in range(500)] + [b"x" * 5000]
    data = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.array([len(w) for w in words])
    starts = np.cumsum(lengths) - lengths
    assert importance.buckets_of(data, starts, lengths).tolist() == [zlib.crc32(w) % 10_000 for w in words]


@pytest.mark.parametrize("piece", [importance.PIECE, 7])
def test_batch_features_hold_every_gram(monkeypatch, piece):
    monkeypatch.setattr(importance, "PIECE", piece)
    texts = [t for _, t, *_ in table()][:17]
    words, found = importance.batch_features([None if t is None else t.encode() for t in texts])
    got = collections.defaultdict(collections.Counter)
    for doc, buckets in found:
        for d, b in zip(doc.tolist(), buckets.tolist(), strict=True):
            got[d][b] += 1
    for k, t in enumerate(texts):
        n, features = grams(t)
        assert words[k] == n and got[k] == collections.Counter(map(bucket, features))


def test_resampling(spark, docs):
    target = spark.createDataFrame([("w1 w2 w3 The of", 1), (None, 2), ("w4 日本 w5", 3), ("!!", 4)], "text string, item_id int")
    rows = importance.resample(docs, target).collect()
    raw, aim = collections.Counter(), collections.Counter()
    for _, t, *_ in table():
        raw.update(map(bucket, grams(t)[1]))
    for t in ("w1 w2 w3 The of", "w4 日本 w5"):
        aim.update(map(bucket, grams(t)[1]))
    s_all, t_all = sum(raw.values()), sum(aim.values())
    want, words = [], {}
    for i, t, *_ in table():
        n, features = grams(t)
        weight = sum(math.floor(1000 * math.log((aim[b] + 1) * (s_all + 10_000) / ((raw[b] + 1) * (t_all + 10_000)))) for b in map(bucket, features))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        want.append((i, len(features), weight, score))
        words[want[-1]] = n
    may = sorted((w for w in want if words[w] >= 20), key=lambda w: (-w[3], w[0] is None, w[0] or 0))
    drawn = may[: 5 * len(may) // 100]
    assert len(drawn) >= 1
    ranked = collections.Counter((*w, k) for k, w in enumerate(drawn, 1)) + collections.Counter((*w, None) for w in (collections.Counter(want) - collections.Counter(drawn)).elements())
    assert collections.Counter((r.id, r.n_features, r.weight, r.score, r["rank"]) for r in rows) == ranked


def test_draw_ranks_ties_and_rows_alike(spark):
    rows = [(i % 50, 30, 9, 5 * (i % 3)) for i in range(900)] + [(None, 30, 9, 100), (7, 19, 1, 99999)]
    weighed = spark.createDataFrame(rows, "id long, n_words long, n_features long, weight long")
    got = importance.draw(weighed, percent=40).collect()
    assert len(got) == 902 and all(r["rank"] is None for r in got if r.weight == 99999)
    may = sorted((r for r in got if r.weight != 99999), key=lambda r: (-r.score, r.id is None, r.id or 0))
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert ranks == list(range(1, 40 * 901 // 100 + 1))
    by_rank = {r["rank"]: (r.score, r.id) for r in got if r["rank"]}
    assert [by_rank[k] for k in ranks] == [(r.score, r.id) for r in may[: len(ranks)]]


def test_empty_tables_of_all_three(spark):
    none = spark.createDataFrame([], EMPTY)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, labels).count() == 0
    assert sharding.assign(none, sharding.plan_shards(none, 4)).count() == 0
    assert importance.resample(none, none).count() == 0
    some = spark.createDataFrame([(1, "a b", "s")], EMPTY)
    assert filter_audit.audit(some, labels).agg(F.sum("removed")).first()[0] == 5 * 24 * 1
    row = importance.resample(some, none).first()
    assert (row.n_features, row["rank"]) == (3, None) and row.weight == 3 * math.floor(1000 * math.log((10_000 + 3) / (2 * 10_000)))
