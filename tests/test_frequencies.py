"""The hashed frequency table: long texts against short ones, and what is fetched of them."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from tidemark import operators as O
from tidemark.functions.text import fold_value
from tidemark.operators import frequencies as FQ

LONG = "Ünïcode text that is longer than the bound for values that are their own key, " * 3


def values():
    rng = random.Random(2)
    short = ["A", "a", " a", "", "  ", "NA", "n/a", None, "Dos", "dos.", "DÓS"]
    long = [LONG, LONG.upper(), LONG + " ", LONG + "x", "NA" + " " * 300, " " * 200, "tab\there " + "y" * 200]
    return [rng.choice(short + long) for _ in range(400)] + long


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, v, float(i % 3) if i % 2 else None) for i, v in enumerate(values())], "id long, t string, x double").repartition(3)


def test_table_has_every_distinct_value_once(frame):
    fields = [f for f in frame.schema.fields if f.name != "id"]
    freq = FQ.frequencies(frame, fields, {"pattern", "defects", "fold", "equivalent", "class", "date"})
    rows = freq.with_texts(freq.table).collect()
    got = {(fields[r.c].name, r.text): r.n for r in rows}
    want = collections.Counter(("t", v) for v in values() if v is not None)
    want.update(("x", str(float(i % 3))) for i in range(len(values())) if i % 2)
    assert len(rows) == len(got) and got == dict(want)
    for r in rows:
        assert (r.value is None) == (len(r.text.encode()) > FQ.SHORT) and r.length == len(r.text) and r.bytes == len(r.text.encode())
        assert r.head == r.text[: FQ.HEAD]
    folds = collections.defaultdict(set)
    for r in rows:
        if fields[r.c].name == "t":
            folds[fold_value(r.text)].add((r.fold1, r.fold2))
    assert all(len(x) == 1 for x in folds.values()) and len({y for x in folds.values() for y in x}) == len(folds)


def test_no_long_text_is_shuffled(frame):
    plan = FQ.frequencies(frame, [frame.schema["t"]], {"defects"}).table._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan
    grouped = [line for line in plan.splitlines() if "HashAggregate" in line and "partial_first(head" in line or "partial_first(bytes" in line]
    assert grouped and all("partial_first(value" not in line for line in plan.splitlines())


def test_text_checks_on_long_texts(frame):
    texts = [v for v in values() if v is not None]
    r = O.text_problems(frame, "id").first()
    space = " \t\n\x0b\f\r"
    assert r.leading_spaces == sum(v[:1] in space and v != "" for v in texts)
    assert r.trailing_spaces == sum(v[-1:] in space and v != "" for v in texts)
    assert r.only_spaces == sum(v != "" and not v.strip(space) for v in texts)
    assert r.empty_strings == texts.count("")
    groups = collections.defaultdict(set)
    for v in texts:
        groups[fold_value(v)].add(v)
    assert r.spelling_groups == sum(len(g) > 1 for g in groups.values())
    nulls = {x.token: x["count"] for x in O.textual_nulls(frame, "id").collect()}
    assert nulls["NA"] == sum(fold_value(v).upper() == "NA" for v in texts)


def test_categories_with_long_texts(frame):
    texts = collections.Counter(v for v in values() if v is not None)
    ranked = sorted(texts.items(), key=lambda x: (-x[1], x[0].encode()))
    got = sorted((r.rank, r.category, r.frequency) for r in O.category_frequencies(frame, "id", top=20, max_categories=99).collect() if r.column == "t")
    assert got == [(k, *x) for k, x in enumerate(ranked[:20], 1)]
    top = O.category_summary(frame, "id", max_categories=99).where("column = 't'").first()
    assert (top.top_category, top.top_count, top.categories, top.total_rows) == (*ranked[0], len(texts), len(values()))
    keyed = collections.defaultdict(set)
    for v in texts:
        key = "".join(ch for ch in fold_value(v) if not (33 <= ord(ch) <= 126 and not ch.isalnum()))
        if key:
            keyed[key].add(v)
    rows = O.category_variants(frame, "id", max_categories=99).collect()
    assert sorted((r.key, r.variant, r.frequency, r.variant_count) for r in rows) == sorted((k, v, texts[v], len(g)) for k, g in keyed.items() if len(g) > 1 for v in g)
    joined = {r.key: r.variants for r in O.equivalent_categories(frame, "id", max_categories=99).collect()}
    assert joined == {k: " | ".join(sorted(g, key=str.encode)) for k, g in keyed.items() if len(g) > 1}


def test_values_that_agree_in_their_first_characters(spark):
    texts = [("z" * 300) + c for c in "cab"] * 2 + ["z" * FQ.HEAD] * 2
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [(r.rank, r.category) for r in O.category_frequencies(df, top=2).orderBy("rank").collect()]
    assert got == [(1, "z" * FQ.HEAD), (2, "z" * 300 + "a")]


def test_empty_frame(spark):
    none = spark.createDataFrame([], "t string, x long")
    assert FQ.frequencies(none, none.schema.fields).table.count() == 0
    assert [tuple(r) for r in O.column_inventory(none).select("normalized_name", "non_null", "distinct").collect()] == [("t", 0, 0), ("x", 0, 0)]
    assert O.category_variants(none).count() == 0
    assert O.text_problems(none).select(F.sum("empty_strings")).first()[0] == 0
