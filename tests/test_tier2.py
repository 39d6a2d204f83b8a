"""Tier 2 contracts: target, splits, metrics against brute force, cleaning, exploration."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from tidemark.operators import metrics as M
from tidemark.operators import outcome as OC
from tidemark.plans import evaluation as EV
from tidemark.plans import modeling as ML


def _brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    wins = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def _brute_ap(rows):
    order = sorted(rows, key=lambda r: -r[1])
    total_pos = sum(y for y, _ in rows)
    ap, i = 0.0, 0
    while i < len(order):
        j = i
        while j < len(order) and order[j][1] == order[i][1]:
            j += 1
        tp = sum(y for y, _ in order[:j])
        pos_here = sum(y for y, _ in order[i:j])
        ap += pos_here / total_pos * tp / j
        i = j
    return ap


def test_auc_and_ap_match_brute_force(spark):
    rng = random.Random(7)
    rows = [(rng.randint(0, 1), round(rng.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, s double")
    m = M.classification_metrics(df, "y", "s", ranges=5).first()
    assert abs(m.roc_auc - _brute_auc(rows)) < 1e-12
    assert abs(m.pr_auc - _brute_ap(rows)) < 1e-12
    assert m.tp + m.fp + m.tn + m.fn == 400


def test_hot_score_is_exact(spark):
    rows = [(1, 0.5)] * 300 + [(0, 0.5)] * 300 + [(1, 0.9)] * 10 + [(0, 0.1)] * 10
    df = spark.createDataFrame(rows, "y int, s double")
    m = M.classification_metrics(df, "y", "s", ranges=3).first()
    assert abs(m.roc_auc - _brute_auc(rows)) < 1e-12


def test_length_of_stay_threshold(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "2024-01-01 12:00:00"), ("2024-01-01", "2024-01-01 11:59:00")], "a string, b string")
    out = OC.length_of_stay(df, "a", "b").collect()
    assert [(r.stay_hours, r.prolonged_stay) for r in out] == [(12.0, True), (11.983333333333333, False)]
    strict = OC.length_of_stay(df, "a", "b", inclusive=False).first()
    assert strict.prolonged_stay is False


def test_split_is_by_group_and_reproducible(spark):
    df = spark.range(0, 5000).select((F.col("id") % 700).alias("patient"), F.col("id"))
    a = ML.assign_split(df, "patient")
    assert ML.split_leakage(a, "patient").first().leaking_groups == 0
    b = ML.assign_split(df, "patient")
    assert a.exceptAll(b).count() == 0
    shares = {r.split: r.share_pct for r in ML.split_report(a).collect()}
    assert set(shares) == {"train", "validation", "test"} and 60 < shares["train"] < 80


def test_permute_column_is_a_permutation(spark):
    df = spark.range(0, 2000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    p = ML.permute_column(df, "v", "k")
    assert sorted(r.v for r in p.collect()) == sorted(r.v for r in df.collect())
    assert p.where(F.col("v") != F.col("k") * 3).count() > 1000


def test_clean_and_report(spark):
    df = spark.createDataFrame(
        [(1, " a  b ", "x"), (2, "a b", "x"), (3, "sin dato", "y"), (4, "c", "z")], "k long, t string, u string"
    )
    cleaned, report = OC.clean(df, "k")
    got = sorted((r.k, r.t, r.u) for r in cleaned.collect())
    assert got == [(1, "a b", "x"), (3, None, "y"), (4, "c", "z")]
    rep = {r.rule: r for r in report.collect()}
    assert rep["trim_text"].cells_changed == 1 and rep["textual_nulls"].cells_changed == 1
    assert rep["exact_duplicates"].rows_after == 3


def test_explore_suppresses_small_groups(spark):
    df = spark.createDataFrame([("a", 1.0)] * 12 + [("b", 2.0)] * 5 + [("c", 2.0)] * 6, "g string, m double")
    out = {r.g: r for r in OC.explore(df, ["g"], ["m"], k_min=10).collect()}
    assert out["a"].rows == 12 and not out["a"].suppressed
    assert out[None].rows == 11 and out[None].suppressed


def test_explore_folds_a_shown_group_if_the_small_ones_are_too_few(spark):
    df = spark.createDataFrame([("a", 1.0)] * 12 + [("b", 2.0)] * 3 + [("c", 1.0)] * 15, "g string, m double")
    out = {r.g: r for r in OC.explore(df, ["g"], ["m"], k_min=10).collect()}
    assert set(out) == {"c", None} and out[None].rows == 15
    assert OC.explore(df.where("g = 'b'"), ["g"], ["m"], k_min=10).count() == 0


def test_baseline_and_compare(spark):
    rng = random.Random(3)
    rows = [(i, rng.random()) for i in range(600)]
    df = spark.createDataFrame([(i, x, int(x + rng.random() * 0.3 > 0.6)) for i, x in rows], "id long, x double, y int")
    split = ML.assign_split(df, "id")
    train, valid = split.where("split = 'train'"), split.where("split = 'validation'")
    base = {(r.model, r.split): r for r in ML.baseline(train, valid, ["x"], "y").collect()}
    assert base[("logistic_regression", "validation")].roc_auc > 0.8
    assert base[("majority", "train")].roc_auc == 0.5
    results, best = ML.compare_models(train, valid, ["x"], "y")
    assert results.count() == 3 and best is not None


def test_evaluate_calibrate_explain_report(spark):
    rng = random.Random(5)
    rows = []
    for i in range(800):
        x = rng.random()
        rows.append((i, x, rng.random(), int(x + rng.random() * 0.3 > 0.65), "a" if i % 2 else "b"))
    df = spark.createDataFrame(rows, "id long, x double, noise double, y int, g string")
    split = ML.assign_split(df, "id")
    train, valid, test = (split.where(f"split = '{s}'") for s in ("train", "validation", "test"))
    _, best = ML.compare_models(train, valid, ["x", "noise"], "y")
    overall, by_group = ML.evaluate_test(best, test, ["x", "noise"], "y", subgroup="g")
    o = overall.first()
    assert o.roc_auc > 0.8 and o.tp + o.fp + o.tn + o.fn == test.count()
    assert {r.subgroup for r in by_group.collect()} == {"a", "b"}
    scored = best.transform(ML._cast(test, ["x", "noise"], "y", "classification")).select("y", ML._p1("probability").alias("score"), "g")
    cal = ML.calibration(scored, "y", "score", bins=5).collect()
    assert sum(r.rows for r in cal) == test.count() and len(cal) <= 5
    effects = ML.subgroup_effects(scored, "g", "y", k_min=1).collect()
    assert {r.g for r in effects} == {"a", "b"}
    imp = {r.feature: r.importance for r in ML.permutation_importance(best, test, ["x", "noise"], "y", "id").collect()}
    assert imp["x"] > imp["noise"]
    metrics = EV.metric_rows({"test": overall, "groups": by_group}, {"groups": "subgroup"})
    told = {r.statement: r.verdict for r in EV.supported([("good", "test", None, "roc_auc", ">", 0.8), ("perfect", "test", None, "fn", "<", 0.0), ("group a", "groups", "a", "recall", ">=", 0.1), ("group z", "groups", "z", "recall", ">=", 0.1)], metrics).collect()}
    assert told == {"good": "kept", "perfect": "refused", "group a": "kept", "group z": "no metric"}
    shares = EV.contributions(test, "id", ["x", "noise"], lambda df: best.transform(df).withColumn("prediction", ML._p1("probability")), {"x": 0.5, "noise": 0.5}, orders=4)
    rows = shares.groupBy("id", "prediction", "base").agg(F.sum("contribution").alias("whole")).collect()
    assert len(rows) == test.count() and all(abs(r.whole - (r.prediction - r.base)) < 1e-9 for r in rows)
    moved = {r.feature: r.mean_absolute for r in EV.contribution_summary(shares).collect()}
    assert moved["x"] > 3 * moved["noise"]


def test_regression_contributions_of_a_linear_model_are_its_terms(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(70)], "id long, a double, b double")
    shares = EV.contributions(df, "id", ["a", "b"], lambda d: d.withColumn("prediction", 2 * F.col("a") - 3 * F.col("b") + 1), {"a": 1.0, "b": 2.0}, orders=3)
    for r in shares.collect():
        x = r.id % 7 if r.feature == "a" else r.id % 5
        assert abs(r.contribution - (2 * (x - 1) if r.feature == "a" else -3 * (x - 2))) < 1e-9


def test_importance_of_regression_features_is_a_rise_in_error(spark):
    df = spark.createDataFrame([(i, float(i % 17), float(i * 7919 % 101), float(3 * (i % 17))) for i in range(400)], "id long, a double, b double, y double")
    model = ML.fit_linear(df, ["a", "b"], "y", task="regression")
    got = {r.feature: r for r in ML.permutation_importance(model, df, ["a", "b"], "y", "id", task="regression").collect()}
    assert got["a"].importance > 5 and abs(got["b"].importance) < 0.1 and got["a"].base < 0.1


def test_poisson_bootstrap_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, rng.randint(0, 1), rng.random()) for i in range(150)]
    df = spark.createDataFrame(rows, "k long, y int, score double")
    weights = {r.k: r.w for r in df.select("k", EV.poisson_weights(F.col("k"), 64).alias("w")).collect()}
    limits = EV.poisson_limits()
    for k, w in weights.items():
        for b in range(64):
            digest = hashlib.sha256(f"42:{k}:{b // 16}".encode()).hexdigest()
            assert w[b] == sum(x <= int(digest[b % 16 * 4 : b % 16 * 4 + 4], 16) for x in limits)
    assert abs(sum(map(sum, weights.values())) / (150 * 64) - 1) < 0.05
    got = {r.replicate: r for r in EV.replicate_metrics(df, "k", "y").collect()}
    for b in (-1, 0, 17, 63):
        drawn = [(y, math.floor(s * EV.STEPS), s >= 0.5) for k, y, s in rows for _ in range(1 if b < 0 else weights[k][b])]
        tp, fp, fn = (sum(y == a and above == c for y, _, above in drawn) for a, c in ((1, True), (0, True), (1, False)))
        assert abs(got[b].recall - tp / (tp + fn)) < 1e-12 and abs(got[b].f1 - 2 * tp / (2 * tp + fp + fn)) < 1e-12
        assert abs(got[b].roc_auc - _brute_auc([(y, s) for y, s, _ in drawn])) < 1e-12
    told = {r.metric: r for r in EV.bootstrap_intervals(df, "k", "y").collect()}
    assert all(r.low <= r.estimate <= r.high and r.replicates == 64 for r in told.values())


def test_cleaning_contract(spark, tmp_path):
    rows = [
        (1, " a  b ", "2024-01-02", "2024-01-01", 5.0),
        (2, "a b", "2024-01-01", "2024-01-03", 5.0),
        (3, "sin dato", "mal", "2024-01-03", 999.0),
        (4, "a b", "2024-01-01", "2024-01-03", 5.0),
        (5, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "k long, t string, start string, end string, v double")
    cleaned, report = OC.clean_to(df, str(tmp_path / "out"), "k", intervals=[("start", "end")], extremes={"v": (0.0, 100.0)})
    got = sorted((tuple(r) for r in cleaned.collect()), key=lambda r: r[0])
    assert got == [(1, "a b", None, None, 5.0), (2, "a b", "2024-01-01", "2024-01-03", 5.0), (3, None, "mal", "2024-01-03", None), (5, None, None, None, None)]
    told = {r.rule: (r.rows_before, r.rows_after, r.cells_changed) for r in report.collect()}
    assert told == {"trim_text": (5, 5, 1), "textual_nulls": (5, 5, 1), "incoherent_interval": (5, 5, 2), "extreme_value": (5, 5, 1), "exact_duplicates": (5, 4, 0)}
