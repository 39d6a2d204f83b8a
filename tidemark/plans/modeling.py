"""Tier 2: leak-free splits, baselines, model comparison, evaluation and explanation on MLlib.

The profiled study declares these stages without code; the protocol here is
this repo's own: splits by hashed patient (or by time), every transformer
fitted on train only, selection on train + validation only, one evaluation on
test, explanations reported as aggregates.

Nothing is collected but one-row metrics: splits are a hash of the group key
(no shuffle), calibration uses approximate quantile cut points and a
``groupBy``, and permutation importance permutes a column inside hashed
buckets with bucket-local ``row_number`` windows (no global window).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import qcol
from tidemark.functions.quantiles import quantile_map
from tidemark.operators.metrics import classification_metrics, regression_metrics

SEED = 42
SPLITS = ("train", "validation", "test")
FRACTIONS = (0.70, 0.15, 0.15)


# ---------------------------------------------------------------- L4 split
def assign_split(
    df: DataFrame,
    group: str | Sequence[str],
    seed: int = SEED,
    fractions: Sequence[float] = FRACTIONS,
    split_col: str = "split",
) -> DataFrame:
    """Split by a hash of the group key: a patient never spans two splits; reproducible per seed."""
    groups = [group] if isinstance(group, str) else list(group)
    u = F.pmod(F.xxhash64(F.lit(seed), *[qcol(g) for g in groups]), F.lit(1_000_000)) / F.lit(1_000_000.0)
    a, b = fractions[0], fractions[0] + fractions[1]
    label = F.when(u < a, F.lit(SPLITS[0])).when(u < b, F.lit(SPLITS[1])).otherwise(F.lit(SPLITS[2]))
    return df.withColumn(split_col, label)


def time_split(df: DataFrame, time_col: str, validation_from: str, test_from: str, split_col: str = "split") -> DataFrame:
    """Split by cut instants: before ``validation_from`` train, before ``test_from`` validation, else test."""
    t = qcol(time_col)
    v, s = F.lit(validation_from).cast("timestamp_ntz"), F.lit(test_from).cast("timestamp_ntz")
    return df.withColumn(split_col, F.when(t < v, "train").when(t < s, "validation").otherwise("test"))


def split_report(df: DataFrame, label: str | None = None, split_col: str = "split") -> DataFrame:
    """Rows, share and (when a label is given) positives and positive rate per split."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    if label:
        aggs += [F.sum(qcol(label).cast("long")).alias("positives")]
    g = df.groupBy(split_col).agg(*aggs)
    total = F.sum("rows").over(Window.partitionBy())
    out = g.withColumn("share_pct", F.col("rows") / total * 100.0)
    if label:
        out = out.withColumn("positive_rate", F.col("positives") / F.col("rows"))
    return out


def split_leakage(df: DataFrame, group: str | Sequence[str], split_col: str = "split") -> DataFrame:
    """One row: groups that appear in more than one split (must be 0)."""
    groups = [group] if isinstance(group, str) else list(group)
    per = df.groupBy(*[qcol(g) for g in groups]).agg(F.count_distinct(split_col).alias("_n"))
    return per.agg(F.count_if(F.col("_n") > 1).alias("leaking_groups"))


# ---------------------------------------------------------------- L5 / L6 models
def _features(features: Sequence[str], out: str = "features") -> list:
    imputed = [f"{c}__imp" for c in features]
    return [
        Imputer(inputCols=list(features), outputCols=imputed, strategy="median"),
        VectorAssembler(inputCols=imputed, outputCol=out, handleInvalid="keep"),
    ]


def _cast(df: DataFrame, features: Sequence[str], target: str, task: str) -> DataFrame:
    t = qcol(target).cast("double")
    return df.withColumns({**{c: qcol(c).cast("double") for c in features}, target: t})


def fit_linear(train: DataFrame, features: Sequence[str], target: str, task: str = "classification"):
    """The linear model of ``baseline``, fitted on train with its imputer."""
    kind = LogisticRegression if task == "classification" else LinearRegression
    return Pipeline(stages=[*_features(features), kind(labelCol=target, featuresCol="features")]).fit(_cast(train, features, target, task))


def baseline(
    train: DataFrame,
    validation: DataFrame,
    features: Sequence[str],
    target: str,
    task: str = "classification",
) -> DataFrame:
    """Constant baseline (mean or majority, from train) and a linear model (fitted on train).

    Returns model, split, and metrics for train and validation reported apart.
    """
    train, validation = _cast(train, features, target, task), _cast(validation, features, target, task)
    if task == "classification":
        majority = train.agg(F.avg(target).alias("p")).select((F.col("p") >= 0.5).cast("double")).scalar()
        prior = train.agg(F.avg(target)).scalar()
        model = fit_linear(train, features, target)

        def score(df, name):
            lin = model.transform(df).select(target, _p1("probability").alias("score"))
            # The constant model scores every row with the train prevalence; its label is the majority.
            const = df.select(target, F.when(majority == 1.0, F.lit(1.0)).otherwise(prior).alias("score"))
            m1 = classification_metrics(lin, target, "score").withColumn("model", F.lit("logistic_regression"))
            m0 = classification_metrics(const, target, "score").withColumn("model", F.lit("majority"))
            return m0.unionByName(m1).withColumn("split", F.lit(name))

        return score(train, "train").unionByName(score(validation, "validation"))
    mean = train.agg(F.avg(target)).scalar()
    model = fit_linear(train, features, target, task)

    def score_r(df, name):
        lin = model.transform(df).select(target, F.col("prediction"))
        const = df.select(target, mean.alias("prediction"))
        m1 = regression_metrics(lin, target, "prediction").withColumn("model", F.lit("linear_regression"))
        m0 = regression_metrics(const, target, "prediction").withColumn("model", F.lit("mean"))
        return m0.unionByName(m1).withColumn("split", F.lit(name))

    return score_r(train, "train").unionByName(score_r(validation, "validation"))


def _p1(col: str) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(col))[1]


def compare_models(
    train: DataFrame,
    validation: DataFrame,
    features: Sequence[str],
    target: str,
    task: str = "classification",
    seed: int = SEED,
):
    """Fit candidates on train, score on validation; returns (validation metrics, best fitted pipeline).

    Selection uses ROC-AUC (classification) or RMSE (regression) on validation only.
    """
    train, validation = _cast(train, features, target, task), _cast(validation, features, target, task)
    if task == "classification":
        candidates = {
            "logistic_regression": LogisticRegression(labelCol=target, featuresCol="features"),
            "random_forest": RandomForestClassifier(labelCol=target, featuresCol="features", seed=seed),
            "gradient_boosting": GBTClassifier(labelCol=target, featuresCol="features", seed=seed),
        }
    else:
        candidates = {
            "linear_regression": LinearRegression(labelCol=target, featuresCol="features"),
            "random_forest": RandomForestRegressor(labelCol=target, featuresCol="features", seed=seed),
            "gradient_boosting": GBTRegressor(labelCol=target, featuresCol="features", seed=seed),
        }
    results, fitted = None, {}
    for name, est in candidates.items():
        model = Pipeline(stages=[*_features(features), est]).fit(train)
        fitted[name] = model
        scored = model.transform(validation)
        if task == "classification":
            m = classification_metrics(scored.select(target, _p1("probability").alias("score")), target, "score")
        else:
            m = regression_metrics(scored.select(target, "prediction"), target, "prediction")
        m = m.withColumn("model", F.lit(name))
        results = m if results is None else results.unionByName(m)
    order = F.col("roc_auc").desc() if task == "classification" else F.col("rmse").asc()
    best = results.orderBy(order).select("model").first()["model"]
    return results, fitted[best]


# ---------------------------------------------------------------- L8 evaluation
def calibration(scored: DataFrame, label: str, score: str = "score", bins: int = 10) -> DataFrame:
    """Mean score and observed rate per score bin, cut at exact quantiles."""
    probs = [i / bins for i in range(1, bins)]
    # ``bins - 1`` cut points, used as a literal array.
    cuts = [c for c in quantile_map(scored, {"score": F.col(score)}, probs)["score"] if c is not None]
    edges = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    # Number of cut points at or below the score = its bin (0..bins-1).
    b = F.size(F.filter(edges, lambda c: c <= F.col(score)))
    return scored.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(score).alias("mean_score"), F.avg(qcol(label).cast("double")).alias("observed_rate")
    )


def subgroup_metrics(scored: DataFrame, label: str, subgroup: str, score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Threshold metrics for every subgroup value in one ``groupBy`` (no per-value loop)."""
    y = qcol(label).cast("int")
    pred = (F.col(score) >= F.lit(threshold)).cast("int")
    g = scored.groupBy(qcol(subgroup).cast("string").alias("subgroup")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if((y == 1) & (pred == 1)).alias("tp"),
        F.count_if((y == 0) & (pred == 1)).alias("fp"),
        F.count_if((y == 1) & (pred == 0)).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.select(
        "subgroup",
        "rows",
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def evaluate_test(
    model, test: DataFrame, features: Sequence[str], target: str, subgroup: str | None = None, task: str = "classification"
) -> tuple[DataFrame, DataFrame | None]:
    """One evaluation on test: (overall metrics, per-subgroup threshold metrics or None)."""
    test = _cast(test, features, target, task)
    scored = model.transform(test)
    if task == "classification":
        s = scored.select(target, _p1("probability").alias("score"), *([qcol(subgroup)] if subgroup else []))
        overall = classification_metrics(s, target, "score")
        return overall, subgroup_metrics(s, target, subgroup) if subgroup else None
    s = scored.select(target, "prediction")
    return regression_metrics(s, target, "prediction"), None


# ---------------------------------------------------------------- L9 explanation
HASH_BUCKETS = 4096


def _global_rank(df: DataFrame, seed: int, keys: Sequence[Column]) -> DataFrame:
    """Adds ``_rank``: the row's place in the order of a seeded hash of its key, over the whole table.

    Rows are counted by the leading bits of the hash (``HASH_BUCKETS`` counts), and
    ranked inside each bucket only; a row's bucket follows from its key alone.
    """
    h = F.xxhash64(F.lit(seed), *keys)
    hashed = df.withColumn("_h", h).withColumn("_b", F.shiftrightunsigned(h, 64 - HASH_BUCKETS.bit_length() + 1))
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select("_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_h", *keys))
    return hashed.withColumn("_in", inside).join(F.broadcast(counts), "_b").withColumn("_rank", F.col("_before") + F.col("_in")).drop("_h", "_b", "_in", "_before")


def permute_column(df: DataFrame, column: str, row_key: str | Sequence[str], seed: int = SEED) -> DataFrame:
    """The frame with ``column`` permuted among all rows: two seeded orders of the rows, matched by rank.

    ``row_key`` must tell rows apart. The same rows give the same permutation at any
    size and partitioning.
    """
    keys = [qcol(c) for c in ([row_key] if isinstance(row_key, str) else row_key)]
    rows = _global_rank(df, seed + 1, keys).drop(column)
    values = _global_rank(df, seed + 2, keys).select(qcol(column).alias(column), "_rank")
    return rows.join(values, "_rank").select(*df.columns)


def permutation_importance(
    model, data: DataFrame, features: Sequence[str], target: str, row_key: str | Sequence[str], seed: int = SEED, task: str = "classification"
) -> DataFrame:
    """feature, base, permuted, importance: how much worse the model gets when a feature is permuted.

    The measure is ROC-AUC (its drop) for classification and RMSE (its rise) for
    regression. Aggregate only, not causal.
    """
    data = _cast(data, features, target, task)

    def measure(df: DataFrame) -> Column:
        scored = model.transform(df)
        if task == "classification":
            return classification_metrics(scored.select(target, _p1("probability").alias("score")), target, "score").select("roc_auc").scalar()
        return regression_metrics(scored.select(target, "prediction"), target, "prediction").select("rmse").scalar()

    base = measure(data)
    parts = [
        data.sparkSession.range(1).select(F.lit(f).alias("feature"), base.alias("base"), measure(permute_column(data, f, row_key, seed)).alias("permuted"))
        for f in features
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    worse = F.col("base") - F.col("permuted")
    return out.withColumn("importance", worse if task == "classification" else -worse)


def subgroup_effects(scored: DataFrame, subgroup: str, target: str, score: str = "score", k_min: int = 10) -> DataFrame:
    """Mean score and observed rate per subgroup value.

    Groups under ``k_min`` rows are one row without a name (null); it is left out only
    if all of them together are still under ``k_min``.
    """
    per = scored.groupBy(qcol(subgroup).cast("string").alias(subgroup)).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col(score).cast("double")).alias("s"), F.sum(qcol(target).cast("double")).alias("t"), F.count(score).alias("ns"), F.count(qcol(target)).alias("nt")
    )
    name = F.when(F.col("rows") >= k_min, qcol(subgroup))
    folded = per.groupBy(name.alias(subgroup)).agg(*[F.sum(c).alias(c) for c in ("rows", "s", "t", "ns", "nt")])
    return folded.where(F.col("rows") >= k_min).select(subgroup, "rows", F.try_divide("s", "ns").alias("mean_score"), F.try_divide("t", "nt").alias("observed_rate"))
