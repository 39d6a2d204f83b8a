"""Tier 2: uncertainty of metrics, additive explanations, and statements tied to metrics.

``bootstrap_intervals`` is a Poisson bootstrap: in every replicate a row counts as often
as a Poisson(1) variate says that is read off a hash of its key, so rows (or patients, if
the key names those) are drawn again without any being moved. All replicates are summed
in one aggregate over steps of the score.

``contributions`` explains a prediction by sampled feature orders: along an order the
features of a background row are replaced one by one by the row's own, and a feature's
share is the change of the prediction when it is replaced, averaged over the orders. The
shares of a row add up to its prediction less the background's.

``supported`` keeps a statement if a metric bears it out and refuses it if none does.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import qcol

SEED = 42
REPLICATES = 64
#: Steps of the score that are told apart in a replicate.
STEPS = 1000
#: Replicates that one digest gives a 16-bit variate for.
PER_DIGEST = 16


def poisson_limits() -> list[int]:
    """16-bit limits of the Poisson(1) distribution: a variate is the number of limits at or below a uniform one."""
    upto, out = 0.0, []
    for k in range(9):
        upto += math.exp(-1) / math.factorial(k)
        out.append(math.floor(65_536 * upto))
    return out


def poisson_weights(key: Column, replicates: int = REPLICATES, seed: int = SEED) -> Column:
    """How often a row counts in each replicate: an array of ``replicates`` whole numbers."""
    digests = [F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(str(d))).cast("binary"), 256) for d in range(-(-replicates // PER_DIGEST))]
    limits = F.array(*map(F.lit, poisson_limits()))
    uniform = F.transform(
        F.sequence(F.lit(0), F.lit(replicates - 1)),
        lambda b: F.conv(F.substr(F.get(F.array(*digests), F.floor(b / PER_DIGEST).cast("int")), (b % PER_DIGEST) * 4 + 1, F.lit(4)), 16, 10).cast("int"),
    )
    return F.transform(uniform, lambda u: F.size(F.filter(limits, lambda x: x <= u)))


def replicate_metrics(scored: DataFrame, key: str | Sequence[str], label: str, score: str = "score", threshold: float = 0.5, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """replicate (-1: every row once), precision, recall, f1, roc_auc (of the score in ``STEPS`` steps)."""
    keys = [qcol(k).cast("string") for k in ([key] if isinstance(key, str) else key)]
    rows = scored.where(qcol(label).isNotNull() & qcol(score).isNotNull()).select(
        qcol(label).cast("int").alias("y"),
        F.greatest(F.lit(0), F.least(F.lit(STEPS), F.floor(qcol(score).cast("double") * STEPS))).cast("int").alias("step"),
        (qcol(score).cast("double") >= threshold).alias("above"),
        F.concat(F.array(F.lit(1)), poisson_weights(F.concat_ws("|", *keys), replicates, seed)).alias("w"),
    )
    each = rows.select("y", "step", "above", F.posexplode("w").alias("b", "n")).where("n > 0")
    # At most replicates x steps x 2 rows leave a task.
    table = each.groupBy("b", "step", "above").agg(F.sum(F.col("n") * F.col("y")).alias("pos"), F.sum(F.col("n") * (1 - F.col("y"))).alias("neg"))
    steps = table.groupBy("b", "step").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    below = Window.partitionBy("b").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    ranked = steps.withColumn("beaten", F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg") * 0.5)
    auc = ranked.groupBy("b").agg(F.try_divide(F.sum(F.col("pos") * F.col("beaten")), F.sum("pos") * F.sum("neg")).alias("roc_auc"))
    counts = table.groupBy("b").agg(*(F.coalesce(F.sum(F.when(c, x)), F.lit(0)).alias(n) for n, c, x in (("tp", F.col("above"), F.col("pos")), ("fp", F.col("above"), F.col("neg")), ("fn", ~F.col("above"), F.col("pos")))))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.join(auc, "b").select(
        (F.col("b") - 1).alias("replicate"),
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "roc_auc",
    )


def bootstrap_intervals(scored: DataFrame, key: str | Sequence[str], label: str, score: str = "score", threshold: float = 0.5, replicates: int = REPLICATES, seed: int = SEED, level: float = 0.95) -> DataFrame:
    """metric, estimate, low, high, replicates (those in which the metric exists)."""
    metrics = ("precision", "recall", "f1", "roc_auc")
    each = replicate_metrics(scored, key, label, score, threshold, replicates, seed)
    long = each.select("replicate", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))))
    drawn = F.when(F.col("replicate") >= 0, F.col("value"))
    tail = (1 - level) / 2
    return long.groupBy("metric").agg(  # ``replicates`` values per metric
        F.max(F.when(F.col("replicate") < 0, F.col("value"))).alias("estimate"),
        F.percentile(drawn, F.lit(tail)).alias("low"),
        F.percentile(drawn, F.lit(1 - tail)).alias("high"),
        F.count(drawn).alias("replicates"),
    )


def feature_orders(features: Sequence[str], count: int, seed: int = SEED) -> list[list[str]]:
    """``count`` orders of the features: random ones, each followed by its reverse."""
    import random

    rng, out = random.Random(seed), []
    while len(out) < count:
        order = list(features)
        rng.shuffle(order)
        out += [order, order[::-1]]
    return out[:count]


def contributions(
    df: DataFrame,
    key: str | Sequence[str],
    features: Sequence[str],
    predict: Callable[[DataFrame], DataFrame],
    background: Mapping[str, float],
    orders: int = 4,
    seed: int = SEED,
) -> DataFrame:
    """key..., feature, contribution, prediction, base: the shares of each row's prediction.

    ``predict`` adds a column ``prediction`` to a frame that has the features; it sees
    each row ``orders * (features + 1)`` times, with some features of the background.
    """
    keys = [key] if isinstance(key, str) else list(key)
    ways = [(o, p, order) for o, order in enumerate(feature_orders(features, orders, seed)) for p in range(len(features) + 1)]
    one = [
        F.struct(
            F.lit(o).alias("_order"),
            F.lit(p).alias("_place"),
            F.lit(order[p - 1] if p else None).cast("string").alias("_feature"),
            *((qcol(f).cast("double") if f in order[:p] else F.lit(float(background[f]))).alias(f) for f in features),
        )
        for o, p, order in ways
    ]
    seen = predict(df.select(*(qcol(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.inline(F.array(*one))))
    ks = [f"_k{i}" for i in range(len(keys))]
    before = Window.partitionBy(*ks, "_order").orderBy("_place")
    steps = seen.select(*ks, "_order", "_place", "_feature", "prediction", (F.col("prediction") - F.lag("prediction").over(before)).alias("change"))
    whole = Window.partitionBy(*ks)
    ends = steps.select(
        *ks,
        "_feature",
        "change",
        F.max(F.when(F.col("_place") == len(features), F.col("prediction"))).over(whole).alias("prediction"),
        F.max(F.when(F.col("_place") == 0, F.col("prediction"))).over(whole).alias("base"),
    )
    per = ends.where(F.col("_feature").isNotNull()).groupBy(*ks, "_feature", "prediction", "base").agg(F.avg("change").alias("contribution"))
    return per.select(*(F.col(k).alias(name) for k, name in zip(ks, keys, strict=True)), F.col("_feature").alias("feature"), "contribution", "prediction", "base")


def contribution_summary(explained: DataFrame) -> DataFrame:
    """feature, rows, mean_contribution, mean_absolute: how the features move predictions, over all rows."""
    c = F.col("contribution")
    return explained.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), F.avg(c).alias("mean_contribution"), F.avg(F.abs(c)).alias("mean_absolute"))


def metric_rows(tables: Mapping[str, DataFrame], items: Mapping[str, str] | None = None) -> DataFrame:
    """section, item, metric, value: the numbers of metric tables in long form; ``items`` names a section's item column."""
    items, out = items or {}, None
    for section, table in tables.items():
        item = qcol(items[section]).cast("string") if section in items else F.lit(None).cast("string")
        numbers = [f.name for f in table.schema.fields if f.name != items.get(section) and f.dataType.typeName() in ("integer", "long", "double", "float", "decimal")]
        cells = F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), qcol(n).cast("double").alias("value")) for n in numbers)))
        part = table.select(F.lit(section).alias("section"), item.alias("item"), cells)
        out = part if out is None else out.unionByName(part)
    return out


#: Comparisons that a statement can make.
COMPARES = {
    ">=": lambda a, b: a >= b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    "<": lambda a, b: a < b,
    "=": lambda a, b: a == b,
}


def supported(statements: Sequence[tuple[str, str, str | None, str, str, float]], metrics: DataFrame) -> DataFrame:
    """statement, section, item, metric, compare, bound, value, verdict (kept, refused, or no metric).

    A statement is (text, section, item, metric, comparison, bound): a predicate over one
    row of ``metrics`` (see ``metric_rows``). It is kept if that row is there and satisfies it.
    """
    for text, *_, compare, _ in statements:
        if compare not in COMPARES:
            raise ValueError(f"unknown comparison {compare!r} in {text!r}")
    table = metrics.sparkSession.createDataFrame([tuple(s) for s in statements], "statement string, section string, item string, metric string, compare string, bound double")
    near = F.broadcast(table).alias("s")
    of = metrics.select(F.col("section").alias("_section"), F.col("item").alias("_item"), F.col("metric").alias("_metric"), "value")
    same = (F.col("section") == F.col("_section")) & F.col("item").eqNullSafe(F.col("_item")) & (F.col("metric") == F.col("_metric"))
    wanted = of.join(near, same, "inner").select("statement", "section", "item", "metric", "compare", "bound", "value")
    # Statements without a metric row are told too; there are as many as the caller wrote down.
    joined = table.join(wanted.select("statement", "value"), "statement", "left")
    holds = F.lit(False)
    for name, test in COMPARES.items():
        holds = F.when(F.col("compare") == name, test(F.col("value"), F.col("bound"))).otherwise(holds)
    verdict = F.when(F.col("value").isNull(), "no metric").when(holds, "kept").otherwise("refused")
    return joined.select("statement", "section", "item", "metric", "compare", "bound", "value", verdict.alias("verdict"))
