"""Classification and regression metrics over scored rows (tier 2, this repo's own choices).

Threshold metrics are one aggregate. ROC-AUC (Mann-Whitney, ties count half)
and PR-AUC (average precision) need running totals over scores in descending
order. They are computed exactly and distributed: rows are first reduced to
one row per distinct score (map-side combined, so a score shared by a third of
the rows is one row), the distinct scores are put in ranges by literal cut points, each range
gets the totals of the ranges above it (a table with one row per range), and
the running sums inside a range use a window over that range only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.prefix import RANGES, running_totals


def _score_table(scored: DataFrame, label: str, score: str) -> DataFrame:
    y = F.col(label).cast("int")
    return (
        scored.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(score).cast("double").alias("s"))
        .agg(F.sum(y).cast("long").alias("pos"), F.sum(1 - y).cast("long").alias("neg"))
    )


def classification_metrics(
    scored: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5, ranges: int = RANGES
) -> DataFrame:
    """One row: positives, negatives, tp, fp, tn, fn, precision, recall, f1, roc_auc, pr_auc.

    Everything comes from one aggregate over the per-score table: threshold
    counts are sums over scores above or below the threshold.
    """
    table = _score_table(scored, label, score)
    desc = running_totals(table, "s", ["pos", "neg"], descending=True, ranges=ranges)
    pos, neg = F.col("pos"), F.col("neg")
    above = F.col("s") >= F.lit(threshold)
    zero = F.lit(0).cast("long")
    # Positives scored strictly higher than s, and positives/negatives at or above s.
    tp_at = F.col("pos_before") + pos
    fp_at = F.col("neg_before") + neg
    agg = desc.agg(
        F.coalesce(F.sum(pos), zero).alias("positives"),
        F.coalesce(F.sum(neg), zero).alias("negatives"),
        F.coalesce(F.sum(F.when(above, pos)), zero).alias("tp"),
        F.coalesce(F.sum(F.when(above, neg)), zero).alias("fp"),
        F.coalesce(F.sum(F.when(~above, neg)), zero).alias("tn"),
        F.coalesce(F.sum(F.when(~above, pos)), zero).alias("fn"),
        F.sum(neg * (F.col("pos_before") + pos * F.lit(0.5))).alias("_auc_num"),
        F.sum(F.when(pos > 0, pos * tp_at / (tp_at + fp_at))).alias("_ap_num"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return agg.select(
        "positives",
        "negatives",
        "tp",
        "fp",
        "tn",
        "fn",
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.try_divide(F.col("_auc_num"), F.col("positives") * F.col("negatives")).alias("roc_auc"),
        F.try_divide(F.col("_ap_num"), F.col("positives")).alias("pr_auc"),
    )


def regression_metrics(scored: DataFrame, target: str = "target", prediction: str = "prediction") -> DataFrame:
    """One row: rows, mae, rmse, r2 (one aggregate; r2 from sums of squares)."""
    t, p = F.col(target).cast("double"), F.col(prediction).cast("double")
    base = scored.where(t.isNotNull() & p.isNotNull())
    agg = base.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.abs(t - p)).alias("mae"),
        F.sqrt(F.avg((t - p) * (t - p))).alias("rmse"),
        F.sum((t - p) * (t - p)).alias("_sse"),
        F.var_pop(t).alias("_var"),
    )
    return agg.select(
        "rows", "mae", "rmse", (F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_var") * F.col("rows"))).alias("r2")
    )
