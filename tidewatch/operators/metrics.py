"""Evaluation aggregates over long prediction tables.

Input: ``(model, doc_id, y_true, y_pred, y_score)``. Every metric is a
grouped aggregate per model. AUC/ROC/PR need prefix sums over scores;
these run on distinct scores, bucketed: per-bucket totals (at most
``SCORE_BUCKETS`` rows per model) get a running sum, and only rows of the
same bucket are ordered together. No window spans a whole model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCORE_BUCKETS = 128


def _ratio(num, den):
    return F.coalesce(num.cast("double") / F.when(den != 0, den.cast("double")), F.lit(0.0))


def classification_metrics(pred: DataFrame, group: str = "model") -> DataFrame:
    """MET1-MET4: accuracy, precision, recall, F1 (0 on a zero denominator)."""
    y, p = F.col("y_true"), F.col("y_pred")
    tp = F.sum(((y == 1) & (p == 1)).cast("bigint"))
    fp = F.sum(((y == 0) & (p == 1)).cast("bigint"))
    fn = F.sum(((y == 1) & (p == 0)).cast("bigint"))
    agg = pred.groupBy(group).agg(F.avg((y == p).cast("double")).alias("accuracy"),
                                 tp.alias("_tp"), fp.alias("_fp"), fn.alias("_fn"))
    return agg.select(group, "accuracy",
                      _ratio(F.col("_tp"), F.col("_tp") + F.col("_fp")).alias("precision"),
                      _ratio(F.col("_tp"), F.col("_tp") + F.col("_fn")).alias("recall"),
                      _ratio(2 * F.col("_tp"), 2 * F.col("_tp") + F.col("_fp") + F.col("_fn")).alias("f1"))


def score_bucket(s: DataFrame, group: str) -> DataFrame:
    """``_b``: which of SCORE_BUCKETS stretches of about equally many distinct scores a score is in.

    Bounds are approximate quantiles of each group's distinct scores, so scores that crowd at 0
    and 1, or logits outside [0, 1], spread over the window tasks as even ones do.
    """
    at = F.array(*[F.lit(k / SCORE_BUCKETS) for k in range(1, SCORE_BUCKETS)])
    bounds = s.groupBy(group).agg(F.percentile_approx("y_score", at, 10_000).alias("_bounds"))   # one row a model
    return (s.join(F.broadcast(bounds), group)
            .withColumn("_b", F.size(F.filter("_bounds", lambda x: x <= F.col("y_score"))).cast("bigint")).drop("_bounds"))


def _score_table(pred: DataFrame, group: str, descending: bool) -> DataFrame:
    """Distinct scores with counts and strict prefix sums of pos/neg in score order.

    The distinct scores are checkpointed: bounds, totals and rows all read them.
    """
    s = (pred.filter(F.col("y_score").isNotNull())
         .groupBy(group, "y_score")
         .agg(F.sum((F.col("y_true") == 1).cast("bigint")).alias("pos"),
              F.sum((F.col("y_true") != 1).cast("bigint")).alias("neg")).checkpoint())
    b = score_bucket(s, group)
    s = b.withColumn("_b", -F.col("_b") if descending else F.col("_b"))
    bt = s.groupBy(group, "_b").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    wb = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.select(group, "_b", F.coalesce(F.sum("_bp").over(wb), F.lit(0)).alias("_pp"),
                   F.coalesce(F.sum("_bn").over(wb), F.lit(0)).alias("_pn"))
    j = s.join(bt, [group, "_b"])
    order = F.col("y_score").desc() if descending else F.col("y_score").asc()
    wi = Window.partitionBy(group, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (j.withColumn("pos_before", F.col("_pp") + F.coalesce(F.sum("pos").over(wi), F.lit(0)))
             .withColumn("neg_before", F.col("_pn") + F.coalesce(F.sum("neg").over(wi), F.lit(0)))
             .drop("_b", "_pp", "_pn"))


def roc_auc(pred: DataFrame, group: str = "model") -> DataFrame:
    """MET5: exact ROC-AUC with ties at half weight; NULL for a single class.

    AUC = sum_s pos_s * (2 * neg_below_s + neg_s) / (2 * P * N), numerator in
    exact decimal arithmetic, one final division.
    """
    t = _score_table(pred, group, descending=False)
    dec = "decimal(38,0)"
    num = F.sum(F.col("pos").cast(dec) * (2 * F.col("neg_before") + F.col("neg")).cast(dec))
    agg = t.groupBy(group).agg(num.alias("_num"), F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    den = (2 * F.col("_P").cast(dec) * F.col("_N").cast(dec))
    auc = F.when((F.col("_P") > 0) & (F.col("_N") > 0), F.col("_num").cast("double") / den.cast("double"))
    return agg.select(group, auc.alias("roc_auc"))


def roc_points(pred: DataFrame, group: str = "model") -> DataFrame:
    """MET6: ``(threshold, fpr, tpr)`` at every distinct score, high to low."""
    t = _score_table(pred, group, descending=True)
    tot = t.groupBy(group).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    j = t.join(tot, group)
    return j.select(group, F.col("y_score").alias("threshold"),
                    _ratio(F.col("neg_before") + F.col("neg"), F.col("_N")).alias("fpr"),
                    _ratio(F.col("pos_before") + F.col("pos"), F.col("_P")).alias("tpr"))


def pr_points(pred: DataFrame, group: str = "model") -> DataFrame:
    """MET7: ``(threshold, precision, recall)`` at every distinct score, high to low."""
    t = _score_table(pred, group, descending=True)
    tot = t.groupBy(group).agg(F.sum("pos").alias("_P"))
    j = t.join(tot, group)
    tp = F.col("pos_before") + F.col("pos")
    fp = F.col("neg_before") + F.col("neg")
    return j.select(group, F.col("y_score").alias("threshold"),
                    _ratio(tp, tp + fp).alias("precision"), _ratio(tp, F.col("_P")).alias("recall"),
                    F.col("pos"), F.col("_P").alias("positives"))


def pr_auc(pred: DataFrame, group: str = "model") -> DataFrame:
    """MET7: area under the PR step curve (average precision) = sum_s pos_s/P * precision_s."""
    p = pr_points(pred, group)
    return p.groupBy(group).agg(
        F.when(F.max("positives") > 0,
               F.sum(F.col("pos") * F.col("precision")) / F.max("positives")).alias("pr_auc"))


def evaluate(pred: DataFrame, group: str = "model") -> DataFrame:
    """MET1-MET5 per model plus ``error`` (NULL for a successful model)."""
    m = classification_metrics(pred, group).join(roc_auc(pred, group), group, "left")
    return m.withColumn("error", F.lit(None).cast("string"))


def comparison_table(results: DataFrame, group: str = "model") -> DataFrame:
    """MET8: accuracy/precision/recall/F1 per model, failed models skipped."""
    return results.filter(F.col("error").isNull()).select(group, "accuracy", "precision", "recall", "f1")


def confusion_matrix(pred: DataFrame, group: str = "model") -> DataFrame:
    """ADV8."""
    return pred.groupBy(group, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("count"))


def majority_vote(pred: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """ADV5: per document over models, majority of ``y_pred``; tie -> mean prob > 0.5."""
    g = pred.groupBy(id_col).agg(F.sum("y_pred").alias("_s"), F.count(F.lit(1)).alias("_n"),
                                 F.avg("y_score").alias("_p"))
    vote = (F.when(2 * F.col("_s") > F.col("_n"), 1)
             .when(2 * F.col("_s") < F.col("_n"), 0)
             .otherwise((F.col("_p") > 0.5).cast("int")))
    return g.select(id_col, vote.cast("int").alias("y_pred"), F.col("_p").alias("mean_prob"))


def confidence_aggregate(pred: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """ADV6: confidence-weighted probability, weight ``|p - 0.5| * 2`` (all-zero
    weights fall back to the plain mean); ``confidence = max(p, 1 - p)``."""
    w = F.abs(F.col("y_score") - 0.5) * 2
    g = pred.groupBy(id_col).agg(F.sum(w * F.col("y_score")).alias("_wp"), F.sum(w).alias("_w"),
                                 F.avg("y_score").alias("_m"))
    p = F.when(F.col("_w") > 0, F.col("_wp") / F.col("_w")).otherwise(F.col("_m"))
    return g.select(id_col, p.alias("prob")).withColumn(
        "confidence", F.greatest(F.col("prob"), 1 - F.col("prob")))


def false_positive_reduction(pred: DataFrame, id_col: str = "doc_id", group: str = "model") -> DataFrame:
    """ADV9: precision of the majority vote minus each single model's precision."""
    truth = pred.select(id_col, "y_true").distinct()
    ens = majority_vote(pred, id_col).join(truth, id_col) \
        .select(F.lit("ensemble").alias(group), id_col, "y_true", "y_pred")
    ep = classification_metrics(ens, group).select("precision").scalar()   # scalar subquery
    single = classification_metrics(pred, group).select(group, "precision")
    return (single.withColumn("ensemble_precision", ep)
            .withColumn("precision_delta", F.col("ensemble_precision") - F.col("precision")))
