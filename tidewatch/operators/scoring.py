"""Threat scoring, model choice, probability fallback and alert summaries.

``threat_score = model_prob + ioc_score + centrality_score`` keeps the
reference's operand order so doubles agree bit for bit with the oracle.
Scores are attached by key (``doc_id``), never by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the indicator counts that make the score
IOC_COUNT_COLS = ["num_ips", "num_domains", "num_hashes", "num_cves"]


def binary_decision(prob_col="prob", threshold: float = 0.5) -> F.Column:
    """FLT5: strict ``prob > 0.5`` (argmax over two logits breaks ties to class 0 the same way)."""
    c = F.col(prob_col) if isinstance(prob_col, str) else prob_col
    return (c > F.lit(threshold)).cast("int")


def sigmoid(logit) -> F.Column:
    """SCR6: P(class 1) from one logit."""
    c = F.col(logit) if isinstance(logit, str) else logit
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def softmax_class1(logit0, logit1) -> F.Column:
    """SCR6: P(class 1) from two logits (softmax), numerically stable form."""
    a = F.col(logit0) if isinstance(logit0, str) else logit0
    b = F.col(logit1) if isinstance(logit1, str) else logit1
    return F.lit(1.0) / (F.lit(1.0) + F.exp(a - b))


def vector_prob(col: str = "probability") -> F.Column:
    """SCR6: class-1 probability from a ``pyspark.ml`` probability vector."""
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(F.col(col))[1]


def add_ioc_score(df: DataFrame, weight: float = 0.3) -> DataFrame:
    """SCR1: ``(num_ips + num_domains + num_hashes + num_cves) * weight``; 0.0 when a count is missing."""
    if all(c in df.columns for c in IOC_COUNT_COLS):
        s = (F.col("num_ips") + F.col("num_domains") + F.col("num_hashes") + F.col("num_cves")) * F.lit(weight)
    else:
        s = F.lit(0.0)
    return df.withColumn("ioc_score", s.cast("double"))


def compute_threat_score(docs: DataFrame, probs: DataFrame, centrality: DataFrame | None = None,
                         id_col: str = "doc_id", ioc_weight: float = 0.3,
                         threshold: float = 0.7) -> DataFrame:
    """JOIN7 + SCR1-SCR3 + FLT2.

    ``probs``: ``(doc_id, model_prob)``; ``centrality``: ``(doc_id, centrality_score)``
    (already weighted; absent -> 0).
    """
    d = docs.join(probs.select(id_col, F.col("model_prob").cast("double")), id_col, "left")
    d = add_ioc_score(d, ioc_weight)
    if centrality is not None:
        d = d.join(centrality.select(id_col, "centrality_score"), id_col, "left")
        d = d.withColumn("centrality_score", F.coalesce("centrality_score", F.lit(0.0)))
    else:
        d = d.withColumn("centrality_score", F.lit(0.0))
    d = d.withColumn("threat_score", F.col("model_prob") + F.col("ioc_score") + F.col("centrality_score"))
    return d.withColumn("alert", F.col("threat_score") > F.lit(threshold))


def alerts(scored: DataFrame) -> DataFrame:
    """FLT3."""
    return scored.filter(F.col("alert"))


def alert_total(scored: DataFrame) -> DataFrame:
    """AGG11."""
    return scored.agg(F.coalesce(F.sum(F.col("alert").cast("bigint")), F.lit(0)).alias("total_alerts"))


def alert_examples(scored: DataFrame, n: int = 10, id_col: str = "doc_id") -> DataFrame:
    """LIM2: the first ``n`` alerts by (threat_score desc, doc_id) — a bounded top-n."""
    return (alerts(scored).orderBy(F.col("threat_score").desc(), F.col(id_col))
            .limit(n).select(id_col, "clean_text", "threat_score", "alert"))


def alert_summary(scored: DataFrame, n: int = 10, id_col: str = "doc_id") -> DataFrame:
    """AGG10: one row ``(total_alerts, avg_threat_score, max_threat_score,
    alert_examples ARRAY<STRUCT>)``; empty when there is no alert (SNK3 guard).

    The example list is built from the bounded top-``n`` only.
    """
    a = alerts(scored)
    stats = a.agg(F.count(F.lit(1)).alias("total_alerts"),
                  F.avg("threat_score").alias("avg_threat_score"),
                  F.max("threat_score").alias("max_threat_score"))
    ex = (alert_examples(scored, n, id_col)
          .agg(F.sort_array(F.collect_list(F.struct(
              (-F.col("threat_score")).alias("_o"), F.col(id_col), "clean_text", "threat_score", "alert")))))
    out = stats.withColumn("_ex", ex.scalar()).filter(F.col("total_alerts") > 0)
    return out.withColumn("alert_examples", F.transform(
        "_ex", lambda e: F.struct(e["clean_text"].alias("clean_text"),
                                  e["threat_score"].alias("threat_score"),
                                  e["alert"].alias("alert")))).drop("_ex")


def choose_model(results: DataFrame, preference=("BERT", "CNN"), order_col: str = "seq") -> DataFrame:
    """SCR4: first available model in preference order, else the first result.

    ``results``: ``(model, error, seq)``; available = ``error IS NULL``.
    """
    pref = {m: i for i, m in enumerate(preference)}
    rank = F.lit(len(pref))
    for m, i in reversed(list(pref.items())):
        rank = F.when((F.col("model") == m) & F.col("error").isNull(), F.lit(i)).otherwise(rank)
    return (results.withColumn("_r", rank).orderBy("_r", order_col).limit(1).select("model"))


def probability_with_fallback(docs: DataFrame, scores: DataFrame, preference, seed: int = 42,
                              id_col: str = "doc_id") -> DataFrame:
    """SCR5: ``model_prob`` = first available of the preferred models' scores, else a
    seeded uniform draw from ``md5('{seed}:{id}')``; ``score_source`` names the origin.

    ``scores``: long ``(doc_id, model, prob)``; only the (bounded) preference list is pivoted.
    """
    pref = list(preference)
    wide = (scores.filter(F.col("model").isin(pref)).groupBy(id_col)
            .pivot("model", pref).agg(F.first("prob")))
    d = docs.join(wide, id_col, "left")
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), 1, 8), 16, 10)
         .cast("double") / F.lit(4294967296.0))
    prob = F.coalesce(*[F.col(m) for m in pref], u)
    src = F.lit("random")
    for m in reversed(pref):
        src = F.when(F.col(m).isNotNull(), F.lit(m)).otherwise(src)
    return d.withColumn("model_prob", prob).withColumn("score_source", src).drop(*pref)
