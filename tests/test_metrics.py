"""Metrics against brute-force definitions."""

import random

from tidewatch.operators import metrics as M


def _pred(spark, rows):
    return spark.createDataFrame(rows, "model STRING, doc_id INT, y_true INT, y_pred INT, y_score DOUBLE")


def _auc_bruteforce(rows):
    pos = [r[4] for r in rows if r[2] == 1]
    neg = [r[4] for r in rows if r[2] != 1]
    s = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return s / (len(pos) * len(neg))


def test_auc_matches_pairs_with_ties(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(400):
        y = rnd.random() < 0.4
        s = round(min(1.0, max(0.0, rnd.gauss(0.6 if y else 0.4, 0.2))), 1)
        rows.append(("m", i, int(y), int(s > 0.5), s))
    got = M.roc_auc(_pred(spark, rows)).first()["roc_auc"]
    assert abs(got - _auc_bruteforce(rows)) < 1e-12


def test_single_class_auc_is_null_and_zero_division(spark):
    rows = [("m", i, 0, 0, 0.1 * i) for i in range(5)]
    assert M.roc_auc(_pred(spark, rows)).first()["roc_auc"] is None
    m = M.classification_metrics(_pred(spark, rows)).first()
    assert (m["accuracy"], m["precision"], m["recall"], m["f1"]) == (1.0, 0.0, 0.0, 0.0)


def test_roc_and_pr_points(spark):
    rows = [("m", 0, 1, 1, 0.9), ("m", 1, 0, 1, 0.8), ("m", 2, 1, 0, 0.3), ("m", 3, 0, 0, 0.1)]
    pts = sorted((r["threshold"], r["fpr"], r["tpr"]) for r in M.roc_points(_pred(spark, rows)).collect())
    assert pts == [(0.1, 1.0, 1.0), (0.3, 0.5, 1.0), (0.8, 0.5, 0.5), (0.9, 0.0, 0.5)]
    ap = M.pr_auc(_pred(spark, rows)).first()["pr_auc"]
    assert abs(ap - (0.5 * 1.0 + 0.5 * (2 / 3))) < 1e-12


def test_votes(spark):
    rows = [("a", 1, 1, 1, 0.9), ("b", 1, 1, 0, 0.4), ("a", 2, 0, 1, 0.6), ("b", 2, 0, 0, 0.2),
            ("c", 2, 0, 0, 0.5)]
    v = {r["doc_id"]: r["y_pred"] for r in M.majority_vote(_pred(spark, rows)).collect()}
    assert v == {1: 1, 2: 0}     # doc 1 tie -> mean 0.65 > 0.5
    c = {r["doc_id"]: r for r in M.confidence_aggregate(_pred(spark, rows)).collect()}
    assert abs(c[1]["prob"] - (0.8 * 0.9 + 0.2 * 0.4) / 1.0) < 1e-12
    cm = {(r["model"], r["y_true"], r["y_pred"]): r["count"] for r in M.confusion_matrix(_pred(spark, rows)).collect()}
    assert cm[("a", 0, 1)] == 1


def test_score_buckets_are_even(spark):
    """Scores crowded at 0 and 1, and logits: no bucket holds more than a small share of the distinct scores."""
    rnd = random.Random(3)
    crowded = [(1e-6 * rnd.random()) if i % 2 else 1 - 1e-6 * rnd.random() for i in range(4000)]
    logits = [rnd.gauss(0, 30) for _ in range(4000)]
    rows = [("crowded", i, i % 3 == 0, 0, s) for i, s in enumerate(crowded)] + [("logits", i, i % 3 == 0, 0, s) for i, s in enumerate(logits)]
    pred = _pred(spark, [(m, i, int(y), p, s) for m, i, y, p, s in rows])
    sizes = M.score_bucket(pred, "model").groupBy("model", "_b").count().collect()
    assert max(r["count"] for r in sizes) <= 4 * 4000 / M.SCORE_BUCKETS
    for m in ("crowded", "logits"):
        own = [r for r in rows if r[0] == m][:600]
        got = M.roc_auc(_pred(spark, [(a, i, int(y), p, s) for a, i, y, p, s in own])).first()["roc_auc"]
        assert abs(got - _auc_bruteforce(own)) < 1e-12
