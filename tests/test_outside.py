"""Models of other makers, stored models, fits over folds, graph upsert and sparse reputation."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tidewatch import sinks
from tidewatch.operators import outside as X


def _file(spark, tmp_path, content, name="m"):
    X.write_model(spark, json.dumps(content), str(tmp_path / name))
    return X.read_model(spark, str(tmp_path / name / "*.txt"))


def test_scores_by_a_linear_model(spark, tmp_path):
    model = _file(spark, tmp_path, {"bias": 0.5, "weights": [1.0, -2.0]})
    docs = spark.createDataFrame([(1, 1.0, 2), (2, None, None), (3, 0.25, 0)], "doc_id long, a double, b int").repartition(2)
    got = {r.doc_id: r.prob for r in X.outside_scores(docs, model, X.linear_model, ["a", "b"], "m").collect()}
    assert got == pytest.approx({1: 1 / (1 + math.exp(2.5)), 2: 1 / (1 + math.exp(-0.5)), 3: 1 / (1 + math.exp(-0.75))})
    one = X.outside_scores(docs, json.dumps({"bias": 0, "weights": [1]}).encode(), X.linear_model, ["b"], "m")
    assert one.count() == 3 and X.outside_scores(docs.where("false"), model, X.linear_model, ["a", "b"], "m").count() == 0
    with pytest.raises(ValueError, match="no column"):
        X.outside_scores(docs, model, X.linear_model, ["a", "absent"], "m")


def test_texts_and_values_that_are_no_probability(spark):
    def loader(model):
        def predict(texts, odd):
            return [float("nan") if t == "nan" else 7.0 if t == "big" else len(t) / 10 for t in texts]
        return predict

    docs = spark.createDataFrame([(1, "abc", 1), (2, None, 1), (3, "nan", 1), (4, "big", 1)], "doc_id long, text string, odd int")
    got = {r.doc_id: r.prob for r in X.outside_scores(docs, b"", loader, ["text", "odd"], "m").collect()}
    assert got == {1: 0.3, 2: 0.0, 3: None, 4: None}


def test_model_files_are_checked(spark, tmp_path):
    _file(spark, tmp_path, {"bias": 0})
    with pytest.raises(ValueError, match="limit 3"):
        X.read_model(spark, str(tmp_path / "m" / "*.txt"), 3)
    (tmp_path / "m" / "more.txt").write_text("x")
    with pytest.raises(ValueError, match="more than one"):
        X.read_model(spark, str(tmp_path / "m" / "*.txt"))


def test_entities_and_texts_that_fail(spark):
    def loader(model):
        def find(texts):
            if "bad" in texts:
                raise RuntimeError("no tagger")
            return [[(w, "ORG" if w[0].isupper() else "DATE") for w in t.split()] for t in texts]
        return find

    docs = spark.createDataFrame([(1, "Acme low Umbra"), (2, "bad"), (3, None)], "doc_id long, clean_text string").coalesce(1)
    got = [tuple(r) for r in X.outside_entities(docs, b"", loader).orderBy("doc_id", "pos").collect()]
    assert got == [(1, 0, "Acme", "ORG"), (1, 1, "Umbra", "ORG")]


def _graph(spark, nodes, edges):
    return (spark.createDataFrame(nodes, "id string, type string, entity_label string"),
            spark.createDataFrame(edges, "src string, dst string, relation string"))


def _read(spark, path):
    nodes, edges = sinks.read_graph(spark, path)
    return sorted(map(tuple, nodes.collect()), key=str), sorted(map(tuple, edges.collect()), key=str)


def test_upsert_merges_and_repeats(spark, tmp_path):
    path = str(tmp_path / "g")
    assert _read(spark, path) == ([], [])
    a = _graph(spark, [("n1", "entity", "ORG"), ("n2", "ip", None), (None, "x", None)], [("n1", "n2", "r"), ("n1", "n2", None), (None, "n2", "r")])
    b = _graph(spark, [("n1", "entity", "LOC"), ("n2", "ip", "late"), ("n3", "ip", None), ("n3", "ip", "L")], [("n1", "n2", "r"), ("n1", "n3", "r")])
    assert sinks.upsert_graph(*a, path, buckets=4) == 1
    first = _read(spark, path)
    assert first == ([("n1", "entity", "ORG"), ("n2", "ip", None)], [("n1", "n2", "r"), ("n1", "n2", "related_to")])
    assert sinks.upsert_graph(*b, path, buckets=99) == 2   # the first number of buckets holds
    want = ([("n1", "entity", "ORG"), ("n2", "ip", "late"), ("n3", "ip", "L")], [("n1", "n2", "r"), ("n1", "n2", "related_to"), ("n1", "n3", "r")])
    assert _read(spark, path) == want
    sinks.upsert_graph(*b, path)
    assert _read(spark, path) == want
    sinks.upsert_graph(a[0].where("false"), a[1].where("false"), path)
    assert _read(spark, path) == want


def test_load_that_breaks_leaves_the_graph(spark, tmp_path):
    """Folders of a generation without a manifest are not read, and the next load overwrites them."""
    path = str(tmp_path / "g")
    sinks.upsert_graph(*_graph(spark, [("n1", "ip", None)], [("n1", "n1", "r")]), path, buckets=2)
    before = _read(spark, path)
    for b in (0, 1):
        spark.createDataFrame([("stray", "ip", None)], "id string, type string, entity_label string").write.parquet(f"{path}/nodes/generation=2/bucket={b}")
    assert _read(spark, path) == before
    sinks.upsert_graph(*_graph(spark, [("n2", "ip", None)], []), path)
    assert _read(spark, path) == ([("n1", "ip", None), ("n2", "ip", None)], before[1])


def test_sparse_reputation(spark):
    from tidewatch.operators.indicators import doc_reputation_sparse, reputation_index
    long = spark.createDataFrame([(1, "b", 3), (1, "a", 0), (2, "c", 5), (2, "b", 1), (2, "b", 2)], "doc_id long, key string, malicious_score int")
    index = reputation_index(long)
    assert {r.key: r.idx for r in index.collect()} == {"a": 0, "b": 1, "c": 2}
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    got = {r.doc_id: [tuple(e) for e in r.entries] for r in doc_reputation_sparse(long, index, docs).collect()}
    assert got == {1: [(1, 3)], 2: [(1, 2), (2, 5)], 3: []}


def test_fold_fits_equal_one_fit_each(spark):
    """Scores from the one counted table are those of a fit on the other folds' rows."""
    from tidewatch.operators.models import fold_metrics, naive_bayes_by_fold, naive_bayes_scores
    words = ["malware", "botnet", "garden", "recipe", "the", "and"]
    rows = [(i, " ".join(words[(i * k) % 6] for k in range(1, 6)) + f" only{i % 4}", i % 2, i % 3) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, clean_text string, label int, fold int")
    got = {r.doc_id: (round(r.score, 9), r.pred) for r in naive_bayes_by_fold(d).collect()}
    want = {}
    for f in range(3):
        for r in naive_bayes_scores(d.where(F.col("fold") == f), d.where(F.col("fold") != f)).collect():
            want[r.doc_id] = (round(r.score, 9), r.pred)
    assert got == want
    m = {r.fold: r for r in fold_metrics(d).collect()}
    assert set(m) == {"0", "1", "2", "mean"}
    assert m["mean"].accuracy == pytest.approx(sum(m[str(f)].accuracy for f in range(3)) / 3)


def test_store_without_a_usable_model(spark, tmp_path):
    from tidewatch.plans.pipeline import METRIC_SCHEMA
    metrics = spark.createDataFrame([("text_lr", None, None, None, None, None, "broke")], METRIC_SCHEMA)
    sinks.save_models(metrics, {}, str(tmp_path / "s"))
    assert sinks.read_record(spark, str(tmp_path / "s")).first().error == "broke"
    with pytest.raises(ValueError, match="no model"):
        sinks.load_best(spark, str(tmp_path / "s"))
