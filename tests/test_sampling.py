"""Exact quotas, single-class behaviour, oversampling sizes, fold balance."""

import math

from pyspark.sql import functions as F

from tidewatch.operators import sampling as S


def _df(spark, n_pos, n_neg):
    rows = [(i, 1) for i in range(n_pos)] + [(n_pos + i, 0) for i in range(n_neg)]
    return spark.createDataFrame(rows, "doc_id BIGINT, label INT")


def test_exact_sample_and_keys(spark):
    d = _df(spark, 300, 700)
    s = S.exact_sample(d, 123, 42)
    ids = [r[0] for r in s.collect()]
    assert len(ids) == 123 == len(set(ids))
    import hashlib
    want = sorted(range(1000), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))[:123]
    assert sorted(ids) == sorted(want)
    assert S.exact_sample(d, 5000, 42).count() == 1000


def test_undersample_and_single_class(spark):
    d = _df(spark, 30, 70)
    u = S.undersample(d)
    assert {r["label"]: r["count"] for r in S.class_counts(u).collect()} == {0: 30, 1: 30}
    one = _df(spark, 0, 10)
    assert S.undersample(one).count() == 10
    assert S.balance(d, None).count() == 100 and S.balance(d, "other").count() == 100


def test_oversample_sizes(spark):
    d = _df(spark, 7, 40)
    o = S.oversample(d)
    c = {r["label"]: r["count"] for r in S.class_counts(o).collect()}
    assert c == {0: 40, 1: 40}
    assert o.filter("label = 1").select("doc_id").distinct().count() <= 7
    assert o.filter("label = 0").select("doc_id").distinct().count() == 40


def test_split_quotas(spark):
    d = _df(spark, 37, 63)
    s = S.stratified_split(d, test_size=0.2)
    t = {r["label"]: r["count"] for r in S.class_counts(s.filter("split = 'test'")).collect()}
    assert sum(t.values()) == math.ceil(0.2 * 100)
    q = S.split_quotas({1: 37, 0: 63}, 0.2)
    assert t == q and sum(q.values()) == 20


def test_rank_is_dense_and_folds_balanced(spark):
    d = _df(spark, 25, 50)
    r = S.rank_within_group(d, ["label"], 42)
    for lab, n in ((1, 25), (0, 50)):
        ranks = sorted(x[0] for x in r.filter(F.col("label") == lab).select("_rank").collect())
        assert ranks == list(range(n))
    f = S.cv_folds(d, 5)
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert sorted(sizes) == [15] * 5


def test_class_weight(spark):
    assert abs(S.class_weight(_df(spark, 10, 30)).first()[0] - 3.0) < 1e-12
    assert abs(S.class_weight(_df(spark, 0, 4)).first()[0] - 4.0) < 1e-12


def test_rows_without_a_label_are_a_group(spark):
    rows = [(i, 1) for i in range(8)] + [(i, 0) for i in range(8, 38)] + [(i, None) for i in range(38, 48)]
    d = spark.createDataFrame(rows, "doc_id BIGINT, label INT")
    count = lambda x: {r["label"]: r["count"] for r in S.class_counts(x).collect()}
    assert count(S.undersample(d)) == {0: 8, 1: 8, None: 10}
    assert count(S.oversample(d)) == {0: 30, 1: 30, None: 10}
    split = S.stratified_split(d, test_size=0.25)
    assert split.count() == 48 and split.filter("split = 'test'").count() == 12
    assert S.cv_folds(d, 5).count() == 48


def test_quota_plan_shuffles_no_text(spark):
    d = _df(spark, 30, 70).withColumn("text", F.lit("long text"))
    plan = S.stratified_split(d)._jdf.queryExecution().optimizedPlan().toString()
    exchanges = S.stratified_split(d)._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")[1:]
    assert "text" in plan and all("text#" not in e.split("\n", 2)[1] for e in exchanges if "\n" in e)
