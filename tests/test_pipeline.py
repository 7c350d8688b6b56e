"""End-to-end pipeline and the driver entry point."""

import os

import __spark_entry__ as E


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"source", "label", "docs", "keyword_hits", "ips", "domains", "hashes", "cves"}


def test_run_pipeline(spark, tmp_path):
    from tidewatch.config import DEFAULT_CONFIG
    from tidewatch.plans import corpus as C
    from tidewatch.plans.pipeline import run_pipeline
    from tidewatch.sources.tables import gazetteer, model_scores, osint_documents
    sf = "/root/testdata/sf0.001"
    ext = model_scores(spark, sf).filter("model = 'm1'").selectExpr("doc_id", "'BERT' AS model", "prob")
    res = run_pipeline(spark, osint_documents(spark, sf), DEFAULT_CONFIG, C.tech_dict(spark),
                       gazetteer(spark, sf), external_scores=ext, out_dir=str(tmp_path))
    n = res.prepared.count()
    assert n == 196
    b = {r["label"]: r["count"] for r in res.balanced.filter("split = 'train'").groupBy("label").count().collect()}
    assert b[0] == b[1] == 64
    assert res.balanced.filter("split = 'test'").count() == 40
    s = res.scored
    assert s.count() == n == s.select("doc_id").distinct().count()
    assert s.filter("threat_score != model_prob + ioc_score + centrality_score").count() == 0
    for d in ("threat_detection_results", "model_results", "graph/nodes", "graph/edges"):
        assert os.path.exists(tmp_path / d), d
    m = spark.read.json(str(tmp_path / "model_results")).first()
    assert 0.0 <= m["accuracy"] <= 1.0
