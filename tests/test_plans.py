"""Plan shape: no cartesian products, no Python UDFs, pruned scans."""

import pytest

import __spark_entry__ as E

CORE = ["features_by_source", "agg6_dedup_first_wins", "txt_ioc_features", "ioc_long",
        "dic1_technique_tags", "join1_technique_tags_vocabulary", "ent1_entities", "kg_edges",
        "kg12_degree_centrality", "smp2_undersample", "smp5_stratified_split", "met5_roc_auc",
        "scr_threat_scores", "adv1_tfidf"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CORE)
def test_no_cartesian_or_python(spark, name):
    p = _plan(E.queries()[name](spark, "/root/testdata/sf0.001"))
    for bad in ("CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "BroadcastNestedLoopJoin"):
        assert bad not in p, f"{name}: {bad}"


def test_scan_prunes_columns(spark):
    df = E.queries()["features_by_source"](spark, "/root/testdata/sf0.001")
    p = _plan(df)
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in p
