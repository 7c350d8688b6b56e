"""Write / read round trips (SNK1-SNK6, LIM1)."""

import glob
import os

from pyspark.sql import functions as F

from tidewatch import sinks


def test_scored_csv_and_parquet(spark, tmp_path):
    df = spark.createDataFrame([(1, ["T1", "T2"], 0.5)], "doc_id INT, mitre_matches ARRAY<STRING>, p DOUBLE")
    sinks.write_scored(df, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).first()["mitre_matches"] == ["T1", "T2"]
    sinks.write_scored(df, str(tmp_path / "csv"), fmt="csv")
    r = spark.read.option("header", True).csv(str(tmp_path / "csv")).first()
    assert r["mitre_matches"] == '["T1","T2"]'


def test_alert_summary_guard(spark, tmp_path):
    from tidewatch.operators.scoring import alert_summary
    s = spark.createDataFrame([(1, "a", 0.5, False)], "doc_id INT, clean_text STRING, threat_score DOUBLE, alert BOOLEAN")
    assert sinks.write_alert_summary(alert_summary(s), str(tmp_path / "none")) is False
    assert not os.path.exists(tmp_path / "none")
    s2 = spark.createDataFrame([(i, f"t{i}", 0.7 + i / 100, True) for i in range(15)],
                               "doc_id INT, clean_text STRING, threat_score DOUBLE, alert BOOLEAN")
    assert sinks.write_alert_summary(alert_summary(s2), str(tmp_path / "yes")) is True
    r = spark.read.json(str(tmp_path / "yes")).first()
    assert r["total_alerts"] == 15 and len(r["alert_examples"]) == 10
    assert r["alert_examples"][0]["clean_text"] == "t14"


def test_graph_load_rows_batches(spark, tmp_path):
    nodes = spark.range(1234).select(F.concat(F.lit("IP::"), F.col("id").cast("string")).alias("id"),
                                     F.lit("ip").alias("type"), F.lit(None).cast("string").alias("entity_label"))
    edges = spark.createDataFrame([("IP::1", "IP::2", None), ("IP::1", "IP::3", "co_occurs")],
                                  "src STRING, dst STRING, relation STRING")
    sinks.write_graph_load_rows(nodes.coalesce(1), edges, str(tmp_path / "g"), batch=500)
    files = glob.glob(str(tmp_path / "g" / "nodes" / "*.csv"))
    assert len(files) == 3
    e = {r["v"]: r["type"] for r in spark.read.option("header", True).csv(str(tmp_path / "g" / "edges")).collect()}
    assert e == {"IP::2": "related_to", "IP::3": "co_occurs"}
    sinks.write_graph(nodes, edges, str(tmp_path / "g2"))
    assert spark.read.parquet(str(tmp_path / "g2" / "nodes")).count() == 1234


def test_model_round_trip(spark, tmp_path):
    from tidewatch.operators.models import score_documents, text_pipeline
    rows = [(i, "malware attack botnet" if i % 2 else "cooking recipe garden", float(i % 2), 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id INT, clean_text STRING, label DOUBLE, weight DOUBLE")
    m = text_pipeline(max_iter=10).fit(df)
    sinks.save_model(m, str(tmp_path / "m"))
    m2 = sinks.load_model(str(tmp_path / "m"))
    a = {r["doc_id"]: r["prob"] for r in score_documents(df, m).collect()}
    b = {r["doc_id"]: r["prob"] for r in score_documents(df, m2).collect()}
    assert a == b and a[1] > 0.5 > a[0]
