"""Shared lazily-built inputs for catalogued queries (no actions here)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import prepare as Pp
from tidewatch.sources.tables import ensure_parallelism, osint_documents, technique_fixture
from tidewatch.operators.techniques import technique_dictionary


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """osint corpus with ``clean_text`` (all rows, before filtering)."""
    return osint_documents(spark, sf_dir).transform(Pp.add_clean_text)


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned, non-empty, deduplicated corpus."""
    return Pp.dedup_first_wins(cleaned(spark, sf_dir), "clean_text", ("doc_id",), drop_empty=True)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared corpus + weak label + IOC counts + keyword count."""
    return prepared(spark, sf_dir).transform(Pp.add_label_and_features)


def tech_dict(spark: SparkSession) -> DataFrame:
    return technique_dictionary(technique_fixture(spark))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features + technique tags (fixture dictionary)."""
    from tidewatch.operators.techniques import tag_techniques
    return tag_techniques(features(spark, sf_dir), tech_dict(spark))


def entities(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    from tidewatch.operators.entities import extract_entities
    from tidewatch.sources.tables import gazetteer
    return extract_entities(docs if docs is not None else prepared(spark, sf_dir),
                            gazetteer(spark, sf_dir))


def iocs(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    from tidewatch.operators.indicators import ioc_long
    return ioc_long(docs if docs is not None else prepared(spark, sf_dir))


def graph(spark: SparkSession, sf_dir: str):
    """(tagged docs, entities, iocs, nodes, edges) sharing one prepared corpus."""
    from tidewatch.operators import graph as G
    # entities, indicators and techniques all read the tagged corpus: checkpoint
    # it once (shared checkpoint dir) so cleaning and dedup run a single time
    t = tagged(spark, sf_dir).drop("text").checkpoint(eager=True)
    # nodes, edges and centrality each read both long tables: compute them once
    e = entities(spark, sf_dir, t).checkpoint(eager=True)
    i = iocs(spark, sf_dir, t).checkpoint(eager=True)
    return t, e, i, G.build_nodes(e, i, t), G.build_edges(e, i, t)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(model, doc_id, y_true, y_pred, y_score)`` from the deterministic model scores."""
    from tidewatch.sources.tables import model_scores
    from tidewatch.operators.scoring import binary_decision
    f = features(spark, sf_dir).select("doc_id", F.col("label").cast("int").alias("y_true"))
    s = model_scores(spark, sf_dir)
    return s.join(f, "doc_id").select("model", "doc_id", "y_true",
                                      binary_decision("prob").alias("y_pred"),
                                      F.col("prob").alias("y_score"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full alert table: features + tags + graph centrality + model m1 probability."""
    from tidewatch.operators import graph as G
    from tidewatch.operators.scoring import compute_threat_score
    from tidewatch.sources.tables import model_scores
    t, e, _, n, ed = graph(spark, sf_dir)
    cent = G.doc_centrality(t.select("doc_id"), e, G.degree_centrality(n, ed))
    probs = model_scores(spark, sf_dir).filter(F.col("model") == "m1") \
        .select("doc_id", F.col("prob").alias("model_prob"))
    return compute_threat_score(t, probs, cent)
