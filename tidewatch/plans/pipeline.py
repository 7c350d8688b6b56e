"""End-to-end run as one Spark job graph.

load -> prepare (clean, dedup, weak label, IOC counts, technique tags) -> split ->
fit on balanced training rows -> graph, scores and alerts over every prepared
document -> outputs. Feature toggles (FLT6) decide at plan time which branches
exist; nothing is computed for a disabled stage.

The prepared table, the entities, the indicators and the scored table are read
more than once, so each is checkpointed once to the shared ``spark.checkpoint.dir``
(a reliable checkpoint: lineage is cut and a lost executor does not force the
regex stages to re-run).
"""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import Config, DEFAULT_CONFIG
from tidewatch.operators import graph as G
from tidewatch.operators import prepare as Pp
from tidewatch.operators import sampling as S
from tidewatch.operators import scoring as Sc
from tidewatch.operators.entities import extract_entities
from tidewatch.operators.indicators import attach_reputation, enrich_iocs, ioc_long
from tidewatch.session import ensure_checkpoint_dir

log = logging.getLogger("tidewatch")

METRIC_SCHEMA = ("model STRING, accuracy DOUBLE, precision DOUBLE, recall DOUBLE, f1 DOUBLE, "
                 "roc_auc DOUBLE, error STRING")


@dataclass
class PipelineResult:
    prepared: DataFrame
    balanced: DataFrame
    scored: DataFrame | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    metrics: DataFrame | None = None
    alert_summary: DataFrame | None = None
    chosen_model: str | None = None
    timings: dict = field(default_factory=dict)


def attempt(spark: SparkSession, name: str, fit):
    """``(model, metrics)`` of a fit, or ``(None, error row)``: one failing model does not end the run."""
    cols = [c.split()[0] for c in METRIC_SCHEMA.split(", ")]
    try:
        model, metrics = fit()
        return model, metrics.select(*cols).checkpoint()
    except Exception as e:  # the message becomes the model's result
        log.warning("model %s failed: %s", name, str(e).splitlines()[0] if str(e) else type(e).__name__)
        row = [(name, None, None, None, None, None, (str(e) or type(e).__name__)[:500])]
        return None, spark.createDataFrame(row, METRIC_SCHEMA)


def training_rows(prepared: DataFrame, cfg: Config) -> DataFrame:
    """Split rows with the training part balanced; test rows keep the true class shares."""
    rows = S.stratified_split(prepared, "label", cfg.test_size, cfg.random_seed)
    train = S.balance(rows.filter(F.col("split") == "train"), cfg.balance_method, "label", cfg.random_seed)
    return train.unionByName(rows.filter(F.col("split") == "test"))


def run_pipeline(spark: SparkSession, docs: DataFrame, cfg: Config = DEFAULT_CONFIG,
                 technique_dict: DataFrame | None = None, gazetteer: DataFrame | None = None,
                 external_scores: DataFrame | None = None, train_model: bool = True,
                 out_dir: str | None = None, reputation: DataFrame | None = None,
                 embeddings: DataFrame | None = None) -> PipelineResult:
    """``docs``: ``(doc_id, text[, source_rank, row_no][, label])``; ids are unique.

    ``reputation`` (with ``cfg.enrich_iocs``) and ``embeddings`` (with ``cfg.do_embeddings_lr``)
    feed the stages of those toggles; a toggle without its table does nothing.

    ``external_scores``: optional long ``(doc_id, model, prob)`` from models
    trained elsewhere; preferred in ``cfg.model_preference`` order over the
    built-in classifier (SCR4/SCR5).
    """
    t0 = time.time()
    ensure_checkpoint_dir(spark)
    order = tuple(c for c in ("source_rank", "row_no") if c in docs.columns) or ("doc_id",)
    prepared = Pp.prepare_documents(docs, cfg, order_cols=order,
                                    technique_dict=technique_dict if cfg.do_mitre_mapping else None)
    if "mitre_matches" not in prepared.columns:
        prepared = prepared.withColumn("mitre_matches", F.array().cast("array<string>"))
    prepared = prepared.checkpoint(eager=True)
    res = PipelineResult(prepared=prepared, balanced=prepared)

    centrality = iocs = None
    if cfg.do_build_kg and gazetteer is not None or cfg.enrich_iocs and reputation is not None:
        iocs = ioc_long(prepared).checkpoint(eager=True)
    if cfg.do_build_kg and gazetteer is not None:
        ents = extract_entities(prepared, gazetteer).checkpoint(eager=True)
        res.nodes = G.build_nodes(ents, iocs, prepared)
        res.edges = G.build_edges(ents, iocs, prepared)
        cent = G.degree_centrality(res.nodes, res.edges)
        centrality = G.doc_centrality(prepared.select("doc_id"), ents, cent,
                                      weight=cfg.graph_centrality_weight)

    scores, results, seq, kept = [], [], [], {}
    if train_model or cfg.do_baseline:
        res.balanced = training_rows(prepared, cfg).checkpoint(eager=True)
    if train_model:
        from tidewatch.operators.models import fit_text_classifier, score_documents
        model, metrics = attempt(spark, "text_lr", lambda: fit_text_classifier(res.balanced, model_name="text_lr"))
        results.append(metrics)
        seq.append("text_lr")
        if model is not None:
            scores.append(score_documents(prepared, model, "text_lr").select("doc_id", "model", "prob"))
            kept["text_lr"] = model
            if out_dir:
                from tidewatch import sinks
                sinks.save_model(model, f"{out_dir}/text_lr_model")
    if cfg.do_baseline:
        from tidewatch.operators.models import fit_naive_bayes
        table, metrics = attempt(spark, "naive_bayes", lambda: fit_naive_bayes(res.balanced))
        results.append(metrics)
        seq.append("naive_bayes")
        if table is not None:
            kept["naive_bayes"] = table
    if cfg.do_embeddings_lr and embeddings is not None:
        from tidewatch.operators.models import evaluate_embedding_classifier
        _, metrics = attempt(spark, "embeddings_lr", lambda: evaluate_embedding_classifier(embeddings))
        results.append(metrics)
        seq.append("embeddings_lr")
    for r in results:
        res.metrics = r if res.metrics is None else res.metrics.unionByName(r)
    if external_scores is not None:
        scores.append(external_scores.select("doc_id", "model", "prob"))
    if scores:
        allscores = scores[0]
        for s in scores[1:]:
            allscores = allscores.unionByName(s)
        # SCR4: of the models fitted here the preferred one that did not fail; scores made elsewhere come first
        fitted = [m for m in seq if m == "text_lr"]
        if res.metrics is not None:
            order_ = F.array_position(F.array(*[F.lit(m) for m in seq]), F.col("model"))
            first = Sc.choose_model(res.metrics.withColumn("seq", order_), (*cfg.model_preference, "text_lr")).first()
            res.chosen_model = first["model"] if first else None
        pref = [*cfg.model_preference, *[m for m in fitted if m not in cfg.model_preference]]
        probs = Sc.probability_with_fallback(prepared.select("doc_id"), allscores, pref, cfg.random_seed)
        scored = Sc.compute_threat_score(prepared, probs.select("doc_id", "model_prob"), centrality,
                                         ioc_weight=cfg.ioc_weight,
                                         threshold=cfg.threat_detection_threshold)
        if cfg.enrich_iocs and reputation is not None:
            scored = attach_reputation(scored, enrich_iocs(iocs, reputation, cfg.broadcast_bytes))
        res.scored = scored.checkpoint(eager=True)
        res.alert_summary = Sc.alert_summary(res.scored)

    if out_dir:
        from tidewatch import sinks
        if res.scored is not None:
            sinks.write_scored(res.scored, f"{out_dir}/threat_detection_results")
            sinks.write_alert_summary(res.alert_summary, f"{out_dir}/alerts_summary")
        if res.metrics is not None:
            sinks.write_metrics(res.metrics, f"{out_dir}/model_results")
            sinks.save_models(res.metrics, kept, f"{out_dir}/model_store")
        if res.nodes is not None:
            sinks.write_graph(res.nodes, res.edges, f"{out_dir}/graph")
            sinks.write_graph_load_rows(res.nodes, res.edges, f"{out_dir}/graph_load")
    res.timings["total_sec"] = round(time.time() - t0, 3)
    log.info("pipeline finished in %.2f s", res.timings["total_sec"])
    return res


def run_inference(spark: SparkSession, docs: DataFrame, store: str, cfg: Config = DEFAULT_CONFIG,
                  technique_dict: DataFrame | None = None) -> PipelineResult:
    """Score ``docs`` by the best model of an earlier run's ``model_store``; nothing is fitted.

    Best: the first of ``cfg.model_preference``, then ``text_lr``, that the run stored without an error, else the
    first stored model. Threat scores have no centrality part, as the graph is the fit run's.
    """
    from tidewatch.sinks import load_best

    ensure_checkpoint_dir(spark)
    name, apply = load_best(spark, store, (*cfg.model_preference, "text_lr"))
    order = tuple(c for c in ("source_rank", "row_no") if c in docs.columns) or ("doc_id",)
    prepared = Pp.prepare_documents(docs, cfg, order_cols=order, technique_dict=technique_dict if cfg.do_mitre_mapping else None)
    if "mitre_matches" not in prepared.columns:
        prepared = prepared.withColumn("mitre_matches", F.array().cast("array<string>"))
    prepared = prepared.checkpoint(eager=True)
    res = PipelineResult(prepared=prepared, balanced=prepared, chosen_model=name)
    probs = Sc.probability_with_fallback(prepared.select("doc_id"), apply(prepared), [name], cfg.random_seed)
    res.scored = Sc.compute_threat_score(prepared, probs.select("doc_id", "model_prob"), None, ioc_weight=cfg.ioc_weight,
                                         threshold=cfg.threat_detection_threshold).checkpoint(eager=True)
    res.alert_summary = Sc.alert_summary(res.scored)
    return res
