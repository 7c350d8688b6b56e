"""Catalogue, second part: sources and sinks written and read back, the whole pipeline, toggles.

Files go to a new folder beneath the shared checkpoint folder, so they are
visible to every executor.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatch.config import DEFAULT_CONFIG
from tidewatch.operators import prepare as Pp
from tidewatch.plans import corpus as C
from tidewatch.plans import oracle as O
from tidewatch.plans.catalog import (_GRAPH_BASE, _PRED, _REP_CTES, _SCORED, FEATURE_COLS, SCORED_COLS, _bigints,
                                     _enriched, register)
from tidewatch.session import ensure_checkpoint_dir
from tidewatch.sources.tables import ensure_parallelism, load_table


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _to_csv(df, spark, name: str) -> str:
    path = _folder(spark, name)
    (df.write.option("header", True).option("quoteAll", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def _csv_sources(spark, sf_dir):
    """documents and conversations as OSINT files, part as a structured one with a hinted column."""
    docs = load_table(spark, sf_dir, "documents").orderBy("doc_id").select("doc_id", F.col("text").alias("TEXT"), F.col("source").alias("label"))
    conv = load_table(spark, sf_dir, "conversations").orderBy("conv_id", "turn").select("conv_id", F.col("text").alias("Summary"), F.col("role").alias("Label"))
    part = load_table(spark, sf_dir, "part").orderBy("p_partkey").select("p_partkey", F.col("p_name").alias("item_describer"))
    bad = load_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    osint = [_to_csv(docs, spark, "docs"), _folder(spark, "missing"), _to_csv(bad, spark, "no-text"), _to_csv(conv, spark, "conv")]
    return osint, [_to_csv(part, spark, "part")]


# --- SRC1, SRC2, SRC3, SRC4, PRJ1-PRJ3 from files ----------------------------------------
@register("src_csv_merge", """
SELECT 'osint' AS source_kind, 0 AS source_rank, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS row_no, text, source AS label FROM documents
UNION ALL SELECT 'osint', 1, CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS BIGINT), text, NULL FROM conversations
UNION ALL SELECT 'structured', 2, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT), p_name, NULL FROM part""")
def src_csv_merge(spark, sf_dir):
    """Written as CSV, read back; a missing file and one without a text column are left out."""
    from tidewatch.sources.text_sources import merge_sources
    m = merge_sources(*_csv_sources(spark, sf_dir), spark, multi_line=True)
    return m.select("source_kind", "source_rank", "row_no", "text", "label")


@register("agg6_merged_first_wins", f"""
WITH m AS (SELECT 0 AS source_rank, row_number() OVER (ORDER BY doc_id) - 1 AS row_no, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (ORDER BY conv_id, turn) - 1, text FROM conversations
  UNION ALL SELECT 2, row_number() OVER (ORDER BY p_partkey) - 1, p_name FROM part),
c AS (SELECT source_rank, row_no, {O.clean_sql('text')} AS clean_text FROM m)
SELECT source_rank, CAST(row_no AS BIGINT) AS row_no, clean_text FROM c WHERE clean_text <> ''
QUALIFY row_number() OVER (PARTITION BY clean_text ORDER BY source_rank, row_no) = 1""")
def agg6_merged_first_wins(spark, sf_dir):
    from tidewatch.sources.text_sources import merge_sources
    m = merge_sources(*_csv_sources(spark, sf_dir), spark, multi_line=True).transform(Pp.add_clean_text)
    d = Pp.dedup_first_wins(m, "clean_text", ("source_rank", "row_no"), drop_empty=True)
    return d.select("source_rank", "row_no", "clean_text")


# --- SRC1, broken rows -------------------------------------------------------------------
@register("src1_rejected_rows", r"""
SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS row_no, doc_id % 7 > 1 AS kept,
  CASE doc_id % 7 WHEN 0 THEN line || ',beyond' WHEN 1 THEN q ELSE t END AS value
FROM (SELECT doc_id, t, '"' || t || '"' AS q, '"' || t || '",' || source AS line FROM
  (SELECT doc_id, source, regexp_replace(coalesce(text, ''), '["\\\r\n]+', ' ', 'g') || '.' AS t FROM documents))""")
def src1_rejected_rows(spark, sf_dir):
    """Documents as CSV lines, a seventh with a field too many and a seventh with one missing: what is kept, and what is rejected."""
    from tidewatch.sources.text_sources import merge_with_rejects
    t = F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), r'["\\\r\n]+', " "), F.lit("."))
    quoted = F.concat(F.lit('"'), t, F.lit('"'))
    line = F.concat(quoted, F.lit(","), F.col("source"))
    kind = F.col("doc_id") % 7
    lines = load_table(spark, sf_dir, "documents").orderBy("doc_id").select(
        F.when(kind == 0, F.concat(line, F.lit(",beyond"))).when(kind == 1, quoted).otherwise(line).alias("text,source"))
    path = _folder(spark, "broken-rows")
    # one field a line, without quoting: the lines stand in the files as they are
    lines.write.options(header=True, sep="\u0001", quote="\u0000", escape="\u0000", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    merged, rejects = merge_with_rejects([path], [], spark)
    return (merged.select("row_no", F.lit(True).alias("kept"), F.col("text").alias("value"))
            .unionByName(rejects.select("row_no", F.lit(False).alias("kept"), F.col("record").alias("value"))))


# --- SRC5, ADV10 from a loaded file, a dictionary of all parts ------------------------------
def _part_dictionary(spark, sf_dir):
    from tidewatch.operators.techniques import load_technique_dictionary
    p = load_table(spark, sf_dir, "part").orderBy("p_partkey")
    raw = p.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("technique_id"), F.col("p_name").alias("technique_name"),
                   F.expr("concat(upper(substr(p_name, 1, 3 + p_partkey % 3)), '; ;', substr(p_name, -4 - p_partkey % 2))").alias("keywords"),
                   F.concat(F.lit("tactic-"), (F.col("p_partkey") % 7).cast("string")).alias("tactic"))
    return load_technique_dictionary(spark, _to_csv(raw, spark, "dictionary"), required=True)


_PART_DICT = """pd AS (SELECT p_partkey AS pos, 'P' || CAST(p_partkey AS VARCHAR) AS technique_id, p_name,
  [k for k in [lower(trim(substr(p_name, 1, CAST(3 + p_partkey % 3 AS BIGINT)))), lower(trim(right(p_name, CAST(4 + p_partkey % 2 AS BIGINT))))] if k <> ''] AS keywords,
  'tactic-' || CAST(p_partkey % 7 AS VARCHAR) AS tactic FROM part)"""


@register("src5_dictionary_file", f"""
WITH {_PART_DICT} SELECT technique_id, p_name AS technique_name, array_to_string(keywords, '|') AS keywords, tactic FROM pd""")
def src5_dictionary_file(spark, sf_dir):
    return _part_dictionary(spark, sf_dir).select("technique_id", "technique_name", F.array_join("keywords", "|").alias("keywords"), "tactic")


@register("dic1_large_dictionary", f"""
WITH {O.prep_ctes()}, {_PART_DICT},
hit AS (SELECT f.doc_id, pd.pos, pd.technique_id FROM feat f JOIN pd ON len(list_filter(pd.keywords, lambda k: contains(lower(f.clean_text), k))) > 0)
SELECT f.doc_id, coalesce((SELECT string_agg(technique_id, ',' ORDER BY pos) FROM hit WHERE hit.doc_id = f.doc_id), '') AS mitre_matches FROM feat f""")
def dic1_large_dictionary(spark, sf_dir):
    from tidewatch.operators.techniques import tag_techniques
    # the documents are read once: no copy of them is kept
    t = tag_techniques(C.features(spark, sf_dir).select("doc_id", "clean_text"), _part_dictionary(spark, sf_dir))
    return t.select("doc_id", F.array_join("mitre_matches", ",").alias("mitre_matches"))


@register("adv10_tactics_from_file", f"""
WITH {O.prep_ctes()}, {_PART_DICT}
SELECT DISTINCT f.doc_id, pd.tactic FROM feat f JOIN pd ON len(list_filter(pd.keywords, lambda k: contains(lower(f.clean_text), k))) > 0""")
def adv10_tactics_from_file(spark, sf_dir):
    from tidewatch.operators.techniques import by_tactic, tag_techniques, technique_tactics
    d = by_tactic(_part_dictionary(spark, sf_dir))
    return technique_tactics(tag_techniques(C.features(spark, sf_dir).drop("text").checkpoint(), d), d)


# --- SRC7, IOC8 wide ------------------------------------------------------------------------
@register("src7_reputation_file", f"""{_REP_CTES}
SELECT i.doc_id, i.ioc_type, i.ioc, coalesce(r.malicious_score, 0) AS malicious_score
FROM iocl i LEFT JOIN rep r ON r.ioc_type = i.ioc_type AND r.ioc = i.ioc""")
def src7_reputation_file(spark, sf_dir):
    from tidewatch.operators import indicators as I
    i = I.ioc_long(C.prepared(spark, sf_dir)).checkpoint()
    path = _folder(spark, "reputation")
    I.reputation_fixture(i).write.parquet(path)
    return I.enrich_iocs(i, I.load_reputation(spark, path)).select("doc_id", "ioc_type", "ioc", "malicious_score")


_WIDE = ["ips_10.0.2.6", "ips_10.0.4.12", "domains_host6.evil.com", "domains_host12.evil.com", "domains_absent.org"]


@register("ioc8_wide", f"""{_REP_CTES}
SELECT f.doc_id, {", ".join(f"CAST(coalesce(max(CASE WHEN e.ioc_type || '_' || e.ioc = '{k}' THEN e.malicious_score END), 0) AS INTEGER) AS k{n}" for n, k in enumerate(_WIDE))}
FROM feat f LEFT JOIN enr e USING (doc_id) GROUP BY f.doc_id""")
def ioc8_wide(spark, sf_dir):
    from tidewatch.operators.indicators import doc_reputation_long, doc_reputation_wide
    f, e = _enriched(spark, sf_dir)
    wide = doc_reputation_wide(doc_reputation_long(e), _WIDE, f)
    return wide.select("doc_id", *[F.col(f"`{k}`").alias(f"k{n}") for n, k in enumerate(_WIDE)])


# --- ADV13 across source kinds ----------------------------------------------------------------
@register("adv13_osint_and_structured", f"""
WITH {O.prep_ctes()}{O.ioc_long_cte()},
bs AS (SELECT item_id AS doc_id, {O.clean_sql("text || ' 10.0.' || CAST(item_id % 9 AS VARCHAR) || '.' || CAST(item_id % 31 AS VARCHAR) || ' host' || CAST(item_id AS VARCHAR) || '.evil.com'")} AS clean_text FROM benchmark),
bl AS (SELECT doc_id, 'ips' AS ioc_type, unnest({O.ioc_list_sql('ips')}) AS ioc FROM bs UNION ALL
       SELECT doc_id, 'domains', unnest({O.ioc_list_sql('domains')}) FROM bs UNION ALL
       SELECT doc_id, 'hashes', unnest({O.ioc_list_sql('hashes')}) FROM bs UNION ALL
       SELECT doc_id, 'cves', unnest({O.ioc_list_sql('cves')}) FROM bs),
a AS (SELECT ioc_type, ioc, count(DISTINCT doc_id) AS docs_a FROM iocl GROUP BY ALL),
b AS (SELECT ioc_type, ioc, count(DISTINCT doc_id) AS docs_b FROM bl GROUP BY ALL)
SELECT ioc_type, ioc, docs_a, docs_b FROM a JOIN b USING (ioc_type, ioc)""")
def adv13_osint_and_structured(spark, sf_dir):
    """OSINT = documents; structured = benchmark, its rows with an address and a host of the key's own."""
    from tidewatch.operators.indicators import cross_source_iocs, ioc_long
    k = F.col("item_id")
    text = F.concat("text", F.lit(" 10.0."), (k % 9).cast("string"), F.lit("."), (k % 31).cast("string"), F.lit(" host"), k.cast("string"), F.lit(".evil.com"))
    b = load_table(spark, sf_dir, "benchmark").select(k.alias("doc_id"), text.alias("text")).transform(Pp.add_clean_text)
    return cross_source_iocs(ioc_long(C.prepared(spark, sf_dir)), ioc_long(b))


# --- whole pipeline with external scores: every document is scored -------------------------------
def _pipeline_scored(method, baseline):
    def query(spark, sf_dir):
        from tidewatch.plans.pipeline import run_pipeline
        from tidewatch.sources.tables import gazetteer, model_scores, osint_documents
        ext = model_scores(spark, sf_dir).filter("model = 'm1'").select("doc_id", F.lit("BERT").alias("model"), "prob")
        cfg = DEFAULT_CONFIG.with_(balance_method=method, do_baseline=baseline)
        s = run_pipeline(spark, osint_documents(spark, sf_dir), cfg, C.tech_dict(spark), gazetteer(spark, sf_dir),
                         external_scores=ext, train_model=False).scored
        return _bigints(s.withColumn("mitre_matches", F.array_join("mitre_matches", ",")).select(*SCORED_COLS), FEATURE_COLS)
    return query


_ALL_SCORED = f"""{_SCORED}
SELECT doc_id, CAST(label AS BIGINT) AS label, num_ips, num_domains, num_hashes, num_cves, cyber_keyword_count,
       mitre_matches, model_prob, ioc_score, centrality_score, threat_score, alert FROM scored"""
for _method in (None, "undersample", "oversample"):
    register(f"pipeline_scored_{_method or 'unbalanced'}", _ALL_SCORED)(_pipeline_scored(_method, _method is not None))


# --- SMP4, FLT6, KG11, ADV2 --------------------------------------------------------------------------
@register("smp4_unknown_method", f"WITH {O.prep_ctes()} SELECT doc_id, CAST(label AS BIGINT) AS label FROM feat")
def smp4_unknown_method(spark, sf_dir):
    from tidewatch.operators.sampling import balance
    d = C.features(spark, sf_dir).select("doc_id", F.col("label").cast("bigint").alias("label"))
    return balance(d, "no such method")


@register("flt6_features_off", f"WITH {O.prep_ctes()} SELECT doc_id, CAST(label AS BIGINT) AS label FROM feat")
def flt6_features_off(spark, sf_dir):
    """Indicator counts and technique tags switched off: their columns are not made at all."""
    from tidewatch.sources.tables import osint_documents
    cfg = DEFAULT_CONFIG.with_(do_ioc_features=False, do_mitre_mapping=False)
    d = Pp.prepare_documents(osint_documents(spark, sf_dir), cfg, technique_dict=C.tech_dict(spark))
    return d.drop("text", "source", "clean_text").withColumn("label", F.col("label").cast("bigint"))


@register("kg11_null_tags", f"""WITH {O.prep_ctes()}{O.tags_ctes()}
SELECT doc_id, technique_id FROM doc_tech WHERE doc_id % 3 <> 0""")
def kg11_null_tags(spark, sf_dir):
    """Documents whose tag array is NULL (here every third) give no technique rows and no error."""
    from tidewatch.operators.graph import technique_long
    t = C.tagged(spark, sf_dir).withColumn("mitre_matches", F.when(F.col("doc_id") % 3 != 0, F.col("mitre_matches")))
    return technique_long(t).select("doc_id", "technique_id")


@register("adv2_naive_bayes", f"""WITH {O.prep_ctes()},
tok AS (SELECT doc_id, label, unnest(regexp_extract_all(lower(clean_text), '[A-Za-z0-9_]{{2,}}')) AS term FROM feat),
tc AS (SELECT term, count(*) FILTER (WHERE label = 0) AS c0, count(*) FILTER (WHERE label = 1) AS c1 FROM tok GROUP BY term),
n AS (SELECT sum(c0) AS n0, sum(c1) AS n1, count(*) AS v FROM tc),
p AS (SELECT ln((count(*) FILTER (WHERE label = 1) + 1.0) / (count(*) FILTER (WHERE label = 0) + 1.0)) AS prior FROM feat),
s AS (SELECT doc_id, sum(ln((c1 + 1.0) / (n1 + v)) - ln((c0 + 1.0) / (n0 + v))) AS s FROM tok JOIN tc USING (term), n GROUP BY doc_id)
SELECT f.doc_id, round(prior + coalesce(s.s, 0), 6) AS score, CAST(prior + coalesce(s.s, 0) > 0 AS INTEGER) AS pred
FROM feat f LEFT JOIN s USING (doc_id), p""")
def adv2_naive_bayes(spark, sf_dir):
    from tidewatch.operators.models import naive_bayes_scores
    d = C.features(spark, sf_dir).select("doc_id", "clean_text", "label").checkpoint()
    return naive_bayes_scores(d, d).withColumn("score", F.round("score", 6))


# --- SNK1-SNK6, LIM1 written and read back -----------------------------------------------------------
@register("snk1_scored_csv", f"""{_SCORED} SELECT doc_id, mitre_matches, round(threat_score, 6) AS threat_score, alert FROM scored""")
def snk1_scored_csv(spark, sf_dir):
    from tidewatch.sinks import write_scored
    path = _folder(spark, "scored")
    write_scored(C.scored(spark, sf_dir).select("doc_id", "mitre_matches", "threat_score", "alert"), path, "csv")
    r = spark.read.option("header", True).option("escape", "\\").csv(path)
    tags = F.array_join(F.from_json("mitre_matches", "array<string>"), ",")
    return r.select(F.col("doc_id").cast("bigint").alias("doc_id"), tags.alias("mitre_matches"),
                    F.round(F.col("threat_score").cast("double"), 6).alias("threat_score"), F.col("alert").cast("boolean").alias("alert"))


@register("snk2_model_results", f"""{_PRED}
SELECT DISTINCT model, CAST(NULL AS VARCHAR) AS error FROM pred UNION ALL SELECT 'broken', 'no such column'""")
def snk2_model_results(spark, sf_dir):
    """Results of three models and of one whose fit fails: it becomes a record with its error."""
    from tidewatch.operators.metrics import evaluate
    from tidewatch.plans.pipeline import METRIC_SCHEMA, attempt
    from tidewatch.sinks import write_metrics

    def broken():
        raise ValueError("no such column")

    cols = [c.split()[0] for c in METRIC_SCHEMA.split(", ")]
    results = evaluate(C.predictions(spark, sf_dir)).select(*cols).unionByName(attempt(spark, "broken", broken)[1])
    path = _folder(spark, "results")
    write_metrics(results, path)
    return spark.read.schema(METRIC_SCHEMA).json(path).select("model", "error")


@register("snk3_alert_summary", f"""{_SCORED},
top AS (SELECT clean_text, threat_score, doc_id FROM scored WHERE alert ORDER BY threat_score DESC, doc_id LIMIT 10)
SELECT count(*) AS total_alerts, round(avg(threat_score), 6) AS avg_threat_score, round(max(threat_score), 6) AS max_threat_score,
  (SELECT string_agg(clean_text, ' || ' ORDER BY threat_score DESC, doc_id) FROM top) AS examples FROM scored WHERE alert HAVING count(*) > 0""")
def snk3_alert_summary(spark, sf_dir):
    """AGG10 with its examples, through the JSON file."""
    from tidewatch.operators.scoring import alert_summary
    from tidewatch.sinks import write_alert_summary
    s = alert_summary(C.scored(spark, sf_dir)).checkpoint()
    path = _folder(spark, "summary")
    if not write_alert_summary(s, path):
        return s.select("total_alerts", "avg_threat_score", "max_threat_score", F.lit("").alias("examples"))
    r = spark.read.schema(s.schema).json(path)
    return r.select("total_alerts", F.round("avg_threat_score", 6).alias("avg_threat_score"), F.round("max_threat_score", 6).alias("max_threat_score"),
                    F.array_join(F.transform("alert_examples", lambda e: e["clean_text"]), " || ").alias("examples"))


def _graph_rows(spark, sf_dir, load: bool):
    from tidewatch import sinks
    _, _, _, nodes, edges = C.graph(spark, sf_dir)
    path = _folder(spark, "graph")
    (sinks.write_graph_load_rows if load else sinks.write_graph)(nodes, edges, path)
    return path


@register("snk4_graph_files", f"""{_GRAPH_BASE}{O.graph_ctes()}
SELECT 'node' AS kind, id AS a, type AS b, entity_label AS c FROM nodes UNION ALL SELECT 'edge', src, dst, relation FROM edges""")
def snk4_graph_files(spark, sf_dir):
    path = _graph_rows(spark, sf_dir, False)
    n = spark.read.parquet(f"{path}/nodes").select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("type").alias("b"), F.col("entity_label").alias("c"))
    return n.unionByName(spark.read.parquet(f"{path}/edges").select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("relation").alias("c")))


@register("snk5_graph_load_rows", f"""{_GRAPH_BASE}{O.graph_ctes()}
SELECT DISTINCT src AS u, dst AS v, relation AS type FROM edges UNION ALL SELECT id, 'node', type FROM nodes""")
def snk5_graph_load_rows(spark, sf_dir):
    path = _graph_rows(spark, sf_dir, True)
    read = spark.read.option("header", True).option("escape", "\\")
    n = read.csv(f"{path}/nodes").select(F.col("id").alias("u"), F.lit("node").alias("v"), F.get_json_object("attrs", "$.type").alias("type"))
    return read.csv(f"{path}/edges").select("u", "v", "type").unionByName(n)


@register("lim1_load_batches", f"""{_GRAPH_BASE}{O.graph_ctes()}
SELECT (SELECT count(*) FROM (SELECT DISTINCT src, dst, relation FROM edges)) AS n_rows, true AS within_batch""")
def lim1_load_batches(spark, sf_dir):
    """Edges of the load table, and whether every transaction batch has at most 500 of them."""
    e = spark.read.option("header", True).csv(f"{_graph_rows(spark, sf_dir, True)}/edges")
    return e.groupBy("batch").count().agg(F.sum("count").alias("n_rows"), (F.max("count") <= 500).alias("within_batch"))


@register("snk6_model_reload", f"""WITH {O.prep_ctes()} SELECT doc_id, true AS same_score FROM feat""")
def snk6_model_reload(spark, sf_dir):
    """A fitted model saved, loaded again and applied: the same probability for every document."""
    from tidewatch.operators.models import fit_text_classifier, score_documents
    from tidewatch.operators.sampling import stratified_split
    from tidewatch.sinks import load_model, save_model
    d = stratified_split(C.features(spark, sf_dir).select("doc_id", "clean_text", "label"), "label", 0.2, 42).checkpoint()
    model, _ = fit_text_classifier(d)
    path = _folder(spark, "model")
    save_model(model, path)
    a = score_documents(d, model).select("doc_id", F.col("prob").alias("before"))
    b = score_documents(d, load_model(path)).select("doc_id", F.col("prob").alias("after"))
    return a.join(b, "doc_id").select("doc_id", (F.abs(F.col("before") - F.col("after")) < 1e-12).alias("same_score"))
