"""Query catalogue: one Spark query and one DuckDB oracle per inventory ID.

Each Spark query takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole given tables; each oracle is a self-contained DuckDB statement over
the same parquet views. Column names and types agree on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.functions.patterns import IOC_TYPES
from tidewatch.operators import prepare as Pp
from tidewatch.operators import techniques as Tq
from tidewatch.plans import corpus as C
from tidewatch.plans import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


FEATURE_COLS = ["label", "cyber_keyword_count", "num_ips", "num_domains", "num_hashes", "num_cves"]


def _bigints(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


# --- flagship: minimum slice ------------------------------------------------
@register("features_by_source", f"""
WITH {O.prep_ctes()}
SELECT source, CAST(label AS BIGINT) AS label, count(*) AS docs,
       CAST(sum(cyber_keyword_count) AS BIGINT) AS keyword_hits,
       CAST(sum(num_ips) AS BIGINT) AS ips, CAST(sum(num_domains) AS BIGINT) AS domains,
       CAST(sum(num_hashes) AS BIGINT) AS hashes, CAST(sum(num_cves) AS BIGINT) AS cves
FROM feat GROUP BY source, label""")
def features_by_source(spark, sf_dir):
    f = C.features(spark, sf_dir)
    return (f.groupBy("source", F.col("label").cast("bigint").alias("label"))
            .agg(F.count(F.lit(1)).alias("docs"),
                 F.sum("cyber_keyword_count").cast("bigint").alias("keyword_hits"),
                 F.sum("num_ips").cast("bigint").alias("ips"),
                 F.sum("num_domains").cast("bigint").alias("domains"),
                 F.sum("num_hashes").cast("bigint").alias("hashes"),
                 F.sum("num_cves").cast("bigint").alias("cves")))


# --- STR1-8, PRJ3, FLT1 -------------------------------------------------------
@register("str_clean_text", f"""
WITH {O.prep_ctes(False)}
SELECT doc_id, clean_text FROM cleaned WHERE clean_text <> ''""")
def str_clean_text(spark, sf_dir):
    return C.cleaned(spark, sf_dir).transform(Pp.drop_empty).select("doc_id", "clean_text")


@register("str4_drop_hashtags", f"""
WITH osint AS ({O.OSINT_SQL})
SELECT doc_id, {O.clean_sql('text', False)} AS clean_text FROM osint""")
def str4_drop_hashtags(spark, sf_dir):
    from tidewatch.sources.tables import ensure_parallelism, osint_documents
    d = ensure_parallelism(osint_documents(spark, sf_dir))
    return d.select("doc_id", T.clean_text("text", keep_hashtag_word=False).alias("clean_text"))


@register("str_clean_pages", f"""
SELECT page_id, {O.clean_sql('html')} AS clean_text FROM pages""")
def str_clean_pages(spark, sf_dir):
    from tidewatch.sources.tables import ensure_parallelism, load_table
    p = ensure_parallelism(load_table(spark, sf_dir, "pages"))
    return p.select("page_id", T.clean_text("html").alias("clean_text"))


# --- AGG6 ---------------------------------------------------------------------
@register("agg6_dedup_first_wins", f"""
WITH {O.prep_ctes(False)}
SELECT doc_id, source, clean_text FROM prep""")
def agg6_dedup_first_wins(spark, sf_dir):
    return C.prepared(spark, sf_dir).select("doc_id", "source", "clean_text")


# --- TXT1, TXT2, IOC6 -----------------------------------------------------------
@register("txt_ioc_features", f"""
WITH {O.prep_ctes()}
SELECT doc_id, CAST(label AS BIGINT) AS label, cyber_keyword_count, num_ips, num_domains,
       num_hashes, num_cves FROM feat""")
def txt_ioc_features(spark, sf_dir):
    return _bigints(C.features(spark, sf_dir).select("doc_id", *FEATURE_COLS), FEATURE_COLS)


@register("txt2_keyword_count_custom", f"""
WITH {O.prep_ctes(False)}
SELECT doc_id, CAST(regexp_matches(clean_text, '(?i)\\bc2\\b') AS BIGINT)
             + CAST(regexp_matches(clean_text, '(?i)\\bspearphishing link\\b') AS BIGINT)
             + CAST(regexp_matches(clean_text, '(?i)\\bevil\\.com\\b') AS BIGINT) AS keyword_count
FROM prep""")
def txt2_keyword_count_custom(spark, sf_dir):
    kws = ["c2", "spearphishing link", "evil.com"]
    return C.prepared(spark, sf_dir).select(
        "doc_id", T.keyword_count("clean_text", kws).cast("bigint").alias("keyword_count"))


# --- IOC1-5, IOC7 ---------------------------------------------------------------
def _ioc_long_sql():
    parts = []
    for k in IOC_TYPES:
        parts.append(f"""SELECT doc_id, '{k}' AS ioc_type, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos,
       unnest(l) AS ioc FROM (SELECT doc_id, {O.ioc_list_sql(k)} AS l FROM prep)""")
    return f"WITH {O.prep_ctes(False)}\n" + "\nUNION ALL\n".join(parts)


@register("ioc_long", _ioc_long_sql())
def ioc_long(spark, sf_dir):
    from tidewatch.operators.indicators import ioc_long as _long
    return _long(C.prepared(spark, sf_dir)).withColumn("pos", F.col("pos").cast("bigint"))


# --- AGG3, AGG5 -----------------------------------------------------------------
@register("agg3_label_totals", f"""
WITH {O.prep_ctes()}
SELECT CAST(sum(label) AS BIGINT) AS positives, CAST(count(*) - sum(label) AS BIGINT) AS negatives FROM feat""")
def agg3_label_totals(spark, sf_dir):
    return Pp.label_totals(C.features(spark, sf_dir))


@register("agg5_stage_counts", f"""
WITH {O.prep_ctes(False)}
SELECT count(*) AS loaded, count(*) FILTER (WHERE clean_text <> '') AS non_empty,
       count(DISTINCT clean_text) FILTER (WHERE clean_text <> '') AS deduplicated FROM cleaned""")
def agg5_stage_counts(spark, sf_dir):
    return Pp.stage_counts(C.cleaned(spark, sf_dir))


# --- DIC1 / JOIN1 / STR9 ----------------------------------------------------------
_TAGS_SQL = f"""
WITH {O.prep_ctes()}{O.tags_ctes()}
SELECT doc_id, mitre_matches FROM tags"""


@register("dic1_technique_tags", _TAGS_SQL)
def dic1_technique_tags(spark, sf_dir):
    t = Tq.tag_techniques(C.features(spark, sf_dir), C.tech_dict(spark), strategy="inline")
    return t.select("doc_id", F.array_join("mitre_matches", ",").alias("mitre_matches"))


@register("join1_technique_tags_vocabulary", _TAGS_SQL)
def join1_technique_tags_vocabulary(spark, sf_dir):
    t = Tq.tag_techniques(C.features(spark, sf_dir).select("doc_id", "clean_text"), C.tech_dict(spark), strategy="vocabulary")
    return t.select("doc_id", F.array_join("mitre_matches", ",").alias("mitre_matches"))


@register("join1_technique_tags_automaton", _TAGS_SQL)
def join1_technique_tags_automaton(spark, sf_dir):
    t = Tq.tag_techniques(C.features(spark, sf_dir).select("doc_id", "clean_text"), C.tech_dict(spark), strategy="automaton")
    return t.select("doc_id", F.array_join("mitre_matches", ",").alias("mitre_matches"))


# --- ENT1 / FLT4 --------------------------------------------------------------------
_GRAPH_BASE = f"WITH {O.prep_ctes()}{O.tags_ctes()}{O.entity_ctes()}"


@register("ent1_entities", f"""{_GRAPH_BASE}
SELECT doc_id, pos, ent_text, ent_label FROM ents""")
def ent1_entities(spark, sf_dir):
    return C.entities(spark, sf_dir)


# --- KG1-KG11, SET2, SET3, JOIN4, JOIN5 ---------------------------------------------------
@register("kg_nodes", f"""{_GRAPH_BASE}{O.graph_ctes()}
SELECT id, type, entity_label FROM nodes""")
def kg_nodes(spark, sf_dir):
    return C.graph(spark, sf_dir)[3]


@register("kg_edges", f"""{_GRAPH_BASE}{O.graph_ctes()}
SELECT src, dst, relation FROM edges""")
def kg_edges(spark, sf_dir):
    return C.graph(spark, sf_dir)[4]


# --- AGG7 ---------------------------------------------------------------------------
@register("agg7_graph_size", f"""{_GRAPH_BASE}{O.graph_ctes()}
SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges""")
def agg7_graph_size(spark, sf_dir):
    from tidewatch.operators.graph import graph_size
    _, _, _, n, e = C.graph(spark, sf_dir)
    return graph_size(n, e)


# --- AGG8, KG12 -----------------------------------------------------------------------
@register("kg12_degree_centrality", f"""{_GRAPH_BASE}{O.graph_ctes()}
SELECT id, degree, centrality FROM cent""")
def kg12_degree_centrality(spark, sf_dir):
    from tidewatch.operators.graph import degree_centrality
    _, _, _, n, e = C.graph(spark, sf_dir)
    return degree_centrality(n, e)


# --- JOIN6, AGG9, SCR2 ------------------------------------------------------------------
@register("agg9_doc_centrality", f"""{_GRAPH_BASE}{O.graph_ctes()}
SELECT f.doc_id, coalesce((SELECT max(c.centrality) FROM ents e JOIN cent c ON c.id = 'ENT::' || e.ent_text
                           WHERE e.doc_id = f.doc_id), 0.0) * 0.2 AS centrality_score
FROM feat f""")
def agg9_doc_centrality(spark, sf_dir):
    from tidewatch.operators.graph import degree_centrality, doc_centrality
    t, e, _, n, ed = C.graph(spark, sf_dir)
    return doc_centrality(t.select("doc_id"), e, degree_centrality(n, ed))


# --- ADV12 ------------------------------------------------------------------------------
@register("adv12_technique_entity_cve", f"""{_GRAPH_BASE}{O.graph_ctes()},
te AS (SELECT CASE WHEN starts_with(src, 'ENT::') THEN src ELSE dst END AS entity,
              CASE WHEN starts_with(src, 'ENT::') THEN dst ELSE src END AS technique
       FROM edges WHERE relation = 'uses_technique'),
ce AS (SELECT CASE WHEN starts_with(src, 'ENT::') THEN src ELSE dst END AS entity,
              CASE WHEN starts_with(src, 'ENT::') THEN dst ELSE src END AS cve
       FROM edges WHERE relation = 'mentions_cve')
SELECT DISTINCT te.technique, te.entity, ce.cve FROM te JOIN ce ON te.entity = ce.entity""")
def adv12_technique_entity_cve(spark, sf_dir):
    from tidewatch.operators.graph import technique_entity_cve_chains
    return technique_entity_cve_chains(C.graph(spark, sf_dir)[4])


# --- AGG1, AGG2, AGG4 --------------------------------------------------------------
_KEY = "md5('42:' || CAST(doc_id AS VARCHAR))"


def _labeled(spark, sf_dir):
    return C.features(spark, sf_dir).select("doc_id", F.col("label").cast("bigint").alias("label"))


@register("agg1_class_counts", f"""WITH {O.prep_ctes()}
SELECT CAST(label AS BIGINT) AS label, count(*) AS count FROM feat GROUP BY label""")
def agg1_class_counts(spark, sf_dir):
    from tidewatch.operators.sampling import class_counts
    return class_counts(_labeled(spark, sf_dir))


@register("agg2_class_count_range", f"""WITH {O.prep_ctes()},
c AS (SELECT label, count(*) AS n FROM feat GROUP BY label)
SELECT min(n) AS min_count, max(n) AS max_count FROM c""")
def agg2_class_count_range(spark, sf_dir):
    from tidewatch.operators.sampling import class_count_range
    return class_count_range(_labeled(spark, sf_dir))


@register("agg4_class_weight", f"""WITH {O.prep_ctes()}
SELECT CAST(greatest(1, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END)) AS DOUBLE)
       / greatest(1, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END)) AS pos_weight FROM feat""")
def agg4_class_weight(spark, sf_dir):
    from tidewatch.operators.sampling import class_weight
    return class_weight(_labeled(spark, sf_dir))


# --- SMP1-SMP6, ADV7 ------------------------------------------------------------------
@register("smp1_exact_sample", f"""WITH {O.prep_ctes()}
SELECT doc_id FROM feat QUALIFY row_number() OVER (ORDER BY {_KEY}, doc_id) <= 500""")
def smp1_exact_sample(spark, sf_dir):
    from tidewatch.operators.sampling import exact_sample
    return exact_sample(_labeled(spark, sf_dir), 500, 42).select("doc_id")


@register("smp2_undersample", f"""WITH {O.prep_ctes()},
c AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM feat GROUP BY label))
SELECT doc_id, CAST(label AS BIGINT) AS label FROM feat
QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_KEY}, doc_id) <= (SELECT m FROM c)""")
def smp2_undersample(spark, sf_dir):
    from tidewatch.operators.sampling import undersample
    return undersample(_labeled(spark, sf_dir))


@register("smp3_oversample", f"""WITH {O.prep_ctes()},
cls AS (SELECT label, count(*) AS n FROM feat GROUP BY label),
mx AS (SELECT max(n) AS m FROM cls),
ranked AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {_KEY}, doc_id) - 1 AS rk FROM feat),
draws AS (SELECT c.label, ('0x' || substr(md5('42:' || CAST(c.label AS VARCHAR) || ':' || CAST(d.i AS VARCHAR)), 1, 15))::BIGINT % c.n AS rk
          FROM cls c CROSS JOIN mx CROSS JOIN range(0, (SELECT m FROM mx)) d(i) WHERE c.n < mx.m),
picked AS (SELECT r.doc_id, r.label FROM draws d JOIN ranked r ON r.label = d.label AND r.rk = d.rk
           UNION ALL SELECT doc_id, label FROM feat WHERE label IN (SELECT label FROM cls, mx WHERE n = m))
SELECT doc_id, CAST(label AS BIGINT) AS label, count(*) AS copies FROM picked GROUP BY doc_id, label""")
def smp3_oversample(spark, sf_dir):
    from tidewatch.operators.sampling import oversample
    o = oversample(_labeled(spark, sf_dir))
    return o.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("copies"))


@register("smp5_stratified_split", f"""WITH {O.prep_ctes()},
cls AS (SELECT label, count(*) AS c FROM feat GROUP BY label),
tot AS (SELECT sum(c) AS n, CAST(ceil(CAST(0.2 AS DOUBLE) * sum(c)) AS BIGINT) AS nt FROM cls),
q0 AS (SELECT label, (c * nt) // n AS base, (c * nt) % n AS rem FROM cls, tot),
q1 AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, label)
                                  <= (SELECT nt FROM tot) - (SELECT sum(base) FROM q0) THEN 1 ELSE 0 END AS quota FROM q0),
ranked AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {_KEY}, doc_id) AS rn FROM feat)
SELECT doc_id, CAST(label AS BIGINT) AS label, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split
FROM ranked JOIN q1 USING (label)""")
def smp5_stratified_split(spark, sf_dir):
    from tidewatch.operators.sampling import stratified_split
    return stratified_split(_labeled(spark, sf_dir), test_size=0.2)


@register("smp6_shuffle_order", f"""WITH {O.prep_ctes()}
SELECT doc_id, row_number() OVER (ORDER BY {_KEY}, doc_id) - 1 AS position FROM feat""")
def smp6_shuffle_order(spark, sf_dir):
    from tidewatch.operators.sampling import dense_positions, shuffle_rows
    return dense_positions(shuffle_rows(_labeled(spark, sf_dir), 42)).select("doc_id", "position")


@register("adv7_cv_folds", f"""WITH {O.prep_ctes()}
SELECT doc_id, CAST(label AS BIGINT) AS label,
       CAST((row_number() OVER (PARTITION BY label ORDER BY {_KEY}, doc_id) - 1) % 5 AS INTEGER) AS fold
FROM feat""")
def adv7_cv_folds(spark, sf_dir):
    from tidewatch.operators.sampling import cv_folds
    return cv_folds(_labeled(spark, sf_dir), 5)


# --- SRC7, JOIN2, IOC8, JOIN3 --------------------------------------------------------------
_REP_CTES = f"""WITH {O.prep_ctes()}{O.ioc_long_cte()},
rep AS (SELECT DISTINCT ioc_type, ioc, CAST(length(ioc) % 7 AS INTEGER) AS malicious_score FROM iocl
        WHERE ioc_type IN ('ips', 'domains', 'hashes') AND length(ioc) % 3 <> 0),
enr AS (SELECT i.doc_id, i.ioc_type, i.ioc, coalesce(r.malicious_score, 0) AS malicious_score
        FROM iocl i LEFT JOIN rep r ON r.ioc_type = i.ioc_type AND r.ioc = i.ioc)"""


def _enriched(spark, sf_dir):
    from tidewatch.operators import indicators as I
    # read by the occurrences, the reputation table, its size and the list of documents: cleaned and scanned once
    f = C.features(spark, sf_dir).select("doc_id", "clean_text").checkpoint()
    i = I.ioc_long(f).checkpoint()
    return f, I.enrich_iocs(i, I.reputation_fixture(i))


@register("join2_ioc_reputation", f"""{_REP_CTES}
SELECT doc_id, ioc_type, ioc, malicious_score FROM enr""")
def join2_ioc_reputation(spark, sf_dir):
    return _enriched(spark, sf_dir)[1].select("doc_id", "ioc_type", "ioc", "malicious_score")


@register("ioc8_reputation_long", f"""{_REP_CTES}
SELECT DISTINCT doc_id, ioc_type || '_' || ioc AS key, malicious_score FROM enr""")
def ioc8_reputation_long(spark, sf_dir):
    from tidewatch.operators.indicators import doc_reputation_long
    return doc_reputation_long(_enriched(spark, sf_dir)[1])


@register("join3_doc_reputation", f"""{_REP_CTES},
per AS (SELECT doc_id, count(*) AS enriched_iocs, CAST(max(malicious_score) AS BIGINT) AS max_malicious_score,
               CAST(sum(malicious_score) AS BIGINT) AS sum_malicious_score
        FROM (SELECT DISTINCT doc_id, ioc_type || '_' || ioc AS key, malicious_score FROM enr) GROUP BY doc_id)
SELECT f.doc_id, coalesce(p.enriched_iocs, 0) AS enriched_iocs, coalesce(p.max_malicious_score, 0) AS max_malicious_score,
       coalesce(p.sum_malicious_score, 0) AS sum_malicious_score
FROM feat f LEFT JOIN per p USING (doc_id)""")
def join3_doc_reputation(spark, sf_dir):
    from tidewatch.operators.indicators import attach_reputation
    f, e = _enriched(spark, sf_dir)
    return attach_reputation(f.select("doc_id"), e)


@register("adv13_cross_source_iocs", f"""WITH {O.prep_ctes()}{O.ioc_long_cte()},
a AS (SELECT i.ioc_type, i.ioc, count(DISTINCT i.doc_id) AS docs_a FROM iocl i JOIN feat f USING (doc_id)
      WHERE f.source < 'src5' GROUP BY ALL),
b AS (SELECT i.ioc_type, i.ioc, count(DISTINCT i.doc_id) AS docs_b FROM iocl i JOIN feat f USING (doc_id)
      WHERE f.source >= 'src5' GROUP BY ALL)
SELECT ioc_type, ioc, docs_a, docs_b FROM a JOIN b USING (ioc_type, ioc)""")
def adv13_cross_source_iocs(spark, sf_dir):
    from tidewatch.operators.indicators import cross_source_iocs, ioc_long
    f = C.features(spark, sf_dir)
    i = ioc_long(f).join(f.select("doc_id", "source"), "doc_id")
    return cross_source_iocs(i.filter(F.col("source") < "src5"), i.filter(F.col("source") >= "src5"))


# --- MET1-MET8, ADV5, ADV6, ADV8, ADV9 ----------------------------------------------------------
_PRED = f"WITH {O.prep_ctes()}{O.pred_ctes()}"
_CLS = """CAST(sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
          CAST(sum(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
          CAST(sum(CASE WHEN y_true = 1 AND y_pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
          avg(CAST(y_true = y_pred AS DOUBLE)) AS accuracy"""
_CLS_OUT = """accuracy,
       CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END AS precision,
       CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END AS recall,
       CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1"""
_AUC_PAIRS = """auc AS (
  SELECT model, CASE WHEN P > 0 AND N > 0 THEN CAST(2 * gt + eq AS DOUBLE) / CAST(2 * P * N AS DOUBLE) END AS roc_auc
  FROM (SELECT m.model,
               (SELECT count(*) FROM pred WHERE model = m.model AND y_true = 1) AS P,
               (SELECT count(*) FROM pred WHERE model = m.model AND y_true <> 1) AS N,
               (SELECT count(*) FROM pred a JOIN pred b ON a.model = b.model
                 WHERE a.model = m.model AND a.y_true = 1 AND b.y_true <> 1 AND a.y_score > b.y_score) AS gt,
               (SELECT count(*) FROM pred a JOIN pred b ON a.model = b.model
                 WHERE a.model = m.model AND a.y_true = 1 AND b.y_true <> 1 AND a.y_score = b.y_score) AS eq
        FROM (SELECT DISTINCT model FROM pred) m))"""


@register("met1_4_classification", f"""{_PRED}
SELECT model, {_CLS_OUT} FROM (SELECT model, {_CLS} FROM pred GROUP BY model)""")
def met1_4_classification(spark, sf_dir):
    from tidewatch.operators.metrics import classification_metrics
    return classification_metrics(C.predictions(spark, sf_dir))


@register("met5_roc_auc", f"""{_PRED}, {_AUC_PAIRS}
SELECT model, roc_auc FROM auc""")
def met5_roc_auc(spark, sf_dir):
    from tidewatch.operators.metrics import roc_auc
    return roc_auc(C.predictions(spark, sf_dir))


@register("met6_roc_points", f"""{_PRED},
ds AS (SELECT model, y_score, sum(CASE WHEN y_true = 1 THEN 1 ELSE 0 END) AS pos,
              sum(CASE WHEN y_true <> 1 THEN 1 ELSE 0 END) AS neg FROM pred GROUP BY model, y_score),
cum AS (SELECT model, y_score, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn,
               sum(pos) OVER (PARTITION BY model) AS P, sum(neg) OVER (PARTITION BY model) AS N
        FROM ds WINDOW w AS (PARTITION BY model ORDER BY y_score DESC ROWS UNBOUNDED PRECEDING))
SELECT model, y_score AS threshold,
       CASE WHEN N = 0 THEN 0.0 ELSE CAST(cn AS DOUBLE) / CAST(N AS DOUBLE) END AS fpr,
       CASE WHEN P = 0 THEN 0.0 ELSE CAST(cp AS DOUBLE) / CAST(P AS DOUBLE) END AS tpr FROM cum""")
def met6_roc_points(spark, sf_dir):
    from tidewatch.operators.metrics import roc_points
    return roc_points(C.predictions(spark, sf_dir))


@register("met7_pr_auc", f"""{_PRED},
ds AS (SELECT model, y_score, sum(CASE WHEN y_true = 1 THEN 1 ELSE 0 END) AS pos,
              sum(CASE WHEN y_true <> 1 THEN 1 ELSE 0 END) AS neg FROM pred GROUP BY model, y_score),
cum AS (SELECT model, pos, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY model) AS P
        FROM ds WINDOW w AS (PARTITION BY model ORDER BY y_score DESC ROWS UNBOUNDED PRECEDING))
SELECT model, round(CASE WHEN max(P) > 0 THEN sum(pos * CAST(cp AS DOUBLE) / CAST(cp + cn AS DOUBLE)) / max(P) END, 9) AS pr_auc
FROM cum GROUP BY model""")
def met7_pr_auc(spark, sf_dir):
    from tidewatch.operators.metrics import pr_auc
    p = pr_auc(C.predictions(spark, sf_dir))
    return p.withColumn("pr_auc", F.round("pr_auc", 9))


@register("met8_model_comparison", f"""{_PRED}
SELECT model, {_CLS_OUT} FROM (SELECT model, {_CLS} FROM pred GROUP BY model)""")
def met8_model_comparison(spark, sf_dir):
    from tidewatch.operators.metrics import comparison_table, evaluate
    return comparison_table(evaluate(C.predictions(spark, sf_dir)))


@register("adv8_confusion_matrix", f"""{_PRED}
SELECT model, y_true, y_pred, count(*) AS count FROM pred GROUP BY ALL""")
def adv8_confusion_matrix(spark, sf_dir):
    from tidewatch.operators.metrics import confusion_matrix
    return confusion_matrix(C.predictions(spark, sf_dir))


@register("adv5_majority_vote", f"""{_PRED}
SELECT doc_id, CAST(CASE WHEN 2 * sum(y_pred) > count(*) THEN 1 WHEN 2 * sum(y_pred) < count(*) THEN 0
                         ELSE CAST(avg(y_score) > 0.5 AS INTEGER) END AS INTEGER) AS y_pred,
       round(avg(y_score), 9) AS mean_prob
FROM pred GROUP BY doc_id""")
def adv5_majority_vote(spark, sf_dir):
    from tidewatch.operators.metrics import majority_vote
    return majority_vote(C.predictions(spark, sf_dir)).withColumn("mean_prob", F.round("mean_prob", 9))


@register("adv6_confidence_aggregate", f"""{_PRED},
g AS (SELECT doc_id, sum(abs(y_score - 0.5) * 2 * y_score) AS wp, sum(abs(y_score - 0.5) * 2) AS w,
             avg(y_score) AS m FROM pred GROUP BY doc_id)
SELECT doc_id, round(CASE WHEN w > 0 THEN wp / w ELSE m END, 9) AS prob,
       round(greatest(CASE WHEN w > 0 THEN wp / w ELSE m END, 1 - CASE WHEN w > 0 THEN wp / w ELSE m END), 9) AS confidence
FROM g""")
def adv6_confidence_aggregate(spark, sf_dir):
    from tidewatch.operators.metrics import confidence_aggregate
    c = confidence_aggregate(C.predictions(spark, sf_dir))
    return c.select("doc_id", F.round("prob", 9).alias("prob"), F.round("confidence", 9).alias("confidence"))


@register("adv9_false_positive_reduction", f"""{_PRED},
vote AS (SELECT doc_id, min(y_true) AS y_true,
                CASE WHEN 2 * sum(y_pred) > count(*) THEN 1 WHEN 2 * sum(y_pred) < count(*) THEN 0
                     ELSE CAST(avg(y_score) > 0.5 AS INTEGER) END AS y_pred FROM pred GROUP BY doc_id),
ep AS (SELECT CASE WHEN sum(y_pred) = 0 THEN 0.0
                   ELSE CAST(sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END) AS DOUBLE) / CAST(sum(y_pred) AS DOUBLE) END AS ensemble_precision FROM vote),
sp AS (SELECT model, precision FROM (SELECT model, {_CLS_OUT} FROM (SELECT model, {_CLS} FROM pred GROUP BY model)))
SELECT model, precision, ensemble_precision, ensemble_precision - precision AS precision_delta FROM sp, ep""")
def adv9_false_positive_reduction(spark, sf_dir):
    from tidewatch.operators.metrics import false_positive_reduction
    return false_positive_reduction(C.predictions(spark, sf_dir))


# --- JOIN7, SCR1-SCR3, FLT2, FLT3, AGG10, AGG11, LIM2 ------------------------------------------
_SCORED = f"{_GRAPH_BASE}{O.graph_ctes()}{O.scored_ctes()}"
SCORED_COLS = ["doc_id", "label", "num_ips", "num_domains", "num_hashes", "num_cves", "cyber_keyword_count",
               "mitre_matches", "model_prob", "ioc_score", "centrality_score", "threat_score", "alert"]


@register("scr_threat_scores", f"""{_SCORED}
SELECT doc_id, CAST(label AS BIGINT) AS label, num_ips, num_domains, num_hashes, num_cves, cyber_keyword_count,
       mitre_matches, model_prob, ioc_score, centrality_score, threat_score, alert FROM scored""")
def scr_threat_scores(spark, sf_dir):
    s = C.scored(spark, sf_dir)
    s = s.withColumn("mitre_matches", F.array_join("mitre_matches", ","))
    return _bigints(s.select(*SCORED_COLS), FEATURE_COLS)


@register("flt3_alerts", f"""{_SCORED}
SELECT doc_id, threat_score FROM scored WHERE alert""")
def flt3_alerts(spark, sf_dir):
    from tidewatch.operators.scoring import alerts
    return alerts(C.scored(spark, sf_dir)).select("doc_id", "threat_score")


@register("agg10_alert_summary", f"""{_SCORED}
SELECT count(*) AS total_alerts, round(avg(threat_score), 9) AS avg_threat_score,
       max(threat_score) AS max_threat_score FROM scored WHERE alert HAVING count(*) > 0""")
def agg10_alert_summary(spark, sf_dir):
    from tidewatch.operators.scoring import alert_summary
    s = alert_summary(C.scored(spark, sf_dir))
    return s.select("total_alerts", F.round("avg_threat_score", 9).alias("avg_threat_score"), "max_threat_score")


@register("lim2_alert_examples", f"""{_SCORED}
SELECT doc_id, clean_text, threat_score, alert FROM scored WHERE alert
ORDER BY threat_score DESC, doc_id LIMIT 10""")
def lim2_alert_examples(spark, sf_dir):
    from tidewatch.operators.scoring import alert_examples
    return alert_examples(C.scored(spark, sf_dir), 10)


@register("agg11_alert_total", f"""{_SCORED}
SELECT CAST(coalesce(sum(CAST(alert AS INTEGER)), 0) AS BIGINT) AS total_alerts FROM scored""")
def agg11_alert_total(spark, sf_dir):
    from tidewatch.operators.scoring import alert_total
    return alert_total(C.scored(spark, sf_dir))


# --- ADV1 ----------------------------------------------------------------------------------
@register("adv1_tfidf", f"""WITH {O.prep_ctes(False)},
toks AS (SELECT doc_id, regexp_extract_all(lower(clean_text), '[A-Za-z0-9_]{{2,}}') AS t FROM prep),
grams AS (SELECT doc_id, unnest(t) AS term FROM toks
          UNION ALL SELECT doc_id, t[i] || ' ' || t[i + 1] FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM toks)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
st AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM tf GROUP BY term),
top AS (SELECT term, df FROM st ORDER BY cf DESC, term LIMIT 20000),
nd AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM prep),
w AS (SELECT tf.doc_id, tf.term, tf.tf, tf.tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS v FROM tf JOIN top USING (term), nd)
SELECT doc_id, term, CAST(tf AS BIGINT) AS tf, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 9) AS tfidf FROM w""")
def adv1_tfidf(spark, sf_dir):
    from tidewatch.operators.models import tfidf_long
    t = tfidf_long(C.prepared(spark, sf_dir), max_features=20000)
    return t.withColumn("tfidf", F.round("tfidf", 9))


# --- MDL1-MDL3, ADV2, ADV4, JOIN8, SCR6, FLT5 (rows-only: fitted models) -------------------------
def _split_features(spark, sf_dir, *more):
    """Read for the split, the fit and the scores: cleaned once."""
    from tidewatch.operators.sampling import stratified_split
    return stratified_split(C.features(spark, sf_dir).select("doc_id", "clean_text", "label", *more).checkpoint(), "label", 0.2, 42)


@register("mdl1_text_classifier_metrics")
def mdl1_text_classifier_metrics(spark, sf_dir):
    from tidewatch.operators.models import fit_text_classifier
    return fit_text_classifier(_split_features(spark, sf_dir))[1]


@register("mdl2_document_scores")
def mdl2_document_scores(spark, sf_dir):
    from tidewatch.operators.models import fit_text_classifier, score_documents
    d = _split_features(spark, sf_dir)
    m, _ = fit_text_classifier(d)
    return score_documents(d, m).select("doc_id", "model", "prob", "pred")


@register("adv4_hybrid_classifier_metrics")
def adv4_hybrid_classifier_metrics(spark, sf_dir):
    from tidewatch.operators.models import fit_text_classifier
    counts = ["num_ips", "num_domains", "num_hashes", "num_cves", "cyber_keyword_count"]
    d = _split_features(spark, sf_dir, *counts)
    d = d.withColumns({c: F.col(c).cast("double") for c in counts})
    return fit_text_classifier(d, extra_numeric=counts, scale=True, model_name="hybrid_lr")[1]


@register("adv3_embedding_classifier")
def adv3_embedding_classifier(spark, sf_dir):
    from tidewatch.operators.models import fit_embedding_classifier
    from tidewatch.sources.tables import load_table
    return fit_embedding_classifier(load_table(spark, sf_dir, "embeddings"))[1]


# --- SCR4, SCR5, SCR6 --------------------------------------------------------------------------
@register("scr4_choose_model", f"""{_PRED}, {_AUC_PAIRS},
r AS (SELECT model, CASE WHEN roc_auc IS NULL OR roc_auc < 0.5 THEN 'auc below chance' END AS error,
             row_number() OVER (ORDER BY model) AS seq FROM auc)
SELECT model FROM r ORDER BY CASE WHEN model = 'm3' AND error IS NULL THEN 0
                                  WHEN model = 'm1' AND error IS NULL THEN 1 ELSE 2 END, seq LIMIT 1""")
def scr4_choose_model(spark, sf_dir):
    """Results from evaluating every model; a model whose AUC is below chance counts as
    failed. Preference: m3, then m1, else the first result."""
    from tidewatch.operators.metrics import roc_auc
    from tidewatch.operators.scoring import choose_model
    a = roc_auc(C.predictions(spark, sf_dir))
    r = a.select("model", F.when(F.col("roc_auc").isNull() | (F.col("roc_auc") < 0.5),
                                 F.lit("auc below chance")).alias("error"),
                 F.col("model").alias("seq"))
    return choose_model(r, ("m3", "m1"))


@register("scr5_probability_fallback", f"""WITH {O.prep_ctes()}{O.pred_ctes()},
s AS (SELECT p.doc_id, max(CASE WHEN p.model = 'm3' AND f.cyber_keyword_count > 0 THEN p.y_score END) AS m3,
             max(CASE WHEN p.model = 'm2' AND f.source < 'src10' THEN p.y_score END) AS m2
      FROM pred p JOIN feat f USING (doc_id) GROUP BY p.doc_id)
SELECT f.doc_id,
       coalesce(s.m3, s.m2, CAST(('0x' || substr(md5('42:' || CAST(f.doc_id AS VARCHAR)), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0) AS model_prob,
       CASE WHEN s.m3 IS NOT NULL THEN 'm3' WHEN s.m2 IS NOT NULL THEN 'm2' ELSE 'random' END AS score_source
FROM feat f LEFT JOIN s USING (doc_id)""")
def scr5_probability_fallback(spark, sf_dir):
    """Preferred model m3 has scores only for keyword-bearing documents, m2 only for
    sources below src10; every other document falls back to the seeded draw."""
    from tidewatch.operators.scoring import probability_with_fallback
    f = C.features(spark, sf_dir)
    p = C.predictions(spark, sf_dir).join(f.select("doc_id", "cyber_keyword_count", "source"), "doc_id")
    avail = p.filter(((F.col("model") == "m3") & (F.col("cyber_keyword_count") > 0)) |
                     ((F.col("model") == "m2") & (F.col("source") < "src10"))) \
             .select("doc_id", "model", F.col("y_score").alias("prob"))
    return probability_with_fallback(f.select("doc_id"), avail, ["m3", "m2"])


@register("scr6_logit_probabilities", f"""WITH {O.prep_ctes()}
SELECT doc_id, round(1.0 / (1.0 + exp(-((doc_id % 21 - 10) / 2.0))), 9) AS p_sigmoid,
       round(1.0 / (1.0 + exp(((doc_id % 7) / 4.0) - ((doc_id % 21 - 10) / 2.0))), 9) AS p_softmax,
       CAST(1.0 / (1.0 + exp(-((doc_id % 21 - 10) / 2.0))) > 0.5 AS INTEGER) AS pred FROM feat""")
def scr6_logit_probabilities(spark, sf_dir):
    """Logits derived from the document key -> sigmoid / two-class softmax -> FLT5 decision."""
    from tidewatch.operators.scoring import binary_decision, sigmoid, softmax_class1
    f = C.features(spark, sf_dir).select("doc_id")
    l1 = ((F.col("doc_id") % 21 - 10) / 2.0)
    l0 = ((F.col("doc_id") % 7) / 4.0)
    return f.select("doc_id", F.round(sigmoid(l1), 9).alias("p_sigmoid"),
                    F.round(softmax_class1(l0, l1), 9).alias("p_softmax"),
                    binary_decision(sigmoid(l1)).alias("pred"))


# --- SRC3, SRC4, PRJ1-PRJ3, SET1 ----------------------------------------------------------------
@register("set1_merge_sources", """
SELECT 'osint' AS source_kind, 0 AS source_rank, coalesce(CAST(text AS VARCHAR), '') AS text FROM documents
UNION ALL SELECT 'osint', 1, coalesce(CAST(text AS VARCHAR), '') FROM conversations
UNION ALL SELECT 'structured', 2, coalesce(CAST(text AS VARCHAR), '') FROM benchmark""")
def set1_merge_sources(spark, sf_dir):
    """documents + conversations (OSINT), pages (no text column: skipped) + benchmark (structured)."""
    from tidewatch.sources.tables import load_table
    from tidewatch.sources.text_sources import merge_sources
    m = merge_sources([load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "conversations")],
                      [load_table(spark, sf_dir, "pages"), load_table(spark, sf_dir, "benchmark")])
    return m.select("source_kind", "source_rank", "text")


# --- ADV10, ADV11 ------------------------------------------------------------------------------
@register("adv10_technique_tactics", f"""{_GRAPH_BASE},
tac AS (SELECT * FROM (VALUES ('T1566', 'initial-access'), ('T1059', 'execution'), ('T1486', 'impact'),
                               ('T1071', 'command-and-control'), ('T1190', 'initial-access'), ('T1219', 'command-and-control'))
        AS x(technique_id, tactic))
SELECT DISTINCT d.doc_id, tac.tactic FROM doc_tech d JOIN tac USING (technique_id)""")
def adv10_technique_tactics(spark, sf_dir):
    from tidewatch.operators.techniques import technique_tactics
    # fixed values: tactic of each fixture technique
    tac = spark.createDataFrame([("T1566", "initial-access"), ("T1059", "execution"), ("T1486", "impact"),
                                 ("T1071", "command-and-control"), ("T1190", "initial-access"),
                                 ("T1219", "command-and-control")], "technique_id STRING, tactic STRING")
    d = C.tech_dict(spark).join(tac, "technique_id")
    return technique_tactics(C.tagged(spark, sf_dir), d)


@register("adv11_cve_mappings", f"""WITH {O.prep_ctes()}{O.ioc_long_cte()},
cves AS (SELECT DISTINCT doc_id, upper(ioc) AS cve FROM iocl WHERE ioc_type = 'cves'),
ct AS (SELECT DISTINCT upper(ioc) AS cve, CAST(length(ioc) + 2 * (CAST(right(ioc, 1) AS INTEGER) % 3) AS BIGINT) AS severity
       FROM iocl WHERE ioc_type = 'cves' AND CAST(right(ioc, 1) AS INTEGER) % 2 = 0)
SELECT cves.doc_id, cves.cve, ct.severity FROM cves LEFT JOIN ct USING (cve)""")
def adv11_cve_mappings(spark, sf_dir):
    """CVE table derived from the corpus (even last digit, a severity rule); odd ids stay unmapped."""
    from tidewatch.operators.indicators import cve_mappings, ioc_long
    i = ioc_long(C.prepared(spark, sf_dir))
    last = F.substring("ioc", -1, 1).cast("int")
    ct = (i.filter((F.col("ioc_type") == "cves") & (last % 2 == 0))
          .select(F.upper("ioc").alias("cve"), (F.length("ioc") + 2 * (last % 3)).cast("bigint").alias("severity"))
          .distinct())
    return cve_mappings(i, ct)
