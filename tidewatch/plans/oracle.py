"""DuckDB SQL building blocks for the oracle side of every catalogued query.

These are independent, definition-level restatements (per-keyword regex
tests, window-based first-row dedup, ``contains`` joins) so that the Spark
implementation is checked against the semantics, not against itself.
"""

from __future__ import annotations

from tidewatch.functions import patterns as P


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


OSINT_SQL = """
SELECT d.doc_id, d.source, concat(d.text,
  CASE WHEN d.doc_id % 4 = 0 THEN concat(' Seen in ', n.n_name, ' via @user', CAST(d.doc_id % 97 AS VARCHAR),
       ' #ransomware http://t.co/', CAST(d.doc_id AS VARCHAR)) ELSE '' END,
  CASE WHEN d.doc_id % 5 = 0 THEN concat(' CVE-2024-', CAST(10000 + d.doc_id % 50 AS VARCHAR),
       ' exploit by ', s.s_name) ELSE '' END,
  CASE WHEN d.doc_id % 6 = 0 THEN concat(' c2 10.0.', CAST(d.doc_id % 8 AS VARCHAR), '.', CAST(d.doc_id % 30 AS VARCHAR),
       ' host', CAST(d.doc_id % 20 AS VARCHAR), '.evil.com') ELSE '' END,
  CASE WHEN d.doc_id % 7 = 0 THEN concat(' spearphishing link powershell ',
       md5(CAST(d.doc_id % 40 AS VARCHAR))) ELSE '' END) AS text
FROM documents d
JOIN nation n ON n.n_nationkey = d.doc_id % 25
JOIN supplier s ON s.s_suppkey = d.doc_id % 10
"""


def clean_sql(col: str, keep_hashtag_word: bool = True) -> str:
    t = f"coalesce(CAST({col} AS VARCHAR), '')"
    t = f"regexp_replace({t}, {q(P.URL_PATTERN)}, ' ', 'g')"
    t = f"regexp_replace({t}, {q(P.MENTION_PATTERN)}, ' ', 'g')"
    t = f"regexp_replace({t}, {q(P.HASHTAG_PATTERN)}, {q(chr(92) + '1' if keep_hashtag_word else ' ')}, 'g')"
    t = f"regexp_replace({t}, {q(P.SCRUB_PATTERN)}, ' ', 'g')"
    return f"lower(trim({t}))"


def _kw_test(col: str, k: str) -> str:
    return f"regexp_matches({col}, {q('(?i)' + chr(92) + 'b' + P.regex_quote(k) + chr(92) + 'b')})"


def label_sql(col: str = "clean_text") -> str:
    return "CAST((" + " OR ".join(_kw_test(col, k) for k in P.CYBER_KEYWORDS) + ") AS INTEGER)"


def keyword_count_sql(col: str = "clean_text") -> str:
    return "(" + " + ".join(f"CAST({_kw_test(col, k)} AS INTEGER)" for k in P.CYBER_KEYWORDS) + ")"


def ioc_list_sql(kind: str, col: str = "clean_text") -> str:
    return f"regexp_extract_all({col}, {q(P.IOC_PATTERNS[kind])})"


def ioc_count_sql(kind: str, col: str = "clean_text") -> str:
    return f"CAST(len({ioc_list_sql(kind, col)}) AS BIGINT)"


# technique dictionary fixture (same rows as tidewatch.sources.tables.technique_fixture)
TECH_DICT_SQL = """
SELECT pos, technique_id, technique_name,
       list_filter(list_transform(string_split(keywords, ';'), lambda x: lower(trim(x))), lambda x: x <> '') AS keywords
FROM (VALUES (0,'T1566','Phishing','phishing;spearphishing link; '), (1,'T1059','Scripting','powershell;cmd.exe'),
       (2,'T1486','Encrypt for impact','ransomware'), (3,'T1071','App-layer protocol','c2;beacon'),
       (4,'T1190','Exploit public app','exploit;cve-'), (5,'T1219','Remote access','rat'))
     AS t(pos, technique_id, technique_name, keywords)
"""

GAZETTEER_SQL = """
SELECT lower(n_name) AS phrase, 'GPE' AS label FROM nation
UNION ALL SELECT lower(r_name), 'LOC' FROM region
UNION ALL SELECT lower(replace(s_name, '#', '')), 'ORG' FROM supplier
UNION ALL SELECT DISTINCT lower(p_name), 'PRODUCT' FROM part
UNION ALL SELECT 'ransomware', 'MISC'
"""

MODEL_SCORES_SQL = """
SELECT doc_id, 'm1' AS model, CAST((doc_id * 7919) % 1000 AS DOUBLE) / 1000.0 AS prob FROM documents
UNION ALL SELECT doc_id, 'm2', CAST((doc_id * 104729) % 1000 AS DOUBLE) / 1000.0 FROM documents
UNION ALL SELECT doc_id, 'm3', CAST((doc_id * 1299709) % 10 AS DOUBLE) / 10.0 FROM documents
"""


def prep_ctes(with_features: bool = True) -> str:
    """CTEs ``osint``, ``cleaned``, ``prep`` (+ ``feat``): the prepared corpus."""
    s = f"""osint AS ({OSINT_SQL}),
cleaned AS (SELECT doc_id, source, text, {clean_sql('text')} AS clean_text FROM osint),
prep AS (SELECT * FROM cleaned WHERE clean_text <> ''
         QUALIFY row_number() OVER (PARTITION BY clean_text ORDER BY doc_id) = 1)"""
    if with_features:
        s += f""",
feat AS (SELECT doc_id, source, text, clean_text, {label_sql()} AS label,
                {ioc_count_sql('ips')} AS num_ips, {ioc_count_sql('domains')} AS num_domains,
                {ioc_count_sql('hashes')} AS num_hashes, {ioc_count_sql('cves')} AS num_cves,
                CAST({keyword_count_sql()} AS BIGINT) AS cyber_keyword_count
         FROM prep)"""
    return s


def tags_ctes() -> str:
    """CTEs ``tdict`` and ``tags(doc_id, mitre_matches VARCHAR)`` on top of ``feat``."""
    return f""",
tdict AS ({TECH_DICT_SQL}),
doc_tech AS (SELECT f.doc_id, t.pos, t.technique_id FROM feat f JOIN tdict t
             ON len(list_filter(t.keywords, lambda k: contains(lower(f.clean_text), k))) > 0),
tags AS (SELECT f.doc_id, coalesce((SELECT string_agg(technique_id, ',' ORDER BY pos) FROM doc_tech x
                                     WHERE x.doc_id = f.doc_id), '') AS mitre_matches
         FROM feat f)"""


def entity_ctes() -> str:
    """CTEs ``gaz``, ``ents(doc_id, pos, ent_text, ent_label)`` on top of ``feat``."""
    labels = ", ".join(q(x) for x in P.ENTITY_LABELS)
    return f""",
gaz0 AS ({GAZETTEER_SQL}),
gaz AS (SELECT phrase, min(label) AS label, len(string_split(phrase, ' ')) AS n
        FROM (SELECT lower(trim(phrase)) AS phrase, label FROM gaz0) WHERE phrase <> '' GROUP BY phrase),
toks AS (SELECT doc_id, string_split(clean_text, ' ') AS t FROM feat),
idx AS (SELECT doc_id, t, unnest(range(0, len(t))) AS i FROM toks),
grams AS (SELECT doc_id, i AS pos, g.n, array_to_string(list_slice(t, i + 1, i + g.n), ' ') AS gram
          FROM idx, (SELECT DISTINCT n FROM gaz) g WHERE i + g.n <= len(t)),
gm AS (SELECT grams.doc_id, grams.pos, grams.n, gaz.phrase AS ent_text, gaz.label AS ent_label
       FROM grams JOIN gaz ON grams.gram = gaz.phrase),
ents AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, ent_text, ent_label FROM gm a
         WHERE NOT EXISTS (SELECT 1 FROM gm b WHERE b.doc_id = a.doc_id AND b.pos <= a.pos
                           AND b.pos + b.n >= a.pos + a.n AND b.n > a.n)
           AND ent_label IN ({labels}))"""


def ioc_long_cte(src: str = "feat") -> str:
    parts = []
    for k in P.IOC_TYPES:
        parts.append(f"""SELECT doc_id, '{k}' AS ioc_type, unnest({ioc_list_sql(k)}) AS ioc FROM {src}""")
    return ",\niocl AS (" + "\nUNION ALL\n".join(parts) + ")"


def graph_ctes() -> str:
    """CTEs ``nodes(id, type, entity_label)``, ``edges(src, dst, relation)``."""
    return f"""{ioc_long_cte()},
gioc AS (SELECT DISTINCT doc_id, CASE ioc_type WHEN 'ips' THEN 'IP::' WHEN 'domains' THEN 'DOM::' ELSE 'CVE::' END || ioc AS o,
                CASE ioc_type WHEN 'ips' THEN 'mentions_ip' WHEN 'domains' THEN 'mentions_domain' ELSE 'mentions_cve' END AS relation,
                CASE ioc_type WHEN 'ips' THEN 'ip' WHEN 'domains' THEN 'domain' ELSE 'cve' END AS type
         FROM iocl WHERE ioc_type IN ('ips', 'domains', 'cves')),
nodes AS (
  SELECT 'ENT::' || ent_text AS id, 'entity' AS type, first(ent_label ORDER BY doc_id, pos) AS entity_label
  FROM ents GROUP BY ent_text
  UNION ALL SELECT DISTINCT o, type, CAST(NULL AS VARCHAR) FROM gioc
  UNION ALL SELECT DISTINCT 'MITRE::' || technique_id, 'mitre_technique', CAST(NULL AS VARCHAR) FROM doc_tech),
raw_edges AS (
  SELECT 'ENT::' || e.ent_text AS a, g.o AS b, g.relation FROM ents e JOIN gioc g ON e.doc_id = g.doc_id
  UNION ALL
  SELECT 'ENT::' || e.ent_text, 'MITRE::' || t.technique_id, 'uses_technique' FROM ents e JOIN doc_tech t ON e.doc_id = t.doc_id
  UNION ALL
  SELECT 'MITRE::' || x.technique_id, 'MITRE::' || y.technique_id, 'co_occurs'
  FROM doc_tech x JOIN doc_tech y ON x.doc_id = y.doc_id AND x.pos < y.pos),
edges AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst, relation FROM raw_edges),
ends AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges),
cent AS (SELECT n.id, CAST(count(e.id) AS BIGINT) AS degree,
                CASE WHEN (SELECT count(*) FROM nodes) > 1
                     THEN CAST(count(e.id) AS DOUBLE) / CAST((SELECT count(*) FROM nodes) - 1 AS DOUBLE)
                     ELSE 1.0 END AS centrality
         FROM nodes n LEFT JOIN ends e ON n.id = e.id GROUP BY n.id)"""


def pred_ctes() -> str:
    """CTEs ``scores``, ``pred(model, doc_id, y_true, y_pred, y_score)`` on top of ``feat``."""
    return f""",
scores AS ({MODEL_SCORES_SQL}),
pred AS (SELECT s.model, s.doc_id, f.label AS y_true, CAST(s.prob > 0.5 AS INTEGER) AS y_pred,
                s.prob AS y_score FROM scores s JOIN feat f USING (doc_id))"""


def scored_ctes() -> str:
    """CTE ``scored``: the full alert table (needs prep, tags, entity and graph CTEs)."""
    return f"""{pred_ctes()},
dcent AS (SELECT f.doc_id, coalesce((SELECT max(c.centrality) FROM ents e JOIN cent c ON c.id = 'ENT::' || e.ent_text
                                      WHERE e.doc_id = f.doc_id), 0.0) * 0.2 AS centrality_score FROM feat f),
scored0 AS (SELECT f.*, t.mitre_matches, s.prob AS model_prob,
                   CAST((f.num_ips + f.num_domains + f.num_hashes + f.num_cves) * 0.3 AS DOUBLE) AS ioc_score,
                   d.centrality_score
            FROM feat f JOIN tags t USING (doc_id) JOIN dcent d USING (doc_id)
            LEFT JOIN scores s ON s.doc_id = f.doc_id AND s.model = 'm1'),
scored AS (SELECT *, model_prob + ioc_score + centrality_score AS threat_score,
                  model_prob + ioc_score + centrality_score > 0.7 AS alert FROM scored0)"""
