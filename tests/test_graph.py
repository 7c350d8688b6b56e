"""Graph quirks: hashes excluded, isolated IOC nodes, self-loops, centrality edge cases."""

from pyspark.sql import functions as F

from tidewatch.operators import graph as G


def _inputs(spark, ents, iocs, tags):
    e = spark.createDataFrame(ents, "doc_id INT, pos INT, ent_text STRING, ent_label STRING")
    i = spark.createDataFrame(iocs, "doc_id INT, ioc_type STRING, pos INT, ioc STRING")
    t = spark.createDataFrame(tags, "doc_id INT, mitre_matches ARRAY<STRING>")
    return e, i, t


def test_graph_quirks(spark):
    e, i, t = _inputs(
        spark,
        [(1, 0, "acme", "ORG"), (1, 3, "acme", "ORG"), (2, 0, "bob", "PERSON")],
        [(1, "ips", 0, "1.2.3.4"), (1, "hashes", 0, "a" * 32), (3, "ips", 0, "9.9.9.9"),
         (2, "cves", 0, "cve-2020-1234")],
        [(1, ["T1", "T2", "T1"]), (2, []), (3, None)])
    nodes = {r["id"]: r for r in G.build_nodes(e, i, t).collect()}
    edges = {(r["src"], r["dst"]): r["relation"] for r in G.build_edges(e, i, t).collect()}
    assert "IP::9.9.9.9" in nodes                      # present without entity
    assert not any(k.startswith("HASH") or ("a" * 32) in k for k in nodes)
    assert nodes["ENT::acme"]["entity_label"] == "ORG"
    assert edges[("ENT::acme", "IP::1.2.3.4")] == "mentions_ip"
    assert edges[("CVE::cve-2020-1234", "ENT::bob")] == "mentions_cve"
    assert edges[("MITRE::T1", "MITRE::T1")] == "co_occurs"   # duplicate id -> self-loop
    cent = {r["id"]: r for r in G.degree_centrality(G.build_nodes(e, i, t), G.build_edges(e, i, t)).collect()}
    n = len(nodes)
    assert cent["IP::9.9.9.9"]["degree"] == 0
    # T1: self loop (2) + T1-T2 + acme-T1
    assert cent["MITRE::T1"]["degree"] == 4
    assert abs(cent["MITRE::T1"]["centrality"] - 4 / (n - 1)) < 1e-12


def test_single_node_and_empty_graph(spark):
    e, i, t = _inputs(spark, [], [(1, "ips", 0, "1.1.1.1")], [(1, [])])
    n, ed = G.build_nodes(e, i, t), G.build_edges(e, i, t)
    c = G.degree_centrality(n, ed).collect()
    assert len(c) == 1 and c[0]["centrality"] == 1.0
    docs = spark.createDataFrame([(1,), (2,)], "doc_id INT")
    s = G.doc_centrality(docs, e, G.degree_centrality(n, ed)).collect()
    assert all(r["centrality_score"] == 0.0 for r in s)


def test_doc_centrality_uses_max(spark):
    e, i, t = _inputs(spark, [(1, 0, "a", "ORG"), (1, 1, "b", "ORG"), (2, 0, "b", "ORG")],
                      [(1, "ips", 0, "1.1.1.1"), (2, "domains", 0, "x.com")], [(1, []), (2, [])])
    n, ed = G.build_nodes(e, i, t), G.build_edges(e, i, t)
    c = G.degree_centrality(n, ed)
    s = {r["doc_id"]: r["centrality_score"] for r in
         G.doc_centrality(spark.createDataFrame([(1,), (2,)], "doc_id INT"), e, c).collect()}
    nn = n.count()
    assert abs(s[1] - 0.2 * 2 / (nn - 1)) < 1e-12      # b has degree 2
    assert abs(s[2] - 0.2 * 2 / (nn - 1)) < 1e-12


def test_entities_longest_match_and_whitelist(spark):
    from tidewatch.operators.entities import extract_entities
    docs = spark.createDataFrame([(1, "the middle east and east asia ransomware"), (2, "")],
                                 "doc_id INT, clean_text STRING")
    gaz = spark.createDataFrame([("middle east", "LOC"), ("east", "LOC"), ("asia", "LOC"),
                                 ("ransomware", "MISC"), ("east asia", "GPE")], "phrase STRING, label STRING")
    got = sorted((r["pos"], r["ent_text"], r["ent_label"]) for r in extract_entities(docs, gaz).collect())
    assert got == [(1, "middle east", "LOC"), (4, "east asia", "GPE")]
