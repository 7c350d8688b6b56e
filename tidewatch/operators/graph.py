"""Knowledge graph as two DataFrames: ``nodes(id, type, entity_label)`` and
``edges(src, dst, relation)`` (undirected: ``src <= dst``).

Inputs are long tables keyed by document: entities ``(doc_id, pos,
ent_text, ent_label)``, indicators ``(doc_id, ioc_type, pos, ioc)`` and the
per-document technique array. Pairs are formed per document only, from
de-duplicated per-document lists, and edges are de-duplicated by a
map-side-combined aggregate, so a pair repeated in many documents costs
one row per map task before the exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.patterns import EDGE_RELATION, NODE_PREFIX, NODE_TYPE

GRAPH_IOC_TYPES = ["ips", "domains", "cves"]   # hashes never enter the graph


def _ent_id(col="ent_text"):
    return F.concat(F.lit(NODE_PREFIX["entity"]), F.col(col))


def _ioc_id(type_col="ioc_type", ioc_col="ioc"):
    return F.concat(
        F.when(F.col(type_col) == "ips", F.lit(NODE_PREFIX["ips"]))
         .when(F.col(type_col) == "domains", F.lit(NODE_PREFIX["domains"]))
         .otherwise(F.lit(NODE_PREFIX["cves"])),
        F.col(ioc_col))


def _tech_id(col):
    return F.concat(F.lit(NODE_PREFIX["technique"]), col)


def technique_long(tagged: DataFrame, id_col: str = "doc_id",
                   tags_col: str = "mitre_matches") -> DataFrame:
    """``(doc_id, tpos, technique_id)`` from the per-document array (KG11: NULL -> [])."""
    return tagged.select(id_col, F.posexplode(F.coalesce(F.col(tags_col), F.array().cast("array<string>")))
                         .alias("tpos", "technique_id"))


def build_nodes(entities: DataFrame, iocs: DataFrame, tagged: DataFrame,
                id_col: str = "doc_id", tags_col: str = "mitre_matches") -> DataFrame:
    """KG1-KG5 + SET2: one row per node id; entity label = first seen by (doc, pos)."""
    ent = (entities.groupBy(_ent_id().alias("id"))
           .agg(F.min_by("ent_label", F.struct(id_col, "pos")).alias("entity_label"))
           .select("id", F.lit(NODE_TYPE["entity"]).alias("type"), "entity_label"))
    ioc = (iocs.filter(F.col("ioc_type").isin(GRAPH_IOC_TYPES))
           .select(_ioc_id().alias("id"),
                   F.when(F.col("ioc_type") == "ips", F.lit(NODE_TYPE["ips"]))
                    .when(F.col("ioc_type") == "domains", F.lit(NODE_TYPE["domains"]))
                    .otherwise(F.lit(NODE_TYPE["cves"])).alias("type"))
           .distinct()
           .select("id", "type", F.lit(None).cast("string").alias("entity_label")))
    tech = (technique_long(tagged, id_col, tags_col)
            .select(_tech_id(F.col("technique_id")).alias("id")).distinct()
            .select("id", F.lit(NODE_TYPE["technique"]).alias("type"),
                    F.lit(None).cast("string").alias("entity_label")))
    return ent.unionByName(ioc).unionByName(tech)


def build_edges(entities: DataFrame, iocs: DataFrame, tagged: DataFrame,
                id_col: str = "doc_id", tags_col: str = "mitre_matches") -> DataFrame:
    """KG6-KG10 + JOIN4/JOIN5 + SET3: canonical undirected edges, distinct."""
    doc_ent = entities.select(id_col, _ent_id().alias("e")).distinct()
    doc_ioc = (iocs.filter(F.col("ioc_type").isin(GRAPH_IOC_TYPES))
               .select(id_col, _ioc_id().alias("o"),
                       F.when(F.col("ioc_type") == "ips", F.lit(EDGE_RELATION["ips"]))
                        .when(F.col("ioc_type") == "domains", F.lit(EDGE_RELATION["domains"]))
                        .otherwise(F.lit(EDGE_RELATION["cves"])).alias("relation"))
               .distinct())
    doc_tech = (technique_long(tagged, id_col, tags_col)
                .select(id_col, _tech_id(F.col("technique_id")).alias("o"),
                        F.lit(EDGE_RELATION["technique"]).alias("relation"))
                .distinct())
    ent_edges = doc_ent.join(doc_ioc.unionByName(doc_tech), id_col) \
                       .select(F.col("e").alias("a"), F.col("o").alias("b"), "relation")
    # JOIN5: technique pairs i < j inside one document's ordered match list
    tags = F.coalesce(F.col(tags_col), F.array().cast("array<string>"))
    pairs = F.flatten(F.transform(
        tags, lambda x, i: F.transform(F.slice(tags, i + 2, F.greatest(F.size(tags) - i - 1, F.lit(0))),
                                       lambda y: F.struct(x.alias("x"), y.alias("y")))))
    co = (tagged.select(F.explode(F.when(F.size(tags) > 1, pairs)).alias("p"))
          .select(_tech_id(F.col("p.x")).alias("a"), _tech_id(F.col("p.y")).alias("b"),
                  F.lit(EDGE_RELATION["co_occurs"]).alias("relation")))
    allr = ent_edges.unionByName(co)
    return (allr.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "relation")
            .distinct())


def graph_size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG7: node and edge counts in one row (one aggregate over a tagged union)."""
    u = nodes.select(F.lit(1).alias("_n")).unionAll(edges.select(F.lit(0).alias("_n")))
    return u.agg(F.sum("_n").cast("bigint").alias("nodes"),
                 F.sum(1 - F.col("_n")).cast("bigint").alias("edges"))


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG8 + KG12: ``(id, degree, centrality)``; self-loop counts 2;
    centrality = degree / (n - 1), a single-node graph gives 1.0."""
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id")))
    deg = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    n = nodes.agg(F.count(F.lit(1))).scalar()   # scalar subquery: one number, no driver round trip
    d = nodes.select("id").join(deg, "id", "left").fillna(0, ["degree"])
    cent = F.when(n > 1, F.col("degree").cast("double") / (n - 1).cast("double")).otherwise(F.lit(1.0))
    return d.select("id", F.col("degree").cast("bigint").alias("degree"),
                    cent.cast("double").alias("centrality"))


def entity_centrality(centrality: DataFrame) -> DataFrame:
    """KG12: centrality of ``ENT::`` nodes keyed by entity text."""
    p = NODE_PREFIX["entity"]
    return (centrality.filter(F.col("id").startswith(p))
            .select(F.expr(f"substring(id, {len(p) + 1})").alias("ent_text"), "centrality"))


def doc_centrality(docs: DataFrame, entities: DataFrame, centrality: DataFrame,
                   id_col: str = "doc_id", weight: float = 0.2) -> DataFrame:
    """JOIN6 + AGG9 + SCR2: per document max entity centrality (0 when none) x weight."""
    ec = entity_centrality(centrality)
    per_doc = (entities.select(id_col, "ent_text").distinct()
               .join(ec, "ent_text", "left")
               .groupBy(id_col).agg(F.max(F.coalesce("centrality", F.lit(0.0))).alias("_c")))
    out = docs.join(per_doc, id_col, "left")
    return out.withColumn("centrality_score", F.coalesce("_c", F.lit(0.0)) * F.lit(weight)).drop("_c")


def technique_entity_cve_chains(edges: DataFrame) -> DataFrame:
    """ADV12: ``(technique, entity, cve)`` through a shared entity, distinct.

    Each entity's techniques are bounded by the dictionary, so the per
    entity product is bounded by dictionary size x its CVEs.
    """
    pe = NODE_PREFIX["entity"]

    def ends(rel):
        e = edges.filter(F.col("relation") == rel)
        ent = F.when(F.col("src").startswith(pe), F.col("src")).otherwise(F.col("dst"))
        oth = F.when(F.col("src").startswith(pe), F.col("dst")).otherwise(F.col("src"))
        return e.select(ent.alias("entity"), oth.alias("other"))

    t = ends(EDGE_RELATION["technique"]).withColumnRenamed("other", "technique")
    c = ends(EDGE_RELATION["cves"]).withColumnRenamed("other", "cve")
    return t.join(c, "entity").select("technique", "entity", "cve").distinct()
