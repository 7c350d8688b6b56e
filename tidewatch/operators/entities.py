"""ENT1 / FLT4: named-entity extraction as a gazetteer match at scale.

Tokens, each with those after it (one array expression a row, exploded without
carrying the token array) -> equi-join with the phrases' first tokens, which
gives the phrase lengths to try there -> equi-join on the phrase (both broadcast
only after a size check) -> longest match: a match is dropped when a strictly longer match
covers it, found with a per-document running ``max(end)`` window instead
of a self-join -> label whitelist.

The output schema ``(doc_id, pos, ent_text, ent_label)`` is also what a
``mapInPandas`` model tagger would produce.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.patterns import ENTITY_LABELS
from tidewatch.operators.util import broadcast_if_small


def normalise_gazetteer(gaz: DataFrame) -> DataFrame:
    """``(phrase, label)`` -> one label per phrase (smallest), token count ``n``."""
    g = (gaz.select(F.lower(F.trim("phrase")).alias("phrase"), F.col("label").cast("string"))
         .filter(F.col("phrase") != ""))
    g = g.groupBy("phrase").agg(F.min("label").alias("label"))
    return g.withColumn("n", F.size(F.split("phrase", " ")))


def extract_entities(docs: DataFrame, gazetteer: DataFrame, text_col: str = "clean_text",
                     id_col: str = "doc_id", labels=ENTITY_LABELS,
                     broadcast_bytes: int = 64 << 20) -> DataFrame:
    g = normalise_gazetteer(gazetteer)
    ns = sorted(int(r["n"]) for r in g.select("n").distinct().collect())
    if not ns:
        return docs.sparkSession.createDataFrame(
            [], f"{id_col} BIGINT, pos INT, ent_text STRING, ent_label STRING")
    t = F.col("_t")
    toks = docs.select(F.col(id_col), F.split(F.coalesce(F.col(text_col), F.lit("")), " ").alias("_t"))
    after = F.arrays_zip(*[F.slice(t, k + 1, F.greatest(F.size(t) - k, F.lit(0))).alias(f"_g{k}") for k in range(ns[-1])])
    at = toks.select(id_col, F.size(t).alias("_m"), F.posexplode(after).alias("pos", "_z"))
    heads = g.groupBy(F.split("phrase", " ")[0].alias("_head")).agg(F.collect_set("n").alias("_ns"))
    at = at.join(broadcast_if_small(heads, broadcast_bytes), F.col("_z._g0") == F.col("_head")) \
           .select(id_col, "_m", "pos", "_z", F.explode("_ns").alias("_n")).filter(F.col("pos") + F.col("_n") <= F.col("_m"))
    ex = at.select(id_col, "pos", "_n", F.concat_ws(" ", *[F.when(F.col("_n") > k, F.col(f"_z._g{k}")) for k in range(ns[-1])]).alias("g"))
    matches = ex.join(broadcast_if_small(g, broadcast_bytes), F.col("g") == F.col("phrase")) \
                .select(id_col, "pos", F.col("_n").alias("n"), F.col("phrase").alias("ent_text"),
                        F.col("label").alias("ent_label"))
    w = (Window.partitionBy(id_col).orderBy(F.col("pos"), F.col("n").desc())
         .rowsBetween(Window.unboundedPreceding, -1))
    longest = (matches.withColumn("_end", F.col("pos") + F.col("n"))
               .withColumn("_cover", F.max("_end").over(w))
               .filter(F.col("_cover").isNull() | (F.col("_cover") < F.col("_end"))))
    out = longest.select(id_col, F.col("pos").cast("int").alias("pos"), "ent_text", "ent_label")
    if labels is not None:
        out = out.filter(F.col("ent_label").isin(list(labels)))
    return out
