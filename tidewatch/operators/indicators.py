"""Indicator tables: long IOC form, reputation lookup, wide layout.

The long form ``(doc_id, ioc_type, pos, ioc)`` is the primary layout: it is
what joins, graph building and reputation lookups consume, and it never
creates a data-dependent number of columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.functions.patterns import IOC_TYPES


def ioc_long(df: DataFrame, col: str = "clean_text", id_col: str = "doc_id") -> DataFrame:
    """IOC7: one row per extracted indicator occurrence, ``pos`` 0-based per type."""
    ex = T.extract_iocs(col)
    m = F.map_from_arrays(F.array(*[F.lit(k) for k in IOC_TYPES]),
                          F.array(*[ex[k] for k in IOC_TYPES]))
    per_type = df.select(F.col(id_col), F.explode(m).alias("ioc_type", "_l"))
    return per_type.select(id_col, "ioc_type", F.posexplode("_l").alias("pos", "ioc"))


ENRICHABLE_TYPES = ["ips", "domains", "hashes"]   # other types are "not enriched" (score 0)


def load_reputation(spark, path: str) -> DataFrame:
    """SRC7: reputation table ``(ioc_type, ioc, malicious_score)`` from parquet."""
    r = spark.read.parquet(path)
    return r.select(F.col("ioc_type").cast("string"), F.col("ioc").cast("string"),
                    F.col("malicious_score").cast("int"))


def reputation_fixture(iocs: DataFrame) -> DataFrame:
    """Test reputation derived from the corpus: score ``length(ioc) % 7``,
    IOCs whose length is a multiple of 3 left out (to exercise the 0 default)."""
    d = iocs.select("ioc_type", "ioc").distinct()
    return (d.filter(F.col("ioc_type").isin(ENRICHABLE_TYPES) & (F.length("ioc") % 3 != 0))
             .select("ioc_type", "ioc", (F.length("ioc") % 7).cast("int").alias("malicious_score")))


def enrich_iocs(iocs: DataFrame, reputation: DataFrame, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """JOIN2: each IOC occurrence with ``malicious_score`` (0 when absent or not enrichable).

    A reputation table of checked size is broadcast, and occurrences are not shuffled at all.
    A larger one is joined by key; a hot indicator's partition is split by the skew join, for
    the reputation side has one row an indicator.
    """
    from tidewatch.operators.util import broadcast_if_small

    rep = reputation.filter(F.col("ioc_type").isin(ENRICHABLE_TYPES)) \
                    .groupBy("ioc_type", "ioc").agg(F.max("malicious_score").alias("malicious_score"))
    return (iocs.join(broadcast_if_small(rep, broadcast_bytes), ["ioc_type", "ioc"], "left")
            .withColumn("malicious_score", F.coalesce("malicious_score", F.lit(0))))


def doc_reputation_long(enriched: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """IOC8 (long form): ``(doc_id, key='{type}_{ioc}', malicious_score)`` per document."""
    return (enriched.select(id_col, F.concat_ws("_", "ioc_type", "ioc").alias("key"),
                            F.col("malicious_score").cast("int").alias("malicious_score"))
            .distinct())


def doc_reputation_wide(long: DataFrame, keys: list[str], docs: DataFrame | None = None,
                        id_col: str = "doc_id", max_columns: int = 1000) -> DataFrame:
    """IOC8 (wide form) for a caller-given, bounded key list; absent -> 0.

    ``docs``: the documents to list, with or without a key; default those of ``long``.
    ``max_columns`` bounds the number of output columns, not the rows.
    """
    if len(keys) > max_columns:
        raise ValueError(f"{len(keys)} reputation columns requested; limit {max_columns}")
    value = [F.max(F.when(F.col("key") == k, F.col("malicious_score"))).alias(f"_k{i}") for i, k in enumerate(keys)]
    p = long.filter(F.col("key").isin(keys)).groupBy(id_col).agg(*value)
    base = (docs if docs is not None else long).select(id_col).distinct()
    return base.join(p, id_col, "left").select(
        id_col, *[F.coalesce(F.col(f"_k{i}"), F.lit(0)).alias(k) for i, k in enumerate(keys)])


def reputation_index(long: DataFrame) -> DataFrame:
    """IOC8 (sparse form): ``(key, idx)``, every key of the corpus numbered from 0 in key order."""
    from tidewatch.operators.sampling import dense_positions

    keys = long.select("key").distinct().repartitionByRange("key").sortWithinPartitions("key")
    return dense_positions(keys, "idx")


def doc_reputation_sparse(long: DataFrame, index: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """IOC8 (sparse form): ``(doc_id, entries ARRAY<STRUCT<idx, score>>)`` of every document, by ``idx``.

    The wide layout of all indicators without a column for each: a place that is not listed is 0. ``long`` is
    ``doc_reputation_long``; of several scores under one key the largest counts. A key of very many
    documents meets one index row, so AQE can split its partition.
    """
    scored = long.filter(F.col("malicious_score") != 0).join(index, "key")
    per = (scored.groupBy(id_col, "idx").agg(F.max("malicious_score").alias("score"))
           .groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("idx", "score"))).alias("entries")))
    return docs.select(id_col).distinct().join(per, id_col, "left").select(
        id_col, F.coalesce("entries", F.array().cast("array<struct<idx:bigint,score:int>>")).alias("entries"))


def attach_reputation(docs: DataFrame, enriched: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """JOIN3: keyed (never positional) append of per-document reputation summaries."""
    per = (doc_reputation_long(enriched, id_col).groupBy(id_col)
           .agg(F.count(F.lit(1)).alias("enriched_iocs"),
                F.max("malicious_score").cast("bigint").alias("max_malicious_score"),
                F.sum("malicious_score").cast("bigint").alias("sum_malicious_score")))
    out = docs.join(per, id_col, "left")
    return out.fillna(0, ["enriched_iocs", "max_malicious_score", "sum_malicious_score"])


def cross_source_iocs(iocs_a: DataFrame, iocs_b: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """ADV13: indicators seen in both source kinds — equi-join on (ioc_type, ioc)
    of the per-source distinct indicator sets, with per-side document counts."""
    a = iocs_a.groupBy("ioc_type", "ioc").agg(F.countDistinct(id_col).alias("docs_a"))
    b = iocs_b.groupBy("ioc_type", "ioc").agg(F.countDistinct(id_col).alias("docs_b"))
    return a.join(b, ["ioc_type", "ioc"])


def cve_mappings(iocs: DataFrame, cve_table: DataFrame | None, id_col: str = "doc_id") -> DataFrame:
    """ADV11: extracted CVE ids left-joined with an optional CVE table
    ``(cve, ...)`` on the upper-cased id; absent table -> the CVE ids alone."""
    c = iocs.filter(F.col("ioc_type") == "cves").select(id_col, F.upper("ioc").alias("cve")).distinct()
    if cve_table is None:
        return c
    t = cve_table.withColumn("cve", F.upper("cve"))
    return c.join(t, "cve", "left")
