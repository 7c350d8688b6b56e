"""Parquet table access and the derived test corpora.

``osint_documents`` appends deterministic indicator phrases to the
``documents`` table (every row kept; the appended phrase depends on the row
key) so that indicators, keywords, mentions and hashtags occur often
enough to test every operator. The same definition exists as DuckDB SQL in
``tidewatch.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_parallelism(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread a scan that arrived in too few splits before CPU-heavy regex work.

    A cluster reading many files already has enough splits and pays no
    shuffle here; a single-row-group fixture file gets a round-robin
    repartition so all cores take part.
    """
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want)


def _s(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def osint_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, source, text)``: documents plus deterministic indicator phrases."""
    d = ensure_parallelism(load_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    n = load_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    s = load_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    did = F.col("doc_id")
    j = (d.join(n, n.n_nationkey == did % 25)
          .join(s, s.s_suppkey == did % 10))
    seen = F.when(did % 4 == 0, F.concat(
        F.lit(" Seen in "), F.col("n_name"), F.lit(" via @user"), _s(did % 97),
        F.lit(" #ransomware http://t.co/"), _s(did))).otherwise(F.lit(""))
    cve = F.when(did % 5 == 0, F.concat(
        F.lit(" CVE-2024-"), _s(10000 + did % 50), F.lit(" exploit by "),
        F.col("s_name"))).otherwise(F.lit(""))
    c2 = F.when(did % 6 == 0, F.concat(
        F.lit(" c2 10.0."), _s(did % 8), F.lit("."), _s(did % 30),
        F.lit(" host"), _s(did % 20), F.lit(".evil.com"))).otherwise(F.lit(""))
    phish = F.when(did % 7 == 0, F.concat(
        F.lit(" spearphishing link powershell "), F.md5(_s(did % 40)))).otherwise(F.lit(""))
    return j.select("doc_id", "source",
                    F.concat(F.col("text"), seen, cve, c2, phish).alias("text"))


def technique_fixture(spark: SparkSession) -> DataFrame:
    """Six-row technique dictionary (FIXTURES D), raw ``keywords`` string."""
    # fixed values: test technique dictionary
    rows = [
        (0, "T1566", "Phishing", "phishing;spearphishing link; "),
        (1, "T1059", "Scripting", "powershell;cmd.exe"),
        (2, "T1486", "Encrypt for impact", "ransomware"),
        (3, "T1071", "App-layer protocol", "c2;beacon"),
        (4, "T1190", "Exploit public app", "exploit;cve-"),
        (5, "T1219", "Remote access", "rat"),
    ]
    return spark.createDataFrame(
        rows, "pos INT, technique_id STRING, technique_name STRING, keywords STRING")


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(phrase, label)`` derived from the dimension tables, lower-case."""
    nat = load_table(spark, sf_dir, "nation").select(
        F.lower("n_name").alias("phrase"), F.lit("GPE").alias("label"))
    reg = load_table(spark, sf_dir, "region").select(
        F.lower("r_name").alias("phrase"), F.lit("LOC").alias("label"))
    sup = load_table(spark, sf_dir, "supplier").select(
        F.lower(F.regexp_replace("s_name", "#", "")).alias("phrase"), F.lit("ORG").alias("label"))
    prt = load_table(spark, sf_dir, "part").select(
        F.lower("p_name").alias("phrase"), F.lit("PRODUCT").alias("label")).distinct()
    misc = spark.createDataFrame([("ransomware", "MISC")], "phrase STRING, label STRING")
    return nat.unionByName(reg).unionByName(sup).unionByName(prt).unionByName(misc)


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic ``(doc_id, model, prob)`` for three stand-in models."""
    d = load_table(spark, sf_dir, "documents").select("doc_id")
    did = F.col("doc_id")

    def m(name, mult, mod):
        return d.select("doc_id", F.lit(name).alias("model"),
                        (((did * mult) % mod).cast("double") / float(mod)).alias("prob"))

    return m("m1", 7919, 1000).unionByName(m("m2", 104729, 1000)).unionByName(m("m3", 1299709, 10))
