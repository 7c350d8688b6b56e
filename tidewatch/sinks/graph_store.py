"""SNK5 upsert: a property graph kept as Parquet, into which loads are merged.

``path/nodes`` and ``path/edges`` hold one folder for each generation and key bucket. A load joins its rows
(full outer, by key) with the buckets they fall into and writes those buckets anew as the next
generation; the others stay. Then the manifest of the generation, which tells where the present
rows of every bucket are, is written: the load holds from there on. A load that breaks before leaves
the graph as it was, and its folders are overwritten when it is run again; a load that is repeated
changes nothing. One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
NODE_KEY, EDGE_KEY = ["id"], ["src", "dst", "relation"]
SCHEMAS = {"nodes": "id STRING, type STRING, entity_label STRING", "edges": "src STRING, dst STRING, relation STRING"}


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[tuple[str, int], int]]:
    """The last generation, and the generation that holds each (table, bucket); at most two rows a bucket."""
    try:
        rows = spark.read.schema("name STRING, bucket INT, held INT, generation INT").parquet(f"{path}/manifest")
        last = rows.agg(F.max("generation")).first()[0]
    except AnalysisException:
        return 0, {}
    if last is None:
        return 0, {}
    return last, {(r["name"], r["bucket"]): r["held"] for r in rows.filter(F.col("generation") == last).collect()}


def _stored(spark: SparkSession, path: str, name: str, held: dict, buckets=None) -> DataFrame:
    """Present rows of a table, of some buckets only if given."""
    folders = [f"{path}/{name}/generation={g}/bucket={b}" for (n, b), g in sorted(held.items())
               if n == name and (buckets is None or b in buckets)]
    if not folders:
        return spark.createDataFrame([], SCHEMAS[name])
    return spark.read.schema(SCHEMAS[name]).parquet(*folders)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` as of the last complete load; empty before the first."""
    _, held = _manifest(spark, path)
    return _stored(spark, path, "nodes", held), _stored(spark, path, "edges", held)


def _merged(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Full outer join by key; what was stored first stays, and only its nulls are filled."""
    n = new.select(*key, *[F.col(v).alias(f"_new_{v}") for v in values])
    joined = old.join(n, key, "full_outer")
    return joined.select(*key, *[F.coalesce(F.col(v), F.col(f"_new_{v}")).alias(v) for v in values])


def upsert_graph(nodes: DataFrame, edges: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """Merge ``nodes (id, type, entity_label)`` and ``edges (src, dst, relation)`` into the graph at ``path``.

    Returns the generation that holds the result. Rows without a key (null id, src or dst) are left out, as a store keyed by
    them cannot hold them; a null relation is ``related_to``. Of rows with one key the least non-null values count, so a
    load gives the same graph whatever its partitions. ``buckets`` holds for the first load; later ones keep its number.
    """
    spark = nodes.sparkSession
    last, held = _manifest(spark, path)
    if held:
        buckets = held["buckets", -1]
    tables = {
        "nodes": (nodes.filter("id IS NOT NULL").groupBy(*NODE_KEY).agg(F.min("type").alias("type"), F.min("entity_label").alias("entity_label")),
                  NODE_KEY, ["type", "entity_label"]),
        "edges": (edges.filter("src IS NOT NULL AND dst IS NOT NULL")
                  .select("src", "dst", F.coalesce("relation", F.lit("related_to")).alias("relation")).distinct(), EDGE_KEY, [])}
    now, generation = {**held, ("buckets", -1): buckets}, last + 1
    for name, (rows, key, values) in tables.items():
        bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
        new = rows.checkpoint()
        touched = {r[0] for r in new.select(bucket).distinct().collect()}   # at most ``buckets``
        if not touched:
            continue
        merged = _merged(_stored(spark, path, name, held, touched), new, key, values)
        (merged.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64(*key, F.lit(1)), F.lit(8)))
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}/generation={generation}"))
        now.update({(name, b): generation for b in touched})
    rows = [(n, b, g) for (n, b), g in now.items()]
    (spark.createDataFrame(rows, "name STRING, bucket INT, held INT").coalesce(1)
     .write.mode("overwrite").parquet(f"{path}/manifest/generation={generation}"))
    return generation
