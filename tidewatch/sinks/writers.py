"""Sinks: every output is a distributed write; nothing is collected.

Paths are caller-given shared locations (object store / HDFS on a cluster).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def _stringify_complex(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (ArrayType, MapType, StructType)):
            cols.append(F.to_json(F.col(f"`{f.name}`")).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def write_scored(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """SNK1: scored table; CSV has a header and JSON-encoded array columns."""
    if fmt == "csv":
        _stringify_complex(df).write.mode(mode).option("header", True).csv(path)
    else:
        df.write.mode(mode).format(fmt).save(path)


def write_metrics(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK2: one JSON record per model; failed models carry ``error``."""
    results.write.mode(mode).json(path)


def write_alert_summary(summary: DataFrame, path: str, mode: str = "overwrite") -> bool:
    """SNK3: written only when there is at least one alert (the summary is empty otherwise)."""
    if summary.limit(1).count() == 0:
        return False
    summary.coalesce(1).write.mode(mode).json(path)
    return True


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK4: node and edge tables as parquet."""
    nodes.write.mode(mode).parquet(f"{path}/nodes")
    edges.write.mode(mode).parquet(f"{path}/edges")


#: rows of one transaction of the graph loader
LOAD_BATCH = 500


def write_graph_load_rows(nodes: DataFrame, edges: DataFrame, path: str, batch: int | None = None,
                          mode: str = "overwrite") -> None:
    """SNK5 + LIM1: property-graph bulk-load tables, nodes before edges. The column ``batch``
    numbers the loader's transactions of at most LOAD_BATCH rows each, and a file holds many of
    them; a caller who gives ``batch`` gets files of at most that many rows instead. Node rows ``(id, attrs JSON)``; relationship rows
    ``(u, v, type)`` with ``type = relation`` or ``'related_to'``; keys unique."""
    n = nodes.select("id", F.to_json(F.struct("type", "entity_label")).alias("attrs")) \
             .dropDuplicates(["id"])
    e = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"),
                     F.coalesce("relation", F.lit("related_to")).alias("type")).distinct()
    size = batch or LOAD_BATCH
    for rows, name in ((n, "nodes"), (e, "edges")):
        place = F.monotonically_increasing_id()   # task in the high bits, row in the low 33
        task, row = F.shiftright(place, 33), place.bitwiseAND(F.lit((1 << 33) - 1))
        numbered = rows.withColumn("batch", F.concat_ws("-", task.cast("string"), F.floor(row / size).cast("string")))
        w = numbered.write.mode(mode).option("header", True)
        (w.option("maxRecordsPerFile", batch) if batch else w).csv(f"{path}/{name}")


def save_model(model, path: str) -> None:
    """SNK6: persist a fitted ``PipelineModel``."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """SNK6: reload for inference."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
