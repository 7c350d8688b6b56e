"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = -(2**63)


def ready(spark: SparkSession) -> SparkSession:
    """Bound the size of Arrow batches, and make checkpoint() usable.

    The folder named by ``spark.checkpoint.dir`` is used as it is; only where it is unset on a
    local master (tests) a scratch folder is taken.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="llm-checkpoint-")
        sc.setCheckpointDir(folder)
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    return f"{ready(spark).sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """``_id`` (a null doc_id as the least long), ``_fp`` (tells rows of one id with other texts apart) and ``text``.

    Only these columns go on, so extra columns of any name never clash.
    """
    return docs.select(row_id().alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_fp"),
                       F.coalesce("text", F.lit("")).alias("text"))


def row_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))


def out_id() -> Column:
    return F.when(F.col("_id") != NULL_ID, F.col("_id")).alias("doc_id")


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: one scan with a global sum, which sizes sketches and bucket counts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
