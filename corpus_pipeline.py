"""Corpus pipeline: quality rules, line dedup, near duplicates, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept. All but
the last return the columns of ``documents``; the last returns the packed pieces. ``run`` writes
every stage as Parquet to the shared folder and reads it back, so a lost executor costs tasks of
one stage only. The whole has no SQL (tokens, edit distance, local search); its tests hold each
stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.decontaminate import keep_clean
from tidewatch.llm.frames import documents, shared_folder
from tidewatch.llm.jaccard import keep_one_of_each
from tidewatch.llm.lines import measures, remove_repeated_lines
from tidewatch.llm.packing import pack_documents
from tidewatch.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current quality policy keeps, unchanged.

    A null or empty text has no words and fails; repeated rows are judged alike; a null doc_id and columns of any
    name pass through; an empty table stays empty; texts are read whole.
    """
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of two lines or more, or of one line of 50 words or more, are cut.

    A document of which no word is left goes; one that had none (null or empty text) stays as it is. Repeated rows
    are one document and come out alike. ``n_chars``, if there is one, follows the text; other columns of any name pass
    through; an empty table stays empty.
    """
    n_lines, n_removed, _ = measures(docs)
    done = remove_repeated_lines(docs)
    done = done.where((F.col(f"`{n_removed}`") < F.col(f"`{n_lines}`")) | (F.col(f"`{n_lines}`") == 0))
    return done.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a Jaccard similarity of 0.8 over five-word shingles: the least id.

    Texts without words link with nothing and stay, each row; of repeated rows one stays; a null doc_id is less than
    all others; other columns of any name pass through; an empty table stays empty.
    """
    return keep_one_of_each(docs, 5, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within a fifth of its words in edits.

    Items and texts without words match nothing; repeated rows are judged alike; a null doc_id and columns of any name pass
    through; without documents or without items nothing is cut. Texts of any length are searched whole.
    """
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and the sequence and offset of each.

    A null or empty text is its end token alone; repeated rows and null doc_ids are packed like any others; longer texts
    are cut into pieces; an empty table gives no pieces; columns other than doc_id and text are not read.
    """
    return pack_documents(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; returns what the last one wrote."""
    docs = documents(spark, sf_dir)
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
