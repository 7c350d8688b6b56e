"""SNK6 store of a fit run: every fitted model, and a record of what each reached.

``path/record`` has one row a model: its place in the run, its error or its metrics, and the folder that
holds it. A later run asks for the preferred model that did not fail (SCR4) and fits nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = ("model STRING, seq INT, kind STRING, folder STRING, accuracy DOUBLE, precision DOUBLE, recall DOUBLE, f1 DOUBLE, "
          "roc_auc DOUBLE, error STRING")


def save_models(metrics: DataFrame, fitted: dict, path: str) -> None:
    """``metrics``: one row a model, with ``error``; ``fitted``: name -> ``PipelineModel`` or naive Bayes ``(counts, documents)``.

    ``seq`` follows the order of ``fitted``, then the names of models without one. The record is written last, so a
    run that breaks before leaves none.
    """
    from tidewatch.sinks.writers import save_model

    spark = metrics.sparkSession
    kinds = {}
    for name, model in fitted.items():
        folder = f"{path}/models/{name}"
        if isinstance(model, tuple):
            counts, documents = model
            counts.write.mode("overwrite").parquet(f"{folder}/counts")
            documents.write.mode("overwrite").parquet(f"{folder}/documents")
            kinds[name] = "naive_bayes"
        else:
            save_model(model, folder)
            kinds[name] = "pipeline"
    columns = ["model", "accuracy", "precision", "recall", "f1", "roc_auc", "error"]
    rows = {r["model"]: r for r in metrics.select(*columns).collect()}   # one a model
    names = [*fitted, *sorted(n for n in rows if n not in fitted)]
    out = []
    for seq, name in enumerate(names):
        r = rows.get(name)
        error = r["error"] if r is not None else None
        if name not in kinds and error is None:
            error = "not stored"
        out.append((name, seq, kinds.get(name), f"models/{name}" if name in kinds else None,
                    *((r[c] for c in columns[1:6]) if r is not None else (None,) * 5), error))
    spark.createDataFrame(out, RECORD).coalesce(1).write.mode("overwrite").parquet(f"{path}/record")


def read_record(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).parquet(f"{path}/record")


def load_best(spark: SparkSession, path: str, preference=()) -> tuple[str, Callable[[DataFrame], DataFrame]]:
    """The chosen model's name and ``documents -> (doc_id, model, prob)``; documents have ``doc_id`` and ``clean_text``."""
    from tidewatch.operators.models import naive_bayes_apply, score_documents
    from tidewatch.operators.scoring import choose_model, sigmoid
    from tidewatch.sinks.writers import load_model

    record = read_record(spark, path).filter(F.col("error").isNull())
    first = choose_model(record, preference).first()
    if first is None:
        raise ValueError(f"{path}: no model of the run can be used")
    name = first["model"]
    row = record.filter(F.col("model") == name).first()
    folder = f"{path}/{row['folder']}"
    if row["kind"] == "naive_bayes":
        counts, documents = spark.read.parquet(f"{folder}/counts"), spark.read.parquet(f"{folder}/documents")

        def apply(docs: DataFrame) -> DataFrame:
            odds = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("score")))
            return naive_bayes_apply(docs, counts, documents).select("doc_id", F.lit(name).alias("model"), sigmoid(odds).alias("prob"))
    else:
        model = load_model(folder)

        def apply(docs: DataFrame) -> DataFrame:
            return score_documents(docs.select("doc_id", "clean_text"), model, name).select("doc_id", "model", "prob")

    return name, apply
