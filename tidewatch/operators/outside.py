"""Models trained elsewhere: loaded once a worker from a file, run over Arrow batches.

A model file is read by Spark (any file system it knows), its size is checked, and its bytes go to
the workers as one broadcast. ``loader(bytes)`` is called once in each worker and returns the
function that is applied to batches; it may use any library the workers have.

* ``outside_scores`` (MDL2): ``(doc_id, model, prob)``, what the scoring chain takes from any model.
* ``outside_entities`` (ENT1): ``(doc_id, pos, ent_text, ent_label)``, as the gazetteer matcher gives.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidewatch.functions.patterns import ENTITY_LABELS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: a larger file is refused: every executor holds it
MODEL_BYTES = 512 << 20


def read_model(spark: SparkSession, path: str, most_bytes: int = MODEL_BYTES) -> bytes:
    """The bytes of one model file, of at most ``most_bytes``; the size is asked before the content is read."""
    files = spark.read.format("binaryFile").load(path)
    sizes = [r["length"] for r in files.select("length").limit(2).collect()]
    if len(sizes) != 1:
        raise ValueError(f"{path}: {'no' if not sizes else 'more than one'} model file")
    if sizes[0] > most_bytes:
        raise ValueError(f"{path}: {sizes[0]} bytes; limit {most_bytes}")
    return bytes(files.select("content").first()["content"])


def write_model(spark: SparkSession, content: str, path: str) -> None:
    """A text model file (JSON weights) in a folder of its own."""
    spark.createDataFrame([(content,)], "value STRING").coalesce(1).write.mode("overwrite").text(path)


def outside_scores(docs: DataFrame, model: bytes, loader: Callable, inputs: Sequence[str], name: str,
                   id_col: str = "doc_id", batch_size: int = 4096) -> DataFrame:
    """P(label=1) of every row by an outside model.

    ``loader(model)`` returns ``predict(*arrays) -> array`` over the columns ``inputs`` (numbers as they are, texts as
    objects; a null number is 0, a null text empty). Probabilities outside [0, 1] and NaN become null, so that the
    scoring chain falls back to the next model for that row.
    """
    from inspect import Parameter, Signature

    import numpy as np
    from pyspark.ml.functions import predict_batch_udf

    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)
    missing = [c for c in inputs if c not in kinds]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")

    def make():
        predict = loader(sent.value)

        def run(*arrays):
            return np.asarray(predict(*arrays), dtype=np.float64).reshape(-1)

        # Spark asks the signature how many columns there are.
        run.__signature__ = Signature([Parameter(f"x{i}", Parameter.POSITIONAL_OR_KEYWORD) for i in range(n)])
        return run

    n = len(inputs)
    run = predict_batch_udf(make, return_type=DoubleType(), batch_size=batch_size)
    whole = [F.coalesce(F.col(c), F.lit("") if kinds[c] == "string" else F.lit(0).cast(kinds[c])) for c in inputs]
    out = docs.select(id_col, run(*whole).alias("prob"))
    fit = F.col("prob").between(0.0, 1.0) & ~F.isnan("prob")
    return out.select(id_col, F.lit(name).alias("model"), F.when(fit, F.col("prob")).alias("prob"))


def linear_model(model: bytes) -> Callable:
    """Loader of JSON ``{"bias": b, "weights": [w, ...]}``: the logistic of a weighted sum, one weight an input."""
    import numpy as np

    given = json.loads(model)

    def predict(*arrays):
        z = np.full(len(arrays[0]), float(given["bias"]))
        for w, x in zip(given["weights"], arrays, strict=True):
            z += float(w) * np.asarray(x, dtype=np.float64)
        return 1.0 / (1.0 + np.exp(-z))

    return predict


def outside_entities(docs: DataFrame, model: bytes, loader: Callable, text_col: str = "clean_text",
                     id_col: str = "doc_id") -> DataFrame:
    """Entities of every row by an outside recogniser, filtered to the kept labels (FLT4).

    ``loader(model)`` returns ``find(list of texts) -> list of [(ent_text, ent_label), ...]``. If it fails on a batch the
    texts are tried one by one, and one that fails has no entities.
    """
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = set(ENTITY_LABELS)
    found_type = pa.list_(pa.struct([("ent_text", pa.string()), ("ent_label", pa.string())]))

    def one(find, text):
        try:
            return find([text])[0]
        except Exception:
            return []

    def run(batches):
        find = loader(sent.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            try:
                got = find(texts)
            except Exception:
                got = [one(find, t) for t in texts]
            rows = [[{"ent_text": t, "ent_label": label} for t, label in ents if label in kept] for ents in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, found_type)], [id_col, "_found"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, _found array<struct<ent_text:string,ent_label:string>>")
    return (out.select(id_col, F.posexplode("_found").alias("pos", "_e"))
            .select(id_col, "pos", F.col("_e.ent_text").alias("ent_text"), F.col("_e.ent_label").alias("ent_label")))


def pattern_recogniser(model: bytes) -> Callable:
    """Loader of JSON ``[{"label": l, "pattern": p}, ...]``: matches of each pattern in turn, in the order of the text."""
    import re

    rules = [(r["label"], re.compile(r["pattern"])) for r in json.loads(model)]

    def find(texts):
        return [[(m.group(0), label) for label, rule in rules for m in rule.finditer(t)] for t in texts]

    return find
