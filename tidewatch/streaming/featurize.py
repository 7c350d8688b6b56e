"""Structured Streaming: the stateless stages on an unbounded text stream.

Cleaning, weak labels, keyword and indicator counts and inline technique
tags are per-row expressions, so the same column functions run on a
streaming DataFrame unchanged. Cross-document stages (dedup, graph,
sampling) need the whole table and stay batch jobs over the sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import prepare as Pp


def featurize_stream(stream: DataFrame, text_col: str = "text",
                     technique_dict: DataFrame | None = None) -> DataFrame:
    """clean -> drop empty -> label + keyword count + IOC counts (+ technique tags)."""
    d = Pp.add_clean_text(stream, text_col)
    d = Pp.drop_empty(d)
    d = Pp.add_label_and_features(d)
    if technique_dict is not None:
        from tidewatch.operators.techniques import tag_techniques
        d = tag_techniques(d, technique_dict, strategy="inline")
    return d


def start_feature_stream(spark: SparkSession, source_dir: str, schema, sink_path: str,
                         checkpoint_location: str, path_glob: str | None = None,
                         technique_dict: DataFrame | None = None, available_now: bool = True):
    """Read parquet files as they arrive, featurize, append to a parquet sink.

    The checkpoint location must be on shared storage; a restarted query
    resumes from it exactly once.
    """
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    if path_glob:
        r = r.option("pathGlobFilter", path_glob)
    src = r.parquet(source_dir)
    out = featurize_stream(src, technique_dict=technique_dict)
    w = (out.writeStream.format("parquet").option("path", sink_path)
         .option("checkpointLocation", checkpoint_location).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
