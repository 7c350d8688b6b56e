from tidewatch.sinks.graph_store import read_graph, upsert_graph
from tidewatch.sinks.model_store import load_best, read_record, save_models
from tidewatch.sinks.writers import (
    write_scored, write_metrics, write_alert_summary, write_graph, write_graph_load_rows,
    save_model, load_model,
)

__all__ = ["write_scored", "write_metrics", "write_alert_summary", "write_graph",
           "write_graph_load_rows", "save_model", "load_model", "read_graph", "upsert_graph",
           "save_models", "read_record", "load_best"]
