from tidewatch.sources.tables import load_table, osint_documents, ensure_parallelism

__all__ = ["load_table", "osint_documents", "ensure_parallelism"]
