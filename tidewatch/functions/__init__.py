from tidewatch.functions.text import (
    clean_text, weak_label, keyword_count, extract_iocs, ioc_counts,
)

__all__ = ["clean_text", "weak_label", "keyword_count", "extract_iocs", "ioc_counts"]
