"""Query plans: the end-to-end pipeline and the per-operator query catalogue."""
