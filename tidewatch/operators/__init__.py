"""DataFrame -> DataFrame operators. Compose with ``df.transform``."""
