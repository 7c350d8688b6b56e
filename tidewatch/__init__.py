"""tidewatch: threat-text analytics as composable Spark DataFrame transforms.

Every public operator is a ``DataFrame -> DataFrame`` function built from
built-in Spark expressions, joins, aggregates and windows, so Catalyst can
prune, push down and plan it. See README.md for the module map.
"""

from tidewatch.config import Config, DEFAULT_CONFIG

__all__ = ["Config", "DEFAULT_CONFIG"]
