"""Small planning helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_bytes(df: DataFrame) -> F.Column:
    """Bytes of a row: its strings' bytes, and 16 a row and 8 a column beside them."""
    strings = [F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c, t in df.dtypes if t == "string"]
    size = F.lit(16 + 8 * len(df.columns)).cast("bigint")
    for s in strings:
        size = size + s
    return size


def side_bytes(df: DataFrame) -> int:
    """Bytes of a side, as ``row_bytes`` of its rows; one aggregate."""
    return df.agg(F.sum(row_bytes(df))).first()[0] or 0


def broadcast_if_small(df: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast hint only after a check of the side's bytes; beyond it the join is
    left to the planner (sort-merge, with skewed partitions split by AQE)."""
    return F.broadcast(df) if side_bytes(df) <= most_bytes else df
