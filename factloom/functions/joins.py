"""Joins with a side whose size is looked at first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a join's side that may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


def row_bytes(df: DataFrame) -> int:
    """About the bytes of all rows of df, which is computed for it: for tables of settings and keys."""
    size = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(f"`{name}`"), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`")))), F.lit(0))
    return df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()["b"]


def sized_join(df: DataFrame, side: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """df joined with side, which is broadcast if its bytes are few; the rows are the same either way."""
    return df.join(F.broadcast(side) if row_bytes(side) <= BROADCAST_BYTES else side, on, how)
