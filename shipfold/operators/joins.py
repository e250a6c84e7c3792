"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest side we broadcast after checking, in rows and in bytes. Beyond
# either the join is left to AQE (sort-merge, with skew splitting of hot keys).
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def join_checked(big: DataFrame, small: DataFrame, on, how: str = "inner",
                 max_rows: int = BROADCAST_MAX_ROWS, row_bound: int | None = None,
                 row_bytes: int | None = None, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Join ``big`` with a side that is usually small (one row per file, per
    split, per key class). The side is broadcast only when its size is known
    to be within bounds: its row count from ``row_bound`` when the caller can
    bound it from planning facts (files, partitions), else from one count
    job; and, when the caller bounds one row's size (``row_bytes``), rows x
    row size within ``max_bytes``."""
    n = row_bound if row_bound is not None else small.count()
    fits = n <= max_rows and (row_bytes is None or n * row_bytes <= max_bytes)
    return big.join(F.broadcast(small) if fits else small, on, how)
