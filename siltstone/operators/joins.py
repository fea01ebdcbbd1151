"""Lookup joins that hold when one key carries a large share of the rows.

``lookup_join`` broadcasts the looked-up side where its size is known, from writing it, to be small. Else it is a shuffle
join, and adaptive execution, which ``build_session`` turns on, splits the partitions of inner, left, semi and anti joins
that turn out too large, on either side as the join allows. Nothing is run ahead to plan it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.session import SMALL_BYTES, Settled

# Rows that may be broadcast within ``SMALL_BYTES``: what a hash table adds to each row stays below some 100 MB.
BROADCAST_ROWS = 1_000_000


def fits_broadcast(right: Settled, rows: int = BROADCAST_ROWS, size: int = SMALL_BYTES) -> bool:
    return right.rows <= rows and right.size <= size


def lookup_join(left: DataFrame, right: DataFrame | Settled, keys: list[str] | Column, how: str = "inner") -> DataFrame:
    """Join ``left`` to what ``right`` knows about ``keys``, names or a condition; see the module text for the choice of
    strategy."""
    if isinstance(right, Settled):
        return left.join(F.broadcast(right.frame) if fits_broadcast(right) else right.frame, keys, how)
    return left.join(right, keys, how)
