"""Joins of keys that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows is heavy; there are fewer than 1 / HEAVY of them.
HEAVY = 1 / 1024


def join_heavy(big: DataFrame, small: DataFrame, on: str, rows: str, heavy: float = HEAVY) -> DataFrame:
    """Inner join of ``big`` with a written table ``small`` that has a row for each key and in ``rows`` how many of ``big`` have it.
    Heavy keys, fewer than 1 / ``heavy``, are broadcast, and their rows of ``big`` are not shuffled; the rest is joined as
    usual. Without ``on`` and ``rows`` in the result."""
    total, most = small.agg(F.sum(rows), F.max(rows)).first()
    least = (total or 0) * heavy
    if not total or most <= least:
        return big.join(small.drop(rows), on).drop(on)
    large, rest = small.where(F.col(rows) > least).drop(rows), small.where(F.col(rows) <= least).drop(rows)
    few = big.join(F.broadcast(large.select(on)), on, "left_anti").join(rest, on)
    return big.join(F.broadcast(large), on).unionByName(few).drop(on)
