"""Skew-safe lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.session import small_enough

#: A key that holds more than 1/HOT_SHARE of all rows is hot, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 256


def skewless_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], count: str | None = None, hot_min: int = 50_000) -> DataFrame:
    """Inner join of ``rows`` with a ``lookup`` unique in ``keys`` that no hot key can stall.

    ``lookup`` must be materialised. If its measured size allows, it is broadcast. Otherwise, with
    ``count`` naming the number of rows per key, the keys above 1/HOT_SHARE of all rows (fewer than
    HOT_SHARE of them, so their broadcast is bounded) are joined by broadcast and the rest by shuffle.
    Rows with a null key match nothing."""
    if small_enough(lookup):
        return rows.join(F.broadcast(lookup.drop(count) if count else lookup), keys)
    if count is None:
        return rows.join(lookup, keys)
    total = lookup.agg(F.sum(count)).first()[0] or 0
    bar = max(hot_min, total // HOT_SHARE)
    hot, cold = lookup.where(F.col(count) > bar).drop(count), lookup.where(F.col(count) <= bar).drop(count)
    if hot.isEmpty():
        return rows.join(cold, keys)
    marked = rows.join(F.broadcast(hot.select(*keys)), keys, "left_semi")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return marked.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))
