"""First-seen and last-wins survivors, longest text, roll-ups of groups.

Nothing here gathers a group: survivors are picked by min/max of structs, which combine before the
shuffle, so a key that holds a third of all rows costs no more than any other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: Column, largest: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    agg = F.max if largest else F.min
    best = df.groupBy(*keys).agg(agg(F.struct(order.alias("_o"), *rest)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest]).select(*df.columns)


def first_seen(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The first row (by ``seq``, unique) of each key; rows with a null or blank key are dropped."""
    for k in keys:
        df = df.where(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    return _pick(df, keys, F.col(seq), False)


def last_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key, with ``first_pos``, the position its key first had."""
    first = df.groupBy(*keys).agg(F.min(seq).alias("first_pos"))
    return _pick(df, keys, F.col(seq), True).join(first, keys)


def longest_text(df: DataFrame, keys: list[str], text: str, seq: str) -> DataFrame:
    """Per key the longest text, the first on ties, and its ``seq``; blank texts are ignored."""
    some = df.where(F.coalesce(F.length(text), F.lit(0)) > 0)
    return some.groupBy(*keys).agg(F.max(F.struct(F.length(text).alias("n"), (-F.col(seq)).alias("s"))).alias("b")).select(
        *keys, (-F.col("b.s")).alias(seq), F.col("b.n").alias("n_chars"))


def sorted_distinct(col: str, sep: str = "|") -> Column:
    return F.array_join(F.array_sort(F.collect_set(col)), sep)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
