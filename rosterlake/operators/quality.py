"""Validation: violation codes per row, quarantine, review flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rules: dict[str, Column]) -> Column:
    """Sorted distinct codes of the rules that are true, joined by ``|``; null conditions don't count."""
    return F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))), "|")


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("violations", violations(rules))
    return marked.where("violations = ''").drop("violations"), marked.where("violations <> ''")


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, a uniqueness rule's violations."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent (null keys are no orphans)."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
