"""Counts, coverage, cross-tabs, medians and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rosterlake.functions.text import strip_ws


def labelled(c: Column) -> Column:
    """Blank and null as the label ``null``."""
    return F.coalesce(F.nullif(strip_ws(c), F.lit("")), F.lit("null"))


def group_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(labelled(F.col(col)).alias(col)).agg(F.count("*").alias("n"))


def coverage(df: DataFrame, cols: list[str], count_blank: bool = True) -> DataFrame:
    """Per column how many rows have a value, of how many, and the share in percent.

    ``count_blank``: a blank text counts as a value, only null does not."""
    val = lambda c: F.col(c) if count_blank else F.nullif(strip_ws(F.col(c).cast("string")), F.lit(""))
    one = df.agg(F.count("*").alias("total"), *[F.count(val(c)).alias(c) for c in cols])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled"), F.col("total").alias("total")) for c in cols]))
    return one.select(rows.alias("x")).select("x.*").withColumn("pct", F.round(100.0 * F.col("filled") / F.greatest("total", F.lit(1)), 1))


def group_and_total(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per group and overall: rows, rows with a non-blank value, rows without. The total's key is null."""
    has = F.coalesce(strip_ws(F.col(value)), F.lit("")) != ""
    return df.withColumn("_h", has).rollup(key).agg(F.count("*").alias("total"), F.count_if("_h").alias("with_value"), F.count_if(~F.col("_h")).alias("without_value"), F.grouping(key).alias("is_total"))


def crosstab(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Counts by row and a fixed list of column values, absent cells 0."""
    return df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1))).na.fill(0)


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group mean and upper median (element n // 2 of the sorted values), by rank from counts of
    distinct values, so no group is gathered."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_k"))
    w = W.partitionBy(*keys).orderBy(value)
    run = c.withColumn("_hi", F.sum("_k").over(w)).withColumn("_n", F.sum("_k").over(W.partitionBy(*keys)))
    return run.groupBy(*keys).agg(F.min(F.when(F.col("_hi") > F.floor(F.col("_n") / 2), F.col(value))).alias("upper_median"), (F.sum(F.col(value) * F.col("_k")) / F.max("_n")).alias("mean"), F.max("_n").alias("n"))


def mode_first_seen(df: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    """The most frequent value per group, the first seen on ties."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_k"), F.min(seq).alias("_s"))
    return c.groupBy(*keys).agg(F.max(F.struct("_k", (-F.col("_s")).alias("_s"), value)).alias("_b")).select(*keys, F.col(f"_b.{value}").alias("mode"), F.col("_b._k").alias("n"))


def page(df: DataFrame, order: list[Column], number: int, size: int = 50) -> DataFrame:
    """One page of a total order with the number of pages, at least 1. The order ends in a unique key."""
    number = max(1, int(number)) if str(number).lstrip("-").isdigit() else 1
    total = df.count()
    out = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return out.withColumn("page_count", F.lit(max(1, -(-total // size))))


def share(cond: Column) -> Column:
    return F.round(100.0 * F.count_if(cond) / F.greatest(F.count("*"), F.lit(1)), 1)


def head_sample(df: DataFrame, by: list, text: str, n: int) -> DataFrame:
    """``position, line`` of the first n rows in an order (a distributed top-n), and a last line
    ``... and N more`` if there are more. An empty table gives no lines."""
    keys = [f"_k{i}" for i in range(len(by))]
    top = df.select(F.col(text).alias("line"), *[c.alias(k) for c, k in zip(by, keys)]).orderBy(*keys).limit(n)
    lines = top.select(F.row_number().over(W.orderBy(*keys)).alias("position"), "line")  # n rows
    rest = df.agg((F.count("*") - n).alias("more")).where("more > 0")
    return lines.unionByName(rest.select(F.lit(n + 1).alias("position"), F.concat(F.lit("... and "), "more", F.lit(" more")).alias("line")))
