"""Lines, blocks and chunks of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from rosterlake.functions.text import strip_ws


def numbered_lines(text: Column) -> Column:
    """Trimmed non-blank lines as an array; their index is the row index (blank lines don't count)."""
    return F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), strip_ws), lambda x: x != "")


def is_header(line: Column) -> Column:
    """At least three words, and at least four fifths of the letters are capitals."""
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    caps = F.length(F.regexp_replace(line, r"[^\p{Lu}]", ""))
    return (F.size(F.split(F.trim(line), r"\s+")) >= 3) & (letters > 0) & (caps >= 0.8 * letters)


def is_footer(line: Column, markers: tuple[str, ...] = ("revised", "updated", "disclaimer")) -> Column:
    return line.rlike(r"(?i)\bpage\b|" + "|".join(markers))


def blocks(text: Column) -> Column:
    """Blocks that a header line opens: array of arrays of lines.

    Lines before the first header and footer lines are dropped. One fold per text, no shuffle."""
    zero = F.array().cast("array<array<string>>")

    def step(acc, line):
        opened = F.concat(acc, F.array(F.array(line)))
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.element_at(acc, -1), F.array(line))))
        return F.when(is_footer(line), acc).when(is_header(line), opened).when(F.size(acc) > 0, grown).otherwise(acc)

    return F.aggregate(numbered_lines(text), zero, step)


def chunk_sizes(df: DataFrame, id_col: str, pieces: str, limit: int, separator: int = 0) -> DataFrame:
    """``id, chunk, n_lines, chars`` of the chunks of each row's pieces: a chunk closes before it would exceed
    ``limit``, a longer piece has a chunk of its own.

    The sum that restarts is a loop over lengths in Arrow batches: linear in the pieces, where a fold that
    collects an array copies it at every step. Only lengths leave the engine, and nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, sizes in zip(pdf["id"], pdf["sizes"]):
                used = no = n = 0
                for size in sizes:
                    if n and used + size > limit:
                        rows.append((i, no, n, used))
                        used, no, n = 0, no + 1, 0
                    used, n = used + int(size), n + 1
                if n:
                    rows.append((i, no, n, used))
            yield pd.DataFrame(rows, columns=[id_col, "chunk", "n_lines", "chars"])

    kind = df.schema[id_col].dataType.simpleString()
    sizes = F.transform(F.col(pieces), lambda x: F.length(x) + separator)
    return df.select(F.col(id_col).alias("id"), sizes.alias("sizes")).mapInPandas(run, f"{id_col} {kind}, chunk int, n_lines bigint, chars bigint")


def header_words(text: Column) -> Column:
    return F.transform(numbered_lines(text), is_header)


SCHEMA_LINES = T.StructType([T.StructField("row_index", T.IntegerType()), T.StructField("raw_text", T.StringType())])


def running_total(df: DataFrame, key: str, order: str, value: Column, name: str, chunk: int = 50_000) -> DataFrame:
    """Running sum of ``value`` per key in the order of an integer column, spread over chunks of it: a key
    that holds a third of all rows is many tasks, and only one row per chunk is summed in sequence."""
    rows = df.withColumn("_chunk", F.floor(F.col(order) / chunk)).withColumn("_v", value)
    parts = rows.groupBy(key, "_chunk").agg(F.sum("_v").alias("_s"))
    before = parts.withColumn("_before", F.sum("_s").over(W.partitionBy(key).orderBy("_chunk")) - F.col("_s")).drop("_s")
    local = rows.withColumn("_local", F.sum("_v").over(W.partitionBy(key, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
    return local.join(before, [key, "_chunk"]).withColumn(name, F.col("_before") + F.col("_local")).drop("_chunk", "_v", "_local", "_before")
