"""Sources by slug: a plug-in per source type turns an input table into lines.

What a fetch, an extraction or a search would have returned is a table (a seam), so the engine opens
no connection and every query is deterministic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.structured import as_records, html_lines_udf, lenient_json
from rosterlake.operators.segments import numbered_lines

SourceFn = Callable[[DataFrame], DataFrame]
_HANDLERS: dict[str, SourceFn] = {}


def source(kind: str) -> Callable[[SourceFn], SourceFn]:
    """Register a handler ``pages(slug, content) -> lines(slug, row_index, raw_text)``."""

    def add(fn: SourceFn) -> SourceFn:
        _HANDLERS[kind] = fn
        return fn

    return add


def lines_of(pages: DataFrame, kind: str) -> DataFrame:
    if kind not in _HANDLERS:
        raise KeyError(f"no handler for source type {kind!r}; known: {sorted(_HANDLERS)}")
    return _HANDLERS[kind](pages)


def _explode(pages: DataFrame, text) -> DataFrame:
    return pages.select("slug", F.posexplode(numbered_lines(text)).alias("row_index", "raw_text"))


@source("text")
def _text(pages: DataFrame) -> DataFrame:
    return _explode(pages, F.col("content"))


@source("webpage")
def _webpage(pages: DataFrame) -> DataFrame:
    return _explode(pages, html_lines_udf("content"))


@source("pdf")
def _pdf(pages: DataFrame) -> DataFrame:
    """Page text followed by one line of the page's distinct links (column ``links``)."""
    text = F.concat_ws("\n", F.col("content"), F.array_join(F.array_distinct(F.col("links")), " "))
    return _explode(pages, text)


def records_of(responses: DataFrame, text: str = "raw_text", schema: str = "vendor_name string, phone string, email string, county string") -> DataFrame:
    """Records out of text responses that should be JSON: fenced, padded or wrapped forms are accepted;
    ``parse_error`` marks rows that hold none."""
    v = responses.withColumn("_v", lenient_json(F.col(text)))
    out = v.withColumn("_r", F.explode_outer(as_records(F.col("_v"))))
    rec = F.try_variant_get(F.col("_r"), "$", f"struct<{', '.join(f'{a}: {b}' for a, b in (x.strip().split(' ') for x in schema.split(',')))}>")
    return out.select(*responses.columns, rec.alias("rec"), F.col("_v").isNull().alias("parse_error"))
