"""Problem 7: records that differ in formatting only, by dictionary-encoded columns.

Each distinct value of each field is canonicalised once and gets an integer id; records become
sorted tuples of (field, value id) integers and the compact tuples are grouped.

Nulls: a record with a null or word-less value in any key field is no copy of anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.common import skewless_lookup, words_any_order
from rosterlake.session import materialise, table

FIELDS = ("county", "vendor_name")


def build_dictionary(records: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One row per field and distinct raw value: its canonical value's integer id and the row count.

    Ids are dense per canonical value within a hash partition and unique over all; the result is
    materialised, so they never change."""
    values = (
        records.select(F.explode(F.array(*[F.struct(F.lit(i).alias("fno"), F.col(f).alias("raw")) for i, f in enumerate(fields)])).alias("x"))
        .select("x.fno", "x.raw").where("raw IS NOT NULL").groupBy("fno", "raw").agg(F.count("*").alias("n"))
    )
    canon = materialise(values.withColumn("canon", words_any_order(F.col("raw"))).where("canon <> ''"), "p7c")
    ids = materialise(canon.select("fno", "canon").distinct().withColumn("vid", F.monotonically_increasing_id()), "p7i")
    return materialise(canon.join(ids, ["fno", "canon"]).select("fno", "raw", "vid", "n"), "p7d")


def encode_records(records: DataFrame, id_col: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``id_col, key``: each complete record as its sorted tuple of field-value integers."""
    words = build_dictionary(records, fields)
    out = records.select(F.col(id_col), *[F.col(f).alias(f"_raw{i}") for i, f in enumerate(fields)])
    for i in range(len(fields)):
        side = materialise(words.where(F.col("fno") == i).select(F.col("raw").alias(f"_raw{i}"), F.col("vid").alias(f"_v{i}"), "n"), "p7s")
        out = skewless_lookup(out, side, [f"_raw{i}"], "n").drop(f"_raw{i}")
    tuple_ = F.sort_array(F.array(*[F.lit(i << 58).cast("long") + F.col(f"_v{i}") for i in range(len(fields))]))
    return out.select(id_col, tuple_.alias("key"))


def grouped(records: DataFrame, id_col: str = "listing_id", fields: tuple[str, ...] = FIELDS) -> tuple[DataFrame, DataFrame]:
    """(encoded rows, groups of at least two as ``key, kept_id, copies``), both materialised."""
    coded = materialise(encode_records(records, id_col, fields), "p7e")
    groups = coded.groupBy("key").agg(F.min(id_col).alias("kept_id"), F.count("*").alias("copies")).where("copies > 1")
    return coded, materialise(groups, "p7g")


def members(records: DataFrame, id_col: str = "listing_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``kept_id, <id_col>`` for every member (the kept one included) of a group of at least two."""
    coded, groups = grouped(records, id_col, fields)
    return skewless_lookup(coded, groups, ["key"], "copies").select("kept_id", id_col)


def p7_found(spark, sf_dir: str) -> DataFrame:
    """``kept_id, copy_id``: one row for each listing that is a copy of an earlier one."""
    m = members(table(spark, sf_dir, "marin").select("listing_id", *FIELDS))
    return m.where("listing_id <> kept_id").select("kept_id", F.col("listing_id").alias("copy_id"))


def p7_collapsed(spark, sf_dir: str) -> DataFrame:
    """One row for each record left after the collapse, with its number of copies (1: none)."""
    src = table(spark, sf_dir, "marin").select("listing_id", *FIELDS)
    coded = encode_records(src, "listing_id")
    kept = coded.groupBy("key").agg(F.min("listing_id").alias("kept_id"), F.count("*").alias("copies")).select("kept_id", "copies")
    alone = src.where(F.col("county").isNull() | F.col("vendor_name").isNull() | (words_any_order(F.col("county")) == "") | (words_any_order(F.col("vendor_name")) == ""))
    return kept.unionByName(alone.select(F.col("listing_id").alias("kept_id"), F.lit(1).cast("long").alias("copies")))


QUERIES = {"p7_found": p7_found, "p7_collapsed": p7_collapsed}

_CANON = r"""array_to_string(list_sort(string_split(trim(regexp_replace(regexp_replace(lower({0}), '[.''’‘ʼ`´]', '', 'g'), '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g')), ' ')), ' ')"""
_KEYS = f"""SELECT listing_id, {_CANON.format('county')} AS kc, {_CANON.format('vendor_name')} AS kv FROM marin"""
SQL = {
    "p7_found": f"""WITH k AS ({_KEYS}), g AS (SELECT *, min(listing_id) OVER (PARTITION BY kc, kv) AS kept_id FROM k WHERE kc <> '' AND kv <> '')
        SELECT kept_id, listing_id AS copy_id FROM g WHERE listing_id <> kept_id""",
    "p7_collapsed": f"""WITH k AS ({_KEYS}) SELECT min(listing_id) AS kept_id, count(*) AS copies FROM k WHERE kc <> '' AND kv <> '' GROUP BY kc, kv
        UNION ALL SELECT listing_id, 1 FROM k WHERE coalesce(kc, '') = '' OR coalesce(kv, '') = ''""",
}
