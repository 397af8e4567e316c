"""File sources and sinks: CSV, JSON lines, text lists, JSON documents, versioned writes.

Every reader takes a schema or makes all columns text, so nothing is inferred by an extra pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, columns: list[str], strict: bool = False, blank: str | None = "", glob: str | None = None, exclude: str | None = None) -> DataFrame:
    """CSV with a header, all text, quoted line breaks. Missing cells become ``blank``; ``strict`` fails on
    malformed rows. ``exclude`` drops files whose name holds the text; ``file_name`` is then kept."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST" if strict else "PERMISSIVE")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.csv(path)
    if exclude:
        df = df.select("*", F.col("_metadata.file_name").alias("file_name")).where(~F.col("file_name").contains(exclude))
    return df if blank is None else df.select(*[F.coalesce(F.col(c), F.lit(blank)).alias(c) if c in columns else F.col(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    """Pinned column order; columns not listed are dropped, absent ones written blank."""
    df.select(*project_columns(df, columns)).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def project_columns(df: DataFrame, columns: list[str]) -> list:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def bad_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are no JSON object, with their file and position within the file's split."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file_name"), F.monotonically_increasing_id().alias("line"), "value").where(F.trim("value") != "")
    return lines.where(F.try_parse_json("value").isNull() | ~F.trim("value").startswith("{"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """One trimmed entry per line, blanks dropped."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def read_json_or(spark: SparkSession, path: str, schema: T.StructType, fallback: DataFrame) -> DataFrame:
    """A JSON document, or the fallback if the path is missing or unreadable."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return fallback
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return df if not df.isEmpty() else fallback


def write_version(df: DataFrame, base: str, version: str) -> str:
    """Write a new version beside the old ones; readers switch by the path returned (no overwrite in place)."""
    path = f"{base.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def move_column_after(df: DataFrame, col: str, after: str) -> DataFrame:
    cols = [c for c in df.columns if c != col]
    at = cols.index(after) + 1 if after in cols else len(cols)
    return df.select(*cols[:at], col, *cols[at:])
