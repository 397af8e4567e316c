"""Merging updates into a master, inserting what is absent, and comparing snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.text import blank_to_null
from rosterlake.operators.dedupe import last_wins


def replace_merge(master: DataFrame, updates: DataFrame, key: str, seq: str) -> DataFrame:
    """Master rows replaced whole by the last update of their key; ``replaced`` tells which."""
    cols = [c for c in master.columns if c != key]
    u = last_wins(updates, [key], seq).select(key, F.struct(*cols).alias("_u"))
    out = master.join(u, key, "left")
    return out.select(key, *[F.when(F.col("_u").isNotNull(), F.col(f"_u.{c}")).otherwise(F.col(c)).alias(c) for c in cols], F.col("_u").isNotNull().alias("replaced"))


def unmatched_updates(master: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    return updates.select(key).distinct().join(master.select(key), key, "left_anti")


def safe_value(new: Column, old: Column) -> Column:
    """The new value if it is not blank, else the old one."""
    return F.coalesce(blank_to_null(new), old)


def safe_merge(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Left rows with non-blank new values taken over, and ``changed``, the names of fields that did change."""
    j = old.alias("o").join(new.select(key, *fields).alias("n"), key, "left")
    merged = {f: safe_value(F.col(f"n.{f}"), F.col(f"o.{f}")) for f in fields}
    changed = F.array_compact(F.array(*[F.when(~merged[f].eqNullSafe(F.col(f"o.{f}")), F.lit(f)) for f in fields]))
    rest = [F.col(f"o.{c}") for c in old.columns if c != key and c not in fields]
    return j.select(key, *rest, *[merged[f].alias(f) for f in fields], F.array_join(changed, "|").alias("changed"))


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Rows to insert: the first incoming row of each key that does not exist; existing rows stay as they are."""
    from rosterlake.operators.dedupe import first_seen

    return first_seen(incoming, keys, seq).join(existing.select(*keys).distinct(), keys, "left_anti")


def gained_values(old: DataFrame, new: DataFrame, key: str, field: str) -> DataFrame:
    """Keys whose field was blank before and is not now."""
    a, b = old.select(key, blank_to_null(F.col(field)).alias("_o")), new.select(key, blank_to_null(F.col(field)).alias(field))
    return b.join(a, key, "left").where(F.col(field).isNotNull() & F.col("_o").isNull()).select(key, field)


def field_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per field how many rows were newly populated, changed and emptied between two snapshots."""
    j = old.select(key, *[blank_to_null(F.col(f)).alias(f"o_{f}") for f in fields]).join(new.select(key, *[blank_to_null(F.col(f)).alias(f"n_{f}") for f in fields]), key)
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o_{f}").alias("o"), F.col(f"n_{f}").alias("n")) for f in fields]))
    return j.select(rows.alias("x")).select("x.*").groupBy("field").agg(
        F.count_if(F.col("o").isNull() & F.col("n").isNotNull()).alias("newly_populated"), F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull() & (F.col("o") != F.col("n"))).alias("changed"),
        F.count_if(F.col("o").isNotNull() & F.col("n").isNull()).alias("emptied"))


def sequence_diff(a: DataFrame, b: DataFrame, pos: str, value: str) -> DataFrame:
    """One row: the first position at which two numbered sequences differ (null: none) and their lengths."""
    j = a.select(pos, F.col(value).alias("va")).join(b.select(pos, F.col(value).alias("vb")), pos, "full_outer")
    return j.agg(F.min(F.when(~F.col("va").eqNullSafe(F.col("vb")), F.col(pos))).alias("first_diff"), F.count("va").alias("len_a"), F.count("vb").alias("len_b"))


def count_guard(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Per key both counts and a verdict: ``emptied``, ``shrunk`` or ``ok``."""
    x, y = before.groupBy(*keys).agg(F.count("*").alias("n_before")), after.groupBy(*keys).agg(F.count("*").alias("n_after"))
    j = x.join(y, keys, "full_outer").na.fill(0, ["n_before", "n_after"])
    return j.withColumn("verdict", F.when((F.col("n_before") > 0) & (F.col("n_after") == 0), "emptied").when(F.col("n_after") < F.col("n_before"), "shrunk").otherwise("ok"))


def assert_untouched(changes: DataFrame, protected: DataFrame, keys: list[str]) -> DataFrame:
    """The changes, or an error if any of them touches a protected key."""
    hit = changes.join(protected.select(*keys).distinct(), keys, "left_semi").limit(1).count()
    if hit:
        raise ValueError("changes touch a protected key")
    return changes


def apply_changes(rows: DataFrame, changes: DataFrame, key: str, field: str) -> DataFrame:
    """A change per key fanned out to every row of the key."""
    return rows.join(changes.select(key, F.col(field).alias("_c")), key, "left").withColumn(field, F.coalesce("_c", field)).drop("_c")
