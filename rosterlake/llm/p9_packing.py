"""Problem 9: texts, sized in tokens, into as few containers of fixed capacity as possible.

Length-histogram planning: only the counts per length (at most capacity + 1 of them) reach the
driver; best-fit decreasing runs over counts, moving whole runs of equal bins at once, and gives a
plan of slot ranges per length. Documents then take the planned slots by their rank within length.
Ranks come from counts per (length, hash bucket), so a length that a third of all texts have is
spread over many tasks.

A text larger than the capacity is split: full pieces fill containers of their own and the rest is
an item like any other. A text without tokens (empty, blank, null) is an item of size 0, which takes
no space but has a container. Ties (equal lengths) are ordered by hash bucket, then id."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rosterlake.llm.p8_tokens import encode, spread
from rosterlake.session import materialise, table

BUCKETS = 64


def plan_lengths(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts. Returns slot ranges ``(length, rank_from, rank_to, first_bin,
    per_bin)`` and the number of bins. A run of k bins with equal free space is filled at once."""
    free: dict[int, list[tuple[int, int]]] = {}  # free space -> runs (first bin, number)
    order: list[int] = []  # sorted distinct free spaces
    ranges, bins = [], 0

    def put(space: int, first: int, n: int) -> None:
        if n:
            if space not in free:
                bisect.insort(order, space)
                free[space] = []
            free[space].append((first, n))

    for length in sorted((x for x in counts if x > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                space = order[at]
                first, n = free[space].pop()
                if not free[space]:
                    del free[space]
                    order.pop(at)
            else:
                space, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            per = space // length
            full = min(n, left // per)
            if full:
                ranges.append((length, rank, rank + full * per, first, per))
                put(space - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < n:
                if left:  # the last bin of the run is filled in part
                    ranges.append((length, rank, rank + left, first + full, left))
                    put(space - left * length, first + full, 1)
                    full, rank, left = full + 1, rank + left, 0
                put(space, first + full, n - full)
    if counts.get(0):
        bins = max(bins, 1)
        ranges.append((0, 0, counts[0], 0, counts[0]))
    return ranges, bins


def pack(sizes: DataFrame, containers: list[tuple[str, int]], id_col: str = "doc_id") -> DataFrame:
    """Assign every row of ``sizes`` (``id_col, n_tokens``) for each (kind, capacity).

    Result: ``container_kind, container_id, doc_id, piece_no, start_token, piece_tokens``."""
    kinds = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(int(c)).cast("long").alias("cap")) for k, c in containers])
    rows = sizes.select(id_col, "n_tokens", F.explode(kinds).alias("k")).select(id_col, "n_tokens", "k.*")
    # remainder of an oversized text; an exact multiple leaves no remainder piece
    rows = rows.withColumn("n_full", F.when(F.col("n_tokens") > F.col("cap"), F.expr("n_tokens div cap")).otherwise(F.lit(0).cast("long")))
    rows = rows.withColumn("rest", F.col("n_tokens") - F.col("n_full") * F.col("cap"))
    rows = rows.withColumn("item", (F.col("rest") > 0) | (F.col("n_full") == 0)).withColumn("bucket", F.pmod(F.xxhash64(id_col), F.lit(BUCKETS)))
    # full pieces fill a container each; they are numbered from the end of the planned ones
    hist = materialise(rows.groupBy("container_kind", "cap", "rest", "bucket").agg(F.sum(F.col("item").cast("long")).alias("n"), F.sum("n_full").alias("f")), "p9h")
    w = W.partitionBy("container_kind", "rest").orderBy("bucket")
    # counts per (length, bucket): at most (capacity + 1) * BUCKETS rows a kind, whatever the corpus
    offsets = hist.select("container_kind", "rest", "bucket", (F.sum("n").over(w) - F.col("n")).alias("r0"))
    offsets = offsets.join(hist.groupBy("container_kind", "bucket").agg(F.sum("f").alias("fb")).select(
        "container_kind", "bucket", (F.sum("fb").over(W.partitionBy("container_kind").orderBy("bucket")) - F.col("fb")).alias("f0")), ["container_kind", "bucket"])
    plans, firsts = {}, {}
    for kind, cap in containers:
        counts = {r.rest: r.n for r in hist.where(F.col("container_kind") == kind).groupBy("rest").agg(F.sum("n").alias("n")).collect() if r.n}
        ranges, bins = plan_lengths(counts, int(cap))
        by: dict[int, tuple] = {}
        for length, lo, _, first, per in ranges:
            by.setdefault(length, ([], [], []))
            for store, x in zip(by[length], (lo, first, per)):
                store.append(x)
        plans[kind] = {k: tuple(np.asarray(x, np.int64) for x in v) for k, v in by.items()}
        firsts[kind] = bins
    planned = spark_broadcast(sizes, (plans, firsts))

    ranked = rows.withColumn("local", F.row_number().over(W.partitionBy("container_kind", "rest", "item", "bucket").orderBy(id_col, "n_tokens")) - 1)
    fw = W.partitionBy("container_kind", "bucket").orderBy(id_col, "n_tokens").rowsBetween(W.unboundedPreceding, -1)
    big = rows.where("n_full > 0").withColumn("fl", F.coalesce(F.sum("n_full").over(fw), F.lit(0)))
    f_off = offsets.select("container_kind", "bucket", "f0").distinct()
    big = big.join(F.broadcast(f_off), ["container_kind", "bucket"]).withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_full") - 1)))
    start = F.lit(0).cast("long")
    for kind, _ in containers:
        start = F.when(F.col("container_kind") == kind, F.lit(int(firsts[kind])).cast("long")).otherwise(start)
    full = big.select("container_kind", (start + F.col("f0") + F.col("fl") + F.col("p")).alias("container_id"), id_col, (F.col("p") + 1).alias("piece_no"),
                      (F.col("p") * F.col("cap")).alias("start_token"), F.col("cap").alias("piece_tokens"))

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan = planned.value[0]
        for pdf in batches:
            out = np.zeros(len(pdf), np.int64)
            kind, rest, rank = pdf["container_kind"].to_numpy(), pdf["rest"].to_numpy(), pdf["rank"].to_numpy()
            groups = pd.DataFrame({"k": kind, "l": rest}).groupby(["k", "l"]).indices
            for (k, length), at in groups.items():
                lo, first, per = plan[k][length]
                slot = np.searchsorted(lo, rank[at], "right") - 1
                out[at] = first[slot] + (rank[at] - lo[slot]) // per[slot]
            yield pd.DataFrame({"container_kind": kind, "container_id": out, id_col: pdf[id_col], "piece_no": pdf["n_full"] + 1, "start_token": pdf["n_full"] * pdf["cap"], "piece_tokens": rest})

    kind_type = sizes.schema[id_col].dataType.simpleString()
    items = ranked.where("item").join(offsets.select("container_kind", "rest", "bucket", "r0"), ["container_kind", "rest", "bucket"]).withColumn("rank", F.col("r0") + F.col("local"))
    placed = items.select("container_kind", id_col, "n_full", "cap", "rest", "rank").mapInPandas(
        slots, f"container_kind string, container_id bigint, {id_col} {kind_type}, piece_no bigint, start_token bigint, piece_tokens bigint")
    return placed.unionByName(full)


def spark_broadcast(df: DataFrame, value):
    """A plan is bounded by the capacities (distinct lengths and the splits of their runs)."""
    return df.sparkSession.sparkContext.broadcast(value)


def p9_packed(spark, sf_dir: str) -> DataFrame:
    """The container of every text, for each capacity in ``containers``."""
    sizes = materialise(encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), lengths=True), "p9n")
    kinds = [(r.container_kind, r.capacity_tokens) for r in table(spark, sf_dir, "containers").where("capacity_tokens > 0").orderBy("container_kind").collect()]
    return pack(sizes, kinds)


QUERIES = {"p9_packed": p9_packed}
SQL: dict[str, str] = {}
