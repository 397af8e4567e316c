"""Matching records: tiers within blocks, cascades, ranked candidates and labels.

Tiers are separate equi-joins whose results are united, never an OR that would fall back to a nested loop."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rosterlake.session import materialise


def word_prefixes(c: Column) -> Column:
    """All proper prefixes of a text that end at a word boundary."""
    words = F.split(c, " ")
    return F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, 1, i), " "))).otherwise(F.array().cast("array<string>"))


def tiered_match(left: DataFrame, right: DataFrame, block: str, name: str, host: str) -> DataFrame:
    """For each left ``id``: the match of the first non-empty tier (exact name, name followed by a blank
    as a prefix, host) within its block, or why there is none.

    Both sides have ``id, block, name, host``; a tier with several matches gives ``duplicate_exact``,
    ``ambiguous_prefix`` or ``ambiguous_domain``. Nulls match nothing."""
    l = left.select(F.col("id").alias("l"), F.col(block).alias("blk"), F.col(name).alias("ln"), F.col(host).alias("lh"))  # noqa: E741
    r = right.select(F.col("id").alias("r"), F.col(block).alias("blk"), F.col(name).alias("rn"), F.col(host).alias("rh"))
    # the right side is aggregated per key first, so a key that many rows share never multiplies pairs
    per_key = lambda d, k: d.where(F.col(k).isNotNull() & F.col("blk").isNotNull()).groupBy("blk", k).agg(F.count_distinct("r").alias("n"), F.min("r").alias("r"))
    starts = r.select("r", "blk", F.explode(word_prefixes(F.col("rn"))).alias("ln"))
    tiers = [(per_key(r, "rn").withColumnRenamed("rn", "ln"), "ln"), (per_key(starts, "ln"), "ln"), (per_key(r, "rh").withColumnRenamed("rh", "lh"), "lh")]
    per = None
    for no, (side, k) in enumerate(tiers, 1):
        one = l.select("l", "blk", k).join(side, ["blk", k]).select("l", F.lit(no).alias("tier"), "n", "r")
        per = one if per is None else per.unionByName(one)
    best = per.groupBy("l").agg(F.min(F.struct("tier", "n", "r")).alias("b"))
    out = l.select("l").join(best, "l", "left")
    why = F.when(F.col("b").isNull(), "no_match").when(F.col("b.n") == 1, F.element_at(F.array(F.lit("exact"), F.lit("prefix"), F.lit("domain")), F.col("b.tier")))
    why = why.otherwise(F.element_at(F.array(F.lit("duplicate_exact"), F.lit("ambiguous_prefix"), F.lit("ambiguous_domain")), F.col("b.tier")))
    return out.select(F.col("l").alias("id"), F.when(F.col("b.n") == 1, F.col("b.r")).alias("match_id"), why.alias("outcome"))


def best_by_rank(left: DataFrame, right: DataFrame, keys: list[str], id_col: str, rank: list[Column]) -> DataFrame:
    """For each left row the right row of the same key with the largest rank (a struct maximum, combined early)."""
    best = right.groupBy(*keys).agg(F.max(F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)], *[c for c in right.columns if c not in keys])).alias("b"))
    return left.join(best, keys, "left").select(id_col, *keys, *[F.col(f"b.{c}").alias(c) for c in right.columns if c not in keys])


def rank_candidates(df: DataFrame, key: str, score: str, cand: str) -> DataFrame:
    """Candidates ranked by score (ties by candidate) with the margin to the next, 999 if none."""
    w = W.partitionBy(key).orderBy(F.desc(score), cand)
    nxt = F.lead(score).over(w)
    return df.withColumn("rank", F.row_number().over(w)).withColumn("margin", F.coalesce(F.col(score) - nxt, F.lit(999.0)))


def membership(df: DataFrame, known: DataFrame, key: str, pattern: str, labels: tuple[str, str, str]) -> DataFrame:
    """``label``: in the known set; else by pattern; else unknown."""
    k = known.select(key).distinct().withColumn("_in", F.lit(True))
    lab = F.when(F.col("_in"), labels[0]).when(F.col(key).rlike(pattern), labels[1]).otherwise(labels[2])
    return df.join(k, key, "left").withColumn("label", lab).drop("_in")


def resolve_cascade(df: DataFrame, value: str, ref: DataFrame, ref_id: str, keys: list[tuple[Column, Column]]) -> DataFrame:
    """Resolve a text to a reference id by the first of several keys that hits.

    ``keys`` are pairs (key of the value, key of the reference). Result adds ``resolved`` and ``outcome``:
    ``found``, ``ambiguous`` (the key hits several) or ``unknown``. The reference is small by contract."""
    vals = df.select(value).where(F.col(value).isNotNull()).distinct()
    hits = None
    for i, (kv, kr) in enumerate(keys):
        side = ref.select(kr.alias("_k"), F.col(ref_id).alias("_id")).where("_k IS NOT NULL")
        one = vals.select(value, kv.alias("_k")).join(side, "_k").select(value, F.lit(i).alias("step"), "_id")
        hits = one if hits is None else hits.unionByName(one)
    per = hits.groupBy(value, "step").agg(F.count_distinct("_id").alias("n"), F.min("_id").alias("_id"))
    best = per.groupBy(value).agg(F.min(F.struct("step", "n", "_id")).alias("b"))
    out = df.join(best, value, "left")
    return out.withColumn("resolved", F.when(F.col("b.n") == 1, F.col("b._id"))).withColumn(
        "outcome", F.when(F.col("b").isNull(), "unknown").when(F.col("b.n") == 1, "found").otherwise("ambiguous")).drop("b")


def _first_slugs(slugs: DataFrame) -> DataFrame:
    """``part, n, first, last`` of each name part: a slug without what follows its last hyphen; materialised."""
    parts = slugs.select("slug", F.regexp_replace("slug", r"-[^-]*$", "").alias("part")).groupBy("part")
    return materialise(parts.agg(F.count("*").alias("n"), F.min("slug").alias("first"), F.max("slug").alias("last")), "sp")


def slug_exact(names: DataFrame, slugs: DataFrame) -> DataFrame:
    """``id, name, slug, method``: the slug of each name by its name part, by its domain if several have the
    part (``domain``, else the first, ``ambiguous_exact``), or by the only slug that contains the first part
    of its domain (``domain``); nulls where none does.

    ``names`` has ``id, name`` (a slug) and ``domain`` (host with hyphens for full stops, empty if none);
    ``slugs`` has unique ``slug``. Containment is looked up through runs of letters, never by comparing
    every domain with every slug."""
    return _slug_exact(names, slugs, _first_slugs(slugs))


def _slug_exact(names: DataFrame, slugs: DataFrame, parts: DataFrame) -> DataFrame:
    """``slug_exact`` by known parts. Each step is written, so no plan holds them all; materialised."""
    head, hint = F.substring("domain", 1, 12), F.substring_index("domain", "-", 1)
    met = names.join(parts.select(F.col("part").alias("name"), "n", "first"), "name", "left")
    met = materialise(met.withColumn("head", head).withColumn("hint", F.when(F.col("n").isNull(), hint)), "sm")
    # several slugs of one name: those that contain the start of the domain; if the name does, all of them
    within = F.contains("name", F.col("head"))
    asked = met.where("n > 1 AND domain <> ''").where(~within).select("name", "head").distinct()
    ends = F.regexp_replace("slug", r"-[^-]*$", "").alias("name")
    told = materialise(asked.join(slugs.select("slug", ends), "name").where(F.contains("slug", F.col("head"))).groupBy("name", "head").agg(F.min("slug").alias("told")), "st")
    starts = (within | F.col("name").startswith(F.substring("domain", 1, 8))) & (F.col("domain") != "")
    # no slug of the name: the only one that contains the domain's first part. That has no hyphen, so it lies
    # within a word of the slug; each distinct word is looked up by its runs of letters
    run = lambda c, k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - k + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(k)))
    hints = met.where("hint <> ''").select("hint").distinct()
    hints = hints.select("hint", F.expr("substring(hint, 1, CASE WHEN length(hint) >= 8 THEN 8 WHEN length(hint) >= 3 THEN 3 ELSE 1 END)").alias("key"))
    words = parts.select(F.explode(F.split("part", "-")).alias("word"), "first", "last")
    words = words.unionByName(slugs.select(F.regexp_extract("slug", r"-([^-]*)$", 1).alias("word"), F.col("slug").alias("first"), F.col("slug").alias("last")))
    words = words.where("word <> ''").groupBy("word").agg(F.min("first").alias("a"), F.max("last").alias("b"))
    keys = words.select("word", "a", "b", F.explode(F.array_distinct(F.concat(*[run(F.col("word"), k) for k in (1, 3, 8)]))).alias("key"))
    only = hints.join(keys, "key").where(F.contains("word", F.col("hint"))).groupBy("hint").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    only = materialise(only.where("a = b").select("hint", F.col("a").alias("only")), "so")
    out = met.join(told, ["name", "head"], "left").join(only, "hint", "left")
    slug = F.when(F.col("n") == 1, F.col("first")).when(F.col("n") > 1, F.when(starts, F.col("first")).otherwise(F.coalesce("told", "first"))).otherwise(F.col("only"))
    method = F.when(F.col("n") == 1, "exact").when(F.col("n") > 1, F.when(starts | F.col("told").isNotNull(), "domain").otherwise("ambiguous_exact")).when(F.col("only").isNotNull(), "domain")
    return materialise(out.select("id", "name", slug.alias("slug"), method.alias("method")), "se")


def slug_fuzzy(names: DataFrame, slugs: DataFrame, least: float = 0.72, parts: DataFrame | None = None) -> DataFrame:
    """``name, slug``: for each name (a slug) the most similar slug of at least ``least`` by
    ``scoring.slug_similarity`` with the name part, the first slug on a tie. ``parts``: of ``_first_slugs``.

    A similarity of ``least`` needs a Jaccard index of (least - 0.45) / 0.55, which tells by the numbers of words
    of a name and a part how many they must share. They meet by up to three of these, out of their rarest words
    (as many as leave room for the others behind them); bounds of both terms come before the sequence
    ratio. Exact without all pairs."""
    from rosterlake.functions.scoring import jaccard, ratio_from_udf, slug_words

    floor = (least - 0.45) / 0.55
    asked = names.select("name").where("name <> ''").distinct().select("name", F.array_distinct(slug_words(F.col("name"))).alias("words")).where("size(words) > 0")
    asked = materialise(asked.select(F.xxhash64("name").alias("a"), "name", "words"), "sa")
    parts = (_first_slugs(slugs) if parts is None else parts).select("part", "first", F.array_distinct(slug_words(F.col("part"))).alias("words")).where("size(words) > 0")
    parts = materialise(parts.select(F.xxhash64("part").alias("b"), "part", "first", "words"), "sb")
    df = materialise(parts.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df")), "sd")

    def keyed(side: DataFrame, own: str, flip: bool) -> DataFrame:
        """``own, key``: for each number of words of the other side, the sets of words by which it may meet."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                sizes = pdf["h"].map(len)
                for k, part in pdf.groupby(sizes):
                    h = np.stack(part["h"].to_numpy()).astype(np.int64).view(np.uint64)
                    for other in range(max(1, math.ceil(floor * k - 1e-9)), math.floor(k / floor + 1e-9) + 1):
                        share = max(1, math.ceil(floor / (1 + floor) * (k + other) - 1e-9))
                        if share > min(k, other):
                            continue
                        seed = np.uint64((other * 4096 + k if flip else k * 4096 + other) + 1)
                        for some in combinations(range(k - share + min(share, 3)), min(share, 3)):
                            key = np.full(len(part), seed)
                            with np.errstate(over="ignore"):
                                for i in some:
                                    key = (key ^ (key >> np.uint64(29)) ^ h[:, i]) * np.uint64(0x9E3779B97F4A7C15)
                            yield pd.DataFrame({own: part[own], "key": key.view(np.int64)})

        w = side.select(own, F.explode("words").alias("word")).join(df, "word", "left").groupBy(own).agg(
            F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word"))).alias("w"))  # a name's words
        return w.select(own, F.transform("w", lambda x: F.xxhash64(x["word"])).alias("h")).mapInPandas(run, f"{own} bigint, key bigint")

    met = keyed(asked, "a", False).join(keyed(parts, "b", True), "key").select("a", "b").distinct()
    met = met.join(asked.select("a", "name", F.col("words").alias("wa")), "a").join(parts.select("b", "part", "first", F.col("words").alias("wb")), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    # the sequence ratio is at most twice the shorter text over both
    x, y = slug_words(F.col("name")), slug_words(F.col("part"))
    a, b = F.length(F.array_join(x, "-")), F.length(F.array_join(y, "-"))
    met = met.where(0.55 * common / (F.size("wa") + F.size("wb") - common) + 0.45 * 2 * F.least(a, b) / (a + b) >= least - 1e-9)
    # few bytes, much work: not for one task
    spread = 4 * names.sparkSession.sparkContext.defaultParallelism
    met = materialise(met.select("name", "part", "first"), "sq").repartition(spread, "name", "part")
    ratio = ratio_from_udf(F.array_join(x, "-"), F.array_join(y, "-"), (least - 0.55 * jaccard(x, y)) / 0.45)
    near = met.select("name", "first", (0.55 * jaccard(x, y) + 0.45 * ratio).alias("sim")).where(F.col("sim") >= least)
    return near.groupBy("name").agg(F.min(F.struct((-F.col("sim")).alias("s"), F.col("first").alias("slug"))).alias("b")).select("name", "b.slug")


def slug_cascade(names: DataFrame, slugs: DataFrame) -> DataFrame:
    """``id, slug, method`` of every name: ``slug_exact``, else ``slug_fuzzy`` (``fuzzy``), else the name's own
    slug (``constructed``). A name without letters has an empty slug."""
    parts = _first_slugs(slugs)
    one = _slug_exact(names, slugs, parts)
    near = materialise(slug_fuzzy(one.where("method IS NULL"), slugs, parts=parts), "sn").withColumnRenamed("slug", "near")
    out = one.join(near, "name", "left")
    slug = F.when(F.col("method").isNotNull(), F.col("slug")).otherwise(F.coalesce("near", "name"))
    return out.select("id", slug.alias("slug"), F.coalesce("method", F.when(F.col("near").isNotNull(), "fuzzy"), F.lit("constructed")).alias("method"))
