"""What the llm operators share: skew-safe lookups, connected components, text canonicalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.operators.skew import HOT_SHARE, skewless_lookup
from rosterlake.session import drop_work, materialise

__all__ = ["HOT_SHARE", "PAIR_BLOCK", "TYPO_SHARE", "components", "pairs_within", "rare_enough", "skewless_lookup", "words_any_order"]

#: Share of the mentions of a name that bear one certain typo, at most.
TYPO_SHARE = 1 / 500
#: Rows of a group that one task pairs with others at a time.
PAIR_BLOCK = 2_000


def rare_enough(a: str, b: str, share: float = TYPO_SHARE) -> str:
    """SQL condition: the rarer of two spellings is as rare as a typo of the other would be."""
    return f"least({a}, {b}) <= 1 + {share} * greatest({a}, {b})"


def pairs_within(member: DataFrame, row: str, group: str) -> DataFrame:
    """Pairs ``row_a < row_b`` of rows of one group. The rows of a large group are paired block by block,
    so that no task meets more than ``PAIR_BLOCK`` times the group's rows."""
    m = member.select(F.col(row).alias("r"), F.col(group).alias("e"))
    sizes = m.groupBy("e").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / PAIR_BLOCK).cast("int"))
    m = skewless_lookup(m, materialise(sizes, "pw"), ["e"], "n")
    left = m.select(F.col("r").alias("row_a"), "e", F.pmod(F.xxhash64("r"), F.col("blocks")).cast("int").alias("k"))
    right = m.select(F.col("r").alias("row_b"), "e", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    return left.join(right, ["e", "k"]).where("row_a < row_b").select("row_a", "row_b")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: one row ``(id, root)`` per node of ``edges``, root being the least id.

    Alternating large-star and small-star steps (each a groupBy with map-side combine and one join),
    every round materialised, until nothing changes; O(log n) rounds; nothing but a change count reaches
    the driver."""
    cur = materialise(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc"
    )
    state = cur.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    same = not state[0]
    while not same:
        # large star: strictly larger neighbours of each node attach to the node's least neighbour
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: each node and its smaller neighbours attach to the least of them
        large = large.where("u <> v").distinct()
        least2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least2, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least2.select("u", F.col("m").alias("v")))
        nxt = materialise(small.where("u <> v").distinct(), "cc")
        state, last = nxt.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first(), state
        same = state == last
        drop_work(cur)
        cur = nxt
    star = cur.groupBy("u").agg(F.min("v").alias("root"))
    return star.select(F.col("u").alias("id"), "root").unionByName(star.select(F.col("root").alias("id"), "root").distinct())


def words_any_order(text: Column) -> Column:
    """Canonical text: lower case; full stops and apostrophes vanish, other punctuation separates
    words, white space collapses and the words are sorted. Null stays null."""
    bare = F.regexp_replace(F.lower(text), r"[.'’‘ʼ`´]", "")
    parts = F.split(F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}\p{M}]+", " ")), " ")
    return F.array_join(F.sort_array(parts), " ")
