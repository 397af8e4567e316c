"""Walks of one attribute draw their own records, all alike."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from rosterlake.llm import p6_linkage as p6
from rosterlake.session import materialise


def far_of(spark, n, monkeypatch, block):
    """What lies beyond one attribute of n records, each with one own value."""
    monkeypatch.setattr(p6, "BLOCK", block)
    edges = spark.range(n).select(F.xxhash64("id").alias("rec"), F.array(F.xxhash64("id", F.lit(9))).alias("own"), F.lit(77).cast("bigint").alias("attr"))
    hot = materialise(edges.groupBy("attr").agg(F.count("*").alias("n")).where(F.col("n") > block), "th")
    got = p6.step_through(edges, hot).collect()
    own = {r.rec: r.own[0] & (-1 << p6.DEGREE_BITS) for r in edges.collect()}
    return got, own


def test_each_walk_draws_its_own_record(spark, monkeypatch):
    for block in (100_000, 200):
        got, own = far_of(spark, 2_000, monkeypatch, block)
        assert len(got) == 2_000 and all(r.far0 != own[r.rec] and r.far1 != own[r.rec] for r in got)
        seen = Counter(r.far0 for r in got)
        # 2,000 draws of 2,000 records meet about 63 % of them, none of them often; two samples would be two records
        assert 1_150 < len(seen) < 1_400 and max(seen.values()) < 12 and set(seen) <= set(own.values())
        assert sum(r.far0 == r.far1 for r in got) < 60 and len({r.near & ((1 << p6.DEGREE_BITS) - 1) for r in got}) == 1


def test_alone_leads_nowhere(spark, monkeypatch):
    got, _ = far_of(spark, 1, monkeypatch, 10)
    assert got == []
