"""The slug steps: cut plans, words that hold the domain, bounds before the sequence ratio."""

from __future__ import annotations

from rosterlake.functions import scoring
from rosterlake.operators import match


def sides(spark):
    names = spark.createDataFrame([(1, "oak-gate", ""), (2, "none", "harbor-com"), (3, "other", "12-com"), (4, "iron-gate-traning", ""), (5, "twin", "twin-b7-com")], "id int, name string, domain string")
    slugs = spark.createDataFrame([("oak-gate-1",), ("my-harborside-9",), ("iron-gate-training-12",), ("twin-a1",), ("twin-b7",)], "slug string")
    return names, slugs


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_no_plan_holds_all_steps(spark):
    names, slugs = sides(spark)
    assert exchanges(match.slug_exact(names, slugs)) == 0
    assert exchanges(match.slug_cascade(names, slugs)) <= 2


def test_domain_within_one_word(spark):
    got = {r.id: (r.slug, r.method) for r in match.slug_exact(*sides(spark)).collect()}
    assert got == {1: ("oak-gate-1", "exact"), 2: ("my-harborside-9", "domain"), 3: ("iron-gate-training-12", "domain"), 4: (None, None), 5: ("twin-a1", "ambiguous_exact")}


def test_ratio_with_bound(spark):
    df = spark.createDataFrame([("oak-gate", "oak-gatte", 0.9), ("oak", "elm", 0.5), ("", "", 0.0)], "a string, b string, least double")
    got = [r.x for r in df.select(scoring.ratio_from_udf("a", "b", "least").alias("x")).collect()]
    assert abs(got[0] - 16 / 17) < 1e-9 and got[1:] == [0.0, 1.0]
