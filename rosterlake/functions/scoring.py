"""Scores: evidence sums, overlaps, similarity ratios and banding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def evidence_score(base: float, parts: list[tuple[str, Column, float]]) -> tuple[Column, Column]:
    """(sum of base and the weights of true parts, clamped to [0, 1]; array of the names of true parts)."""
    total = F.lit(float(base))
    for _, cond, w in parts:
        total = total + F.when(cond, F.lit(float(w))).otherwise(F.lit(0.0))
    reasons = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond, _ in parts]))
    return F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), 6), reasons


def token_overlap(a: Column, b: Column) -> Column:
    """Common distinct tokens over the larger set, in percent; null if both are empty."""
    n = F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(n > 0, 100.0 * F.size(F.array_intersect(a, b)) / n)


def band(score: Column, steps: list[tuple[float, str]], other: str) -> Column:
    """The name of the first step (threshold, name) that the score reaches."""
    c = F.when(score >= steps[0][0], steps[0][1])
    for t, name in steps[1:]:
        c = c.when(score >= t, name)
    return c.otherwise(other)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays as sets; 1 if both are empty."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / u)


def leading_number(c: Column) -> Column:
    """The number a text starts with (``85%`` is 85), null if none."""
    return F.regexp_extract(c, r"^\s*([+-]?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


@F.pandas_udf(T.DoubleType())
def sequence_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def ratio_from_udf(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """``sequence_ratio_udf`` of texts where the letters they have in common, in any order, allow at least
    ``least``; else 0."""
    from difflib import SequenceMatcher

    import numpy as np

    def letters(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64) % 64
        return np.bincount(np.repeat(np.arange(len(n)), n) * 64 + codes, minlength=64 * len(n)).reshape(-1, 64), n

    (x, m), (y, n) = letters(a), letters(b)
    out = np.zeros(len(a))
    for i in np.flatnonzero(2 * np.minimum(x, y).sum(1) >= (least.to_numpy(float) - 1e-9) * (m + n)):
        out[i] = SequenceMatcher(None, a.iat[i], b.iat[i]).ratio()
    return pd.Series(out)


def slug_words(c: Column) -> Column:
    """The parts of a slug that tell names apart."""
    # Legal forms and joining words
    return F.filter(F.split(c, "-"), lambda x: ~x.isin("llc", "inc", "corp", "co", "ltd", "the", "and") & (x != ""))


def slug_similarity(a: Column, b: Column) -> Column:
    """0.55 x Jaccard + 0.45 x sequence ratio of the telling parts of two slugs; 0 if one has none."""
    x, y = slug_words(a), slug_words(b)
    both = (F.size(x) > 0) & (F.size(y) > 0)
    return F.when(both, 0.55 * jaccard(x, y) + 0.45 * sequence_ratio_udf(F.array_join(x, "-"), F.array_join(y, "-"))).otherwise(F.lit(0.0))


def candidate_ids(raw: Column, most: int = 5) -> Column:
    """The first ``most`` distinct ids of a list joined by commas or bars, in order."""
    ids = F.filter(F.transform(F.split(raw, "[,|]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.slice(F.array_distinct(ids), 1, most)


def key_overlap(a: Column, b: Column) -> Column:
    """Common distinct words of two keys over the larger set; 0 if one has none."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y)))


def place_score(row: dict[str, Column], cand: dict[str, Column]) -> tuple[Column, Column]:
    """(score, reasons joined by ``|``) of a candidate place for a row.

    Both sides have ``phone`` (digits), ``domain`` and ``name`` and ``address`` as folded keys; the row
    has ``city`` and ``state`` as well. Empty texts say nothing; a null counts as empty."""
    r, c = ({k: F.coalesce(v, F.lit("")) for k, v in side.items()} for side in (row, cand))
    name, addr = key_overlap(r["name"], c["name"]), key_overlap(r["address"], c["address"])
    both = lambda k: (r[k] != "") & (c[k] != "")
    # Points and names of the evidence; the first that holds of each line counts
    parts = [
        [(both("phone") & (r["phone"] == c["phone"]), 45, "exact_phone_match"), (both("phone"), -15, "phone_conflict")],
        [(both("domain") & (r["domain"] == c["domain"]), 25, "website_domain_match"), (both("domain"), -8, "website_domain_conflict")],
        [(name >= 0.85, 25, "strong_name_similarity"), (name >= 0.6, 16, "moderate_name_similarity"), (name > 0, 6, "weak_name_overlap"), (F.lit(True), -15, "name_mismatch")],
        [((r["city"] != "") & c["address"].contains(r["city"]), 10, "city_match"), (r["city"] != "", -7, "city_mismatch")],
        [((r["state"] != "") & c["address"].contains(r["state"]), 6, "state_match"), (r["state"] != "", -5, "state_mismatch")],
        [((r["address"] != "") & (addr >= 0.6), 12, "address_proximity_strong"), ((r["address"] != "") & (addr >= 0.35), 6, "address_proximity_partial")],
    ]
    score, reasons = F.lit(0), []
    for line in parts:
        points, why = F.lit(0), F.lit(None).cast("string")
        for cond, p, text in reversed(line):
            points, why = F.when(cond, F.lit(p)).otherwise(points), F.when(cond, F.lit(text)).otherwise(why)
        score, reasons = score + points, [*reasons, why]
    return score, F.array_join(F.array_compact(F.array(*reasons)), "|")


def demoted(confidence: Column, margin: Column, least: float = 10) -> Column:
    """High confidence becomes medium where the runner-up is too close."""
    return F.when((confidence == "high") & (margin < least), F.lit("medium")).otherwise(confidence)


def retryable(message: Column) -> Column:
    """Whether an error text tells of overload, a limit, a time-out or a passing failure; null is not."""
    # Parts of messages of errors that may pass
    return F.coalesce(F.lower(message).rlike(r"overloaded|529|rate_limit|timeout|temporarily unavailable"), F.lit(False))


def count_delta(found: Column, expected: Column) -> Column:
    """``over``, ``under`` or ``exact match`` with the signed difference; null where nothing is expected."""
    d = found - expected
    label = F.when(d > 0, "over").when(d < 0, "under").otherwise("exact match")
    return F.when(d.isNotNull(), F.concat(label, F.lit(" "), F.format_string("%+d", d)))
