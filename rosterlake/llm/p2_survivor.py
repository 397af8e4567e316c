"""Problem 2: the best value per field of each duplicate group, by iterative truth discovery.

Sources are the provenance classes of listings (crawl status x enrichment confidence: a fixed,
bounded set). Two estimates alternate until they agree: the reliability of a class is the share of
its claims that hold the value believed true, and the value believed true is the one with the
largest votes weighted by reliability. Votes are counted by trust tier: the claims of listings that
are at the best on all three counts at once (crawl status, confidence, recency) come first, those of
others only break ties among fields without such claims, as a tier of unbounded weight would.

Unusable values (missing, blank, placeholder; a price without an amount) never vote. Ties of support
go to the shorter, then the smaller text. Groups are those of problem 7. All steps are algebraic aggregates over claims
that are pre-aggregated by (group, field, value, class); no group is ever gathered in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.common import skewless_lookup
from rosterlake.llm.p7_formatting import FIELDS as KEY_FIELDS
from rosterlake.llm.p7_formatting import members
from rosterlake.session import drop_work, materialise, table

RESOLVED = ("crawl_status", "enrichment_confidence", "vendor_description", "price_16hr_full")

# Texts that stand for a missing value (lower case, without outer spaces).
PLACEHOLDERS = (
    "", "-", "--", "n/a", "na", "nan", "none", "null", "nil", "tbd", "tba", "unknown", "not available", "no description",
    "no description available", "no description available.", "varies", "call", "call for pricing", "pending review",
    "coming soon", "not provided", "?", "various",
)


def _plain(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^[\s  ]+|[\s  ]+$", ""))


def usable(name: str) -> Column:
    c = F.col(name)
    ok = F.coalesce(~_plain(c).isin(*PLACEHOLDERS), F.lit(False))
    return ok & c.rlike(r"\d") if name.startswith("price") else ok


def trust() -> list[Column]:
    """The three counts, larger is better: crawl success, confidence level, seconds of enrichment."""
    conf = F.coalesce(_plain(F.col("enrichment_confidence")), F.lit(""))
    return [
        F.coalesce((_plain(F.col("crawl_status")) == "success").cast("int"), F.lit(0)).alias("t_status"),
        F.when(conf == "high", 3).when(conf == "medium", 2).when(conf == "low", 1).otherwise(0).alias("t_conf"),
        F.coalesce(F.unix_micros(F.col("enriched_at").cast("timestamp")), F.lit(-(2**62))).alias("t_when"),
    ]


def claims_of(listings: DataFrame, member: DataFrame) -> DataFrame:
    """Claims ``first_id, field_no, value, class, top, n, least_id`` pre-aggregated over listings.

    ``top`` marks claims of listings at the best on all three counts among the group's usable ones."""
    fields = F.array(*[
        F.when(usable(f), F.struct(F.lit(i).alias("field_no"), F.col(f).alias("value"))) for i, f in enumerate(RESOLVED)
    ])
    rows = listings.select("listing_id", *trust(), F.array_compact(fields).alias("fs")).join(member, "listing_id")
    rows = materialise(rows.select("kept_id", "listing_id", "t_status", "t_conf", "t_when", F.explode("fs").alias("f"))
                       .select(F.col("kept_id").alias("first_id"), "listing_id", "t_status", "t_conf", "t_when", "f.field_no", "f.value"), "p2r")
    best = rows.groupBy("first_id", "field_no").agg(F.max("t_status").alias("b_status"), F.max("t_conf").alias("b_conf"), F.max("t_when").alias("b_when"), F.count("*").alias("n"))
    top = (F.col("t_status") == F.col("b_status")) & (F.col("t_conf") == F.col("b_conf")) & (F.col("t_when") == F.col("b_when"))
    marked = skewless_lookup(rows, materialise(best, "p2b"), ["first_id", "field_no"], "n").withColumn("top", top.cast("int"))
    out = marked.groupBy("first_id", "field_no", "value", (F.col("t_status") * 4 + F.col("t_conf")).alias("class"), "top").agg(
        F.count("*").alias("n"), F.min("listing_id").alias("least_id"))
    out = materialise(out, "p2c")
    drop_work(rows)
    return out


def discover(claims: DataFrame, tolerance: float = 1e-3, patience: int = 100) -> DataFrame:
    """The believed value per group and field, with support; reliabilities by fixed-point iteration.

    Only the reliability of the (at most eight) classes passes through the driver. If the reliabilities
    have not settled after ``patience`` rounds, the result would be arbitrary: that is an error."""
    weight = {c: 0.5 for c in range(8)}
    truth = None
    for _ in range(patience):
        w = F.lit(0.0)
        for c, x in weight.items():
            w = F.when(F.col("class") == c, F.lit(float(x))).otherwise(w)
        votes = claims.withColumn("w", w * F.col("n")).groupBy("first_id", "field_no", "value").agg(
            F.sum(F.when(F.col("top") == 1, F.col("w")).otherwise(0.0)).alias("s_top"), F.sum("w").alias("s_all"),
            F.max("top").alias("has_top"), F.min(F.when(F.col("top") == 1, F.col("least_id"))).alias("top_id"), F.min("least_id").alias("any_id"),
            *[F.sum(F.when(F.col("class") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in range(8)])
        # largest support; the shorter, then the smaller text on a tie
        counts = [f"n{c}" for c in range(8)]
        best = F.min(F.struct((-F.round("s_top", 9)).alias("s_top"), (-F.round("s_all", 9)).alias("s_all"), F.length("value").alias("l"), F.col("value").alias("value"), "top_id", "any_id", *counts))
        pick = votes.groupBy("first_id", "field_no").agg(best.alias("best"), F.sum("has_top").alias("top_values"), F.sum("s_all").alias("mass"), *[F.sum(c).alias(f"t{c[1:]}") for c in counts])
        if truth is not None:
            drop_work(truth)
        truth = materialise(pick, "p2t")
        row = truth.agg(*[F.sum(f"best.n{c}").alias(f"a{c}") for c in range(8)], *[F.sum(f"t{c}").alias(f"t{c}") for c in range(8)]).first()
        new = {c: ((row[f"a{c}"] or 0) + 1.0) / ((row[f"t{c}"] or 0) + 2.0) for c in range(8)}
        moved = max(abs(new[c] - weight[c]) for c in range(8))
        weight = new
        if moved < tolerance:
            break
    else:
        raise RuntimeError(f"source reliabilities still move by {moved} after {patience} rounds")
    source = F.coalesce(F.col("best.top_id"), F.col("best.any_id"))
    name = F.element_at(F.array(*[F.lit(f) for f in RESOLVED]), F.col("field_no") + 1)
    return truth.select("first_id", name.alias("field_name"), F.col("best.value").alias("value"), source.alias("source_id"),
                        (-F.col("best.s_all") / F.col("mass")).alias("support"), "top_values")


def resolve(spark, sf_dir: str) -> DataFrame:
    src = table(spark, sf_dir, "marin")
    member = materialise(members(src.select("listing_id", *KEY_FIELDS)), "p2m")
    cols = src.select("listing_id", "enriched_at", *RESOLVED)
    return discover(claims_of(cols, member))


def p2_found(spark, sf_dir: str) -> DataFrame:
    """``first_id, source_id, field_name`` of every case: some listings are best on all three counts
    and hold one text. Exact check after truth discovery: exactly one value has claims of that tier."""
    return resolve(spark, sf_dir).where("top_values = 1").select("first_id", "source_id", "field_name")


def p2_survivors(spark, sf_dir: str) -> DataFrame:
    """One record per duplicate group: the chosen value and its source listing for each field."""
    aggs = []
    for f in RESOLVED:
        hit = F.col("field_name") == f
        aggs += [F.max(F.when(hit, F.col("value"))).alias(f), F.max(F.when(hit, F.col("source_id"))).alias(f"{f}_source")]
    return resolve(spark, sf_dir).groupBy("first_id").agg(*aggs)


QUERIES = {"p2_found": p2_found, "p2_survivors": p2_survivors}
_PH = ", ".join("'" + p + "'" for p in PLACEHOLDERS)
_T = r"lower(regexp_replace({0}, '^[\s\x{{A0}}\x{{2009}}]+|[\s\x{{A0}}\x{{2009}}]+$', '', 'g'))"


def _sql() -> str:
    from rosterlake.llm.p7_formatting import _KEYS

    arms = " UNION ALL ".join(
        f"SELECT first_id, listing_id, ts, tc, tw, '{f}' AS field_name, {f} AS v FROM r WHERE {_T.format(f)} NOT IN ({_PH})" + (f" AND regexp_matches({f}, '[0-9]')" if f.startswith("price") else "")
        for f in RESOLVED)
    return f"""WITH k AS ({_KEYS}),
      g AS (SELECT listing_id, min(listing_id) OVER (PARTITION BY kc, kv) AS first_id, count(*) OVER (PARTITION BY kc, kv) AS n FROM k WHERE kc <> '' AND kv <> ''),
      r AS (SELECT g.first_id, m.*, CASE WHEN {_T.format('crawl_status')} = 'success' THEN 1 ELSE 0 END AS ts,
              CASE {_T.format('enrichment_confidence')} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS tc,
              coalesce(epoch_us(enriched_at), -4611686018427387904) AS tw FROM marin m JOIN g USING (listing_id) WHERE n > 1),
      c AS ({arms}),
      b AS (SELECT *, max(ts) OVER w AS bs, max(tc) OVER w AS bc, max(tw) OVER w AS bw FROM c WINDOW w AS (PARTITION BY first_id, field_name))
      SELECT first_id, min(listing_id) AS source_id, field_name FROM b WHERE ts = bs AND tc = bc AND tw = bw
      GROUP BY first_id, field_name HAVING count(DISTINCT v) = 1"""


SQL = {"p2_found": _sql()}
