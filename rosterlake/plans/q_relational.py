"""Queries over deduplication, merging, matching and reporting operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rosterlake.functions import contacts as C
from rosterlake.functions import scoring as S
from rosterlake.functions import text as X
from rosterlake.operators import dedupe, match, merge, quality, report
from rosterlake.plans.fragments import COUNTY_SLUG as _COUNTY_SLUG, HOST as _HOST, MISS as _MISS, SP as _SP, W as _W
from rosterlake.session import table


def directory_rollup(spark, d):
    """Per source host: documents, sorted distinct languages, the longest text's id and all characters."""
    docs = table(spark, d, "documents").where("source IS NOT NULL")
    base = docs.groupBy("source").agg(F.count("*").alias("documents"), dedupe.sorted_distinct("lang").alias("langs"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))
    longest = dedupe.longest_text(docs, ["source"], "text", "doc_id").select("source", F.col("doc_id").alias("longest_doc"))
    return base.join(longest, "source", "left")


def vendor_groups(spark, d):
    """Listings grouped by vendor key: rows, counties, first listing and the longest description's listing."""
    m = table(spark, d, "marin").withColumn("vkey", X.listing_key(F.col("vendor_name"))).where("vkey <> ''")
    g = m.groupBy("vkey").agg(F.count("*").alias("county_rows"), dedupe.sorted_distinct("county").alias("counties"), F.min("listing_id").alias("first_listing"))
    best = dedupe.longest_text(m, ["vkey"], "vendor_description", "listing_id").select("vkey", F.col("listing_id").alias("described_by"))
    return g.join(best, "vkey", "left")


def evidence_pack(spark, d):
    """Per vendor key sorted distinct cities, phones and e-mails, and the first row's address."""
    m = table(spark, d, "marin").withColumn("vkey", X.listing_key(F.col("vendor_name")))
    some = lambda c: F.array_join(F.array_sort(F.collect_set(X.blank_to_null(F.col(c)))), "; ").alias(c)
    return m.groupBy("vkey").agg(some("city"), some("phone"), some("email"), F.min(F.struct("listing_id", "address"))["address"].alias("primary_address"))


def first_seen_dedup(spark, d):
    m = table(spark, d, "marin").select("listing_id", "county", X.name_key_ascii(F.col("vendor_name")).alias("vkey"))
    return dedupe.first_seen(m, ["county", "vkey"], "listing_id")


def last_wins_scores(spark, d):
    j = table(spark, d, "enrichment_jobs").where("listing_id IS NOT NULL").select("listing_id", "job_id", "status", "attempts")
    return dedupe.last_wins(j, ["listing_id"], "job_id")


def duplicate_jobs(spark, d):
    return dedupe.duplicate_keys(table(spark, d, "enrichment_jobs").where("run_id IS NOT NULL AND listing_id IS NOT NULL"), ["run_id", "listing_id"])


def _customers(spark, d):
    base = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    seg = F.when(F.col("c_custkey") % 3 == 0, F.lit("  ")).when(F.col("c_custkey") % 3 == 1, F.upper("c_mktsegment")).otherwise(F.lit("updated"))
    new = base.where("c_custkey % 5 = 0").select("c_custkey", F.lower("c_name").alias("c_name"), seg.alias("c_mktsegment"), F.col("c_custkey").alias("seq"))
    again = base.where("c_custkey % 10 = 0").select("c_custkey", F.col("c_name"), F.lit("second").alias("c_mktsegment"), (F.col("c_custkey") + 10_000_000).alias("seq"))
    return base, new.unionByName(again)


def replace_merge(spark, d):
    base, upd = _customers(spark, d)
    return merge.replace_merge(base, upd, "c_custkey", "seq")


def unmatched_updates(spark, d):
    base, upd = _customers(spark, d)
    return merge.unmatched_updates(base.where("c_custkey % 4 <> 0"), upd, "c_custkey")


def safe_merge(spark, d):
    base, upd = _customers(spark, d)
    return merge.safe_merge(base, dedupe.first_seen(upd, ["c_custkey"], "seq"), "c_custkey", ["c_name", "c_mktsegment"])


def insert_if_absent(spark, d):
    have = table(spark, d, "vendors_placeid_smoke_out").select(X.listing_key(F.col("vendor_name")).alias("vkey"))
    new = table(spark, d, "marin").select("listing_id", X.listing_key(F.col("vendor_name")).alias("vkey"))
    return merge.insert_if_absent(have, new, ["vkey"], "listing_id")


def gained_values(spark, d):
    base, upd = _customers(spark, d)
    old = base.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, F.lit("")).otherwise(F.col("c_mktsegment")))
    return merge.gained_values(old, dedupe.first_seen(upd, ["c_custkey"], "seq").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment")


def field_changes(spark, d):
    base, upd = _customers(spark, d)
    old = base.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, F.lit("")).otherwise(F.col("c_mktsegment")))
    return merge.field_changes(old, dedupe.first_seen(upd, ["c_custkey"], "seq"), "c_custkey", ["c_name", "c_mktsegment"])


def sequence_diff(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("v"))
    return merge.sequence_diff(a, a.where("pos < 20").withColumn("v", F.when(F.col("pos") >= 7, F.lower("v")).otherwise(F.col("v"))), "pos", "v")


def count_guard(spark, d):
    m = table(spark, d, "marin").where("county IS NOT NULL")
    return merge.count_guard(m, m.where("crawl_status = 'success'"), ["county"])


def apply_changes(spark, d):
    m = table(spark, d, "marin").select("listing_id", "county", "booking_capability")
    changes = m.groupBy("county").agg(F.max("booking_capability").alias("booking_capability"))
    return merge.apply_changes(m, changes, "county", "booking_capability")


def tiered_match(spark, d):
    cols = [F.lower(F.trim("county")).alias("county"), X.name_key_ascii(F.col("vendor_name")).alias("name"), C.host(F.col("website_url")).alias("host")]
    left = table(spark, d, "vendors_placeid_smoke_out").select(F.col("row_id").alias("id"), *cols)
    right = table(spark, d, "marin").select(F.col("listing_id").alias("id"), *cols)
    return match.tiered_match(left, right, "county", "name", "host")


def domain_best_source(spark, d):
    """For each place row the best listing of its host: successful first, then most prices, then earliest."""
    v = table(spark, d, "vendors_placeid_smoke_out").select("row_id", C.host(F.col("website_url")).alias("host")).where("host IS NOT NULL")
    m = table(spark, d, "marin").select(C.host(F.col("website_url")).alias("host"), "listing_id", "crawl_status", "price_16hr_full").where("host IS NOT NULL")
    rank = [(F.coalesce(F.col("crawl_status"), F.lit("")) == "success").cast("int"), F.col("price_16hr_full").isNotNull().cast("int"), -F.col("listing_id")]
    return match.best_by_rank(v, m.select("host", "listing_id", "crawl_status", "price_16hr_full"), ["host"], "row_id", rank).select("row_id", "host", "listing_id", "crawl_status")


def candidate_rank_margin(spark, d):
    """Place rows resolved: up to five distinct candidate places of each, scored by phone, domain, name,
    city, state and address, ranked with the margin to the next, and banded (the best one demoted where the
    margin is small). What a place is like tells the first row that holds its id; candidates that no row
    describes are left out."""
    v = table(spark, d, "vendors_placeid_smoke_out")
    keys = [C.phone_digits(F.col("phone")).alias("phone"), C.host(F.col("website_url")).alias("domain"), *[X.folded_key(F.col(c)).alias(n) for c, n in (("vendor_name", "name"), ("city", "city"), ("state", "state"), ("address", "address"))]]
    rows = v.select("row_id", F.posexplode(S.candidate_ids(F.col("raw_candidate_place_ids"))).alias("position", "candidate"), *keys)
    places = v.select(F.trim("google_place_id").alias("candidate"), "row_id", *keys).where("candidate <> ''")
    first = places.groupBy("candidate").agg(F.min(F.struct("row_id", "phone", "domain", "name", "address")).alias("c"))
    j = rows.join(first, "candidate")
    score, why = S.place_score({k: F.col(k) for k in ("phone", "domain", "name", "city", "state", "address")}, {k: F.col(f"c.{k}") for k in ("phone", "domain", "name", "address")})
    ranked = match.rank_candidates(j.select("row_id", "candidate", "position", score.cast("double").alias("score"), why.alias("reasons")), "row_id", "score", "position")
    band = S.demoted(S.band(F.col("score"), [(80, "high"), (58, "medium"), (35, "low")], "none"), F.when(F.col("rank") == 1, F.col("margin")).otherwise(F.lit(999.0)))
    return ranked.withColumn("band", band)


def _representatives(v, col):
    """The first row of each place: others are compared with it, never all with all."""
    return v.groupBy("google_place_id").agg(F.min(F.struct("row_id", col)).alias("b")).select("google_place_id", "b.row_id", f"b.{col}")


def token_overlap(spark, d):
    v = table(spark, d, "vendors_placeid_smoke_out").select("google_place_id", "row_id", F.split(X.merge_key_hard(F.col("vendor_name")), " ").alias("t")).where("google_place_id <> ''")
    a, b = _representatives(v, "t").toDF("google_place_id", "row_a", "ta"), v.toDF("google_place_id", "row_b", "tb")
    return a.join(b, "google_place_id").where("row_a < row_b").select("row_a", "row_b", F.round(S.token_overlap(F.col("ta"), F.col("tb")), 6).alias("overlap"))


def slug_similarity(spark, d):
    v = table(spark, d, "vendors_placeid_smoke_out").select("google_place_id", "row_id", X.slugify(F.col("vendor_name")).alias("s")).where("google_place_id <> ''")
    a, b = _representatives(v, "s").toDF("google_place_id", "row_a", "sa"), v.toDF("google_place_id", "row_b", "sb")
    return a.join(b, "google_place_id").where("row_a < row_b").select("row_a", "row_b", F.round(S.slug_similarity(F.col("sa"), F.col("sb")), 6).alias("similarity"))


def membership_label(spark, d):
    j = table(spark, d, "enrichment_jobs").select("job_id", "run_id")
    known = j.where("job_id % 7 = 0").select("run_id")
    return match.membership(j, known, "run_id", "[a-f0-9]{10}$", ("indexed", "not_indexed", "unknown")).select("job_id", "run_id", "label")


def county_cascade(spark, d):
    """Listings' county texts resolved to county ids: slug as written, normalised slug, then name."""
    ref = table(spark, d, "counties")
    m = table(spark, d, "marin").select("listing_id", "county")
    c = F.col("county")
    keys = [(c, F.col("slug")), (X.county_slug(c), F.col("slug")), (F.lower(X.strip_ws(c)), F.lower(F.col("county_name")))]
    return match.resolve_cascade(m, "county", ref, "county_id", keys).select("listing_id", F.col("resolved").alias("county_id"), "outcome")


def single_lookup(spark, d):
    """Counties by exact slug through a case-insensitive match of literal text, none or one row each."""
    return table(spark, d, "counties").where(F.lower("county_name") == F.lower(F.lit("SAN DIEGO"))).select("county_id", "slug")


def status_counts(spark, d):
    return report.group_counts(table(spark, d, "marin"), "crawl_status")


def conditional_counts(spark, d):
    m = table(spark, d, "marin")
    return m.agg(F.count("*").alias("total"), F.count_if(F.col("website_url").isNotNull()).alias("with_url"), F.count_if(F.col("crawl_status") == "failed").alias("failed"),
                 F.count_if(F.col("price_16hr_full").rlike("[0-9]")).alias("priced"), report.share(F.col("crawl_status") == "success").alias("success_pct"))


def field_coverage(spark, d):
    return report.coverage(table(spark, d, "marin"), ["email", "phone", "website_url", "address", "price_16hr_full", "price_8hr_renewal", "price_add_a_gun"])


def group_plus_total(spark, d):
    return report.group_and_total(table(spark, d, "san_diego"), "source_type", "website_url")


def score_crosstab(spark, d):
    t = table(spark, d, "vendors_placeid_smoke_out").withColumn("reviewed", F.when(X.is_missing(F.col("needs_review")), "clean").otherwise("flagged"))
    return report.crosstab(t, "match_confidence", "reviewed", ["clean", "flagged"])


def upper_median(spark, d):
    return report.upper_median(table(spark, d, "documents"), ["source_type"], "n_chars").withColumn("mean", F.round("mean", 4))


def mode_first_seen(spark, d):
    return report.mode_first_seen(table(spark, d, "marin").where("state IS NOT NULL"), ["state"], "booking_capability", "listing_id")


def top_errors(spark, d):
    j = table(spark, d, "enrichment_jobs").where("error_summary IS NOT NULL")
    return j.groupBy("error_summary").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error_summary").limit(3)


def paged_queue(spark, d):
    j = table(spark, d, "enrichment_jobs").select("job_id", "status", "created_at")
    return report.page(j, [F.col("created_at").desc_nulls_last(), F.col("job_id")], 2, 50)


def newest_open(spark, d):
    j = table(spark, d, "enrichment_jobs").where(F.col("status").isin("queued", "running"))
    return j.orderBy(F.col("created_at").desc_nulls_last(), "job_id").limit(200).select("job_id", "status")


def two_key_order(spark, d):
    m = table(spark, d, "marin").select("listing_id", "vendor_name", "county")
    w = W.orderBy(F.col("n").desc(), "vendor_name")
    return m.groupBy("vendor_name").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "vendor_name").limit(25).withColumn("position", F.row_number().over(w))


def locale_order(spark, d):
    """Documents per language and county ordered without regard to case and accents."""
    g = table(spark, d, "counties").select("county_id", "county_name")
    return g.orderBy(F.collate("county_name", "UNICODE_CI_AI"), "county_id")


def round_robin_sample(spark, d):
    """Twelve rows, one of each county in turn."""
    m = table(spark, d, "san_diego").select("row_id", "city").where("city IS NOT NULL")
    w = W.partitionBy("city").orderBy("row_id")
    return m.withColumn("rn", F.row_number().over(w)).where("rn <= 12").orderBy("rn", "city").limit(12)


def key_union(spark, d):
    a, b = table(spark, d, "marin").select(X.listing_key(F.col("vendor_name")).alias("k")), table(spark, d, "vendors_placeid_smoke_out").select(X.listing_key(F.col("vendor_name")).alias("k"))
    return a.union(b).distinct()


def key_difference(spark, d):
    a, b = table(spark, d, "vendors_placeid_smoke_out").select(X.listing_key(F.col("vendor_name")).alias("k")), table(spark, d, "marin").select(X.listing_key(F.col("vendor_name")).alias("k"))
    return a.subtract(b)


def union_by_name(spark, d):
    a = table(spark, d, "san_diego").select("row_id", "vendor_name", "source_type")
    b = table(spark, d, "vendors_placeid_smoke_out").select("row_id", "vendor_name", "match_confidence")
    return a.unionByName(b, allowMissingColumns=True)


def dq_violations(spark, d):
    rules = {
        "bad_confidence": ~F.col("parse_confidence").between(0, 1), "no_text": X.is_missing(F.col("raw_text")), "no_county": F.col("county_id").isNull(),
        "has_warnings": F.size("parse_warnings") > 0, "bad_json": F.col("raw_json").isNotNull() & F.try_parse_json("raw_json").isNull(),
    }
    return table(spark, d, "county_source_records").select("record_id", quality.violations(rules).alias("violations"))


def unique_rule(spark, d):
    return quality.unique_violations(table(spark, d, "county_source_records").where("county_source_id IS NOT NULL AND row_index IS NOT NULL"), ["county_source_id", "row_index"])


def orphan_jobs(spark, d):
    return quality.orphans(table(spark, d, "enrichment_jobs").select("job_id", "listing_id"), "listing_id", table(spark, d, "marin").where("crawl_status = 'success'"), "listing_id")


def review_flags(spark, d):
    known = table(spark, d, "counties").select(F.col("slug").alias("cslug"), F.lit(True).alias("hit"))
    m = table(spark, d, "marin").select("listing_id", "phone", "crawl_status", X.county_slug(F.col("county")).alias("cslug"))
    j = m.join(F.broadcast(known), "cslug", "left")  # 58 rows, fixed
    rules = {"unknown_county": F.col("hit").isNull(), "bad_phone": ~X.is_missing(F.col("phone")) & (F.length(C.phone_digits(F.col("phone"))) < 10), "crawl_failed": F.col("crawl_status") == "failed"}
    return j.select("listing_id", quality.violations(rules).alias("needs_review"))


def confidence_display(spark, d):
    v = S.leading_number(F.concat(F.col("parse_confidence").cast("string"), F.lit("%")))
    share = F.when(v > 1, v / 100).otherwise(v)
    return table(spark, d, "county_source_records").select("record_id", S.band(share, [(0.85, "high"), (0.6, "medium")], "low").alias("band"))


def evidence_confidence(spark, d):
    has = lambda c: ~X.is_missing(F.col(c))
    score, reasons = S.evidence_score(0.2, [("site", has("website_url"), 0.35), ("phone", has("phone"), 0.25), ("failed", F.coalesce(F.col("crawl_status") == "failed", F.lit(False)), -0.4)])
    return table(spark, d, "marin").select("listing_id", score.alias("score"), F.array_join(reasons, "|").alias("reasons"))


def evidence_long(spark, d):
    """Field values of listings as long rows, and the latest per vendor key and field."""
    m = table(spark, d, "marin").withColumn("vkey", X.listing_key(F.col("vendor_name")))
    rows = F.explode(F.array_compact(F.array(*[F.when(~X.is_missing(F.col(c)), F.struct(F.lit(c).alias("field"), F.col(c).alias("value"))) for c in ("phone", "email", "website_url")])))
    long = m.select("vkey", "listing_id", rows.alias("x")).select("vkey", "listing_id", "x.*")
    return long.groupBy("vkey", "field").agg(F.max(F.struct("listing_id", "value")).alias("b"), F.count("*").alias("n")).select("vkey", "field", "b.listing_id", "b.value", "n")


QUERIES = {f.__name__: f for f in (
    directory_rollup, vendor_groups, evidence_pack, first_seen_dedup, last_wins_scores, duplicate_jobs, replace_merge, unmatched_updates, safe_merge, insert_if_absent, gained_values, field_changes,
    sequence_diff, count_guard, apply_changes, tiered_match, domain_best_source, candidate_rank_margin, token_overlap, slug_similarity, membership_label, county_cascade, single_lookup, status_counts,
    conditional_counts, field_coverage, group_plus_total, score_crosstab, upper_median, mode_first_seen, top_errors, paged_queue, newest_open, two_key_order, locale_order, round_robin_sample, key_union,
    key_difference, union_by_name, dq_violations, unique_rule, orphan_jobs, review_flags, confidence_display, evidence_confidence, evidence_long)}

_KEY = "lower(trim(vendor_name, ' '))"
_ASCII = _SP.format(r"regexp_replace(lower(" + _W.format("vendor_name") + r"), '[^A-Za-z0-9_\s]', '', 'g')")


def _fold(c: str) -> str:
    """The SQL of ``text.folded_key``."""
    out = f"lower(coalesce({c}, ''))"
    for letter, plain in X.LATIN:
        out = f"replace({out}, '{letter}', '{plain}')"
    return rf"trim(regexp_replace(regexp_replace({out}, '[^A-Za-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g'), ' ')"


def _overlap(a: str, b: str) -> str:
    """The SQL of ``scoring.key_overlap``."""
    x, y = f"list_distinct(string_split({a}, ' '))", f"list_distinct(string_split({b}, ' '))"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE len(list_filter({x}, lambda t: list_contains({y}, t)))::DOUBLE / greatest(len({x}), len({y})) END"


_DIG = "CASE WHEN length(regexp_replace({0}, '[^0-9]', '', 'g')) = 11 AND regexp_replace({0}, '[^0-9]', '', 'g') LIKE '1%' THEN substr(regexp_replace({0}, '[^0-9]', '', 'g'), 2, 10) ELSE regexp_replace({0}, '[^0-9]', '', 'g') END"
_BASE = "base AS (SELECT c_custkey, c_name, c_mktsegment FROM customer)"
_UPD = f"""{_BASE}, upd AS (SELECT c_custkey, lower(c_name) AS c_name, CASE c_custkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN upper(c_mktsegment) ELSE 'updated' END AS c_mktsegment, c_custkey AS seq FROM base WHERE c_custkey % 5 = 0
    UNION ALL SELECT c_custkey, c_name, 'second', c_custkey + 10000000 FROM base WHERE c_custkey % 10 = 0)"""
_FIRST = "f AS (SELECT * FROM upd QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY seq) = 1)"
_OLD = "o AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END AS c_mktsegment FROM base)"
_N = r"nullif(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '')"
_NN = ", ".join(f"{_N.format('o.' + f)} AS o_{f}, {_N.format('f.' + f)} AS n_{f}" for f in ("c_name", "c_mktsegment"))
SQL = {
    "directory_rollup": """WITH b AS (SELECT source, count(*) AS documents, array_to_string(list_sort(list_distinct(list(lang) FILTER (lang IS NOT NULL))), '|') AS langs, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars FROM documents WHERE source IS NOT NULL GROUP BY source),
        l AS (SELECT source, doc_id AS longest_doc FROM documents WHERE coalesce(length(text), 0) > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) = 1)
        SELECT b.source, documents, coalesce(langs, '') AS langs, chars, longest_doc FROM b LEFT JOIN l USING (source)""",
    "vendor_groups": f"""WITH m AS (SELECT *, {_KEY} AS vkey FROM marin), g AS (SELECT vkey, count(*) AS county_rows, array_to_string(list_sort(list_distinct(list(county) FILTER (county IS NOT NULL))), '|') AS counties, min(listing_id) AS first_listing FROM m WHERE vkey <> '' GROUP BY vkey),
        l AS (SELECT vkey, listing_id AS described_by FROM m WHERE coalesce(length(vendor_description), 0) > 0 QUALIFY row_number() OVER (PARTITION BY vkey ORDER BY length(vendor_description) DESC, listing_id) = 1)
        SELECT g.*, described_by FROM g LEFT JOIN l USING (vkey)""",
    "evidence_pack": f"""WITH m AS (SELECT *, {_KEY} AS vkey FROM marin), g AS (SELECT vkey, {', '.join(f"coalesce(array_to_string(list_sort(list_distinct(list({_N.format(c)}) FILTER ({_N.format(c)} IS NOT NULL))), '; '), '') AS {c}" for c in ('city', 'phone', 'email'))} FROM m GROUP BY vkey),
        a AS (SELECT vkey, address AS primary_address FROM m QUALIFY row_number() OVER (PARTITION BY vkey ORDER BY listing_id) = 1) SELECT g.*, primary_address FROM g LEFT JOIN a ON g.vkey IS NOT DISTINCT FROM a.vkey""",
    "first_seen_dedup": f"""SELECT listing_id, county, vkey FROM (SELECT listing_id, county, {_ASCII} AS vkey FROM marin) WHERE county <> '' AND vkey <> '' QUALIFY row_number() OVER (PARTITION BY county, vkey ORDER BY listing_id) = 1""",
    "last_wins_scores": """SELECT listing_id, job_id, status, attempts, first_pos FROM (SELECT *, min(job_id) OVER (PARTITION BY listing_id) AS first_pos FROM enrichment_jobs WHERE listing_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY job_id DESC) = 1""",
    "duplicate_jobs": "SELECT run_id, listing_id, count(*) AS n FROM enrichment_jobs WHERE run_id IS NOT NULL AND listing_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "replace_merge": f"""WITH {_UPD}, l AS (SELECT * FROM upd QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY seq DESC) = 1)
        SELECT b.c_custkey, CASE WHEN l.seq IS NULL THEN b.c_name ELSE l.c_name END AS c_name, CASE WHEN l.seq IS NULL THEN b.c_mktsegment ELSE l.c_mktsegment END AS c_mktsegment, l.seq IS NOT NULL AS replaced FROM base b LEFT JOIN l USING (c_custkey)""",
    "unmatched_updates": f"WITH {_UPD} SELECT DISTINCT c_custkey FROM upd WHERE c_custkey NOT IN (SELECT c_custkey FROM base WHERE c_custkey % 4 <> 0)",
    "safe_merge": f"""WITH {_UPD}, {_FIRST}, m AS (SELECT b.c_custkey, b.c_name AS on_, b.c_mktsegment AS om, coalesce({_N.format('f.c_name')}, b.c_name) AS c_name, coalesce({_N.format('f.c_mktsegment')}, b.c_mktsegment) AS c_mktsegment FROM base b LEFT JOIN f USING (c_custkey))
        SELECT c_custkey, c_name, c_mktsegment, array_to_string(list_filter([CASE WHEN c_name IS DISTINCT FROM on_ THEN 'c_name' END, CASE WHEN c_mktsegment IS DISTINCT FROM om THEN 'c_mktsegment' END], lambda x: x IS NOT NULL), '|') AS changed FROM m""",
    "insert_if_absent": f"""SELECT vkey, listing_id FROM (SELECT listing_id, {_KEY} AS vkey FROM marin) WHERE vkey <> '' AND vkey NOT IN (SELECT {_KEY} FROM vendors_placeid_smoke_out WHERE vendor_name IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY vkey ORDER BY listing_id) = 1""",
    "gained_values": f"WITH {_UPD}, {_FIRST}, {_OLD} SELECT f.c_custkey, {_N.format('f.c_mktsegment')} AS c_mktsegment FROM f LEFT JOIN o USING (c_custkey) WHERE {_N.format('f.c_mktsegment')} IS NOT NULL AND {_N.format('o.c_mktsegment')} IS NULL",
    "field_changes": f"""WITH {_UPD}, {_FIRST}, {_OLD}, j AS (SELECT {_NN} FROM o JOIN f USING (c_custkey)), x AS (SELECT 'c_name' AS field, o_c_name AS o, n_c_name AS n FROM j UNION ALL SELECT 'c_mktsegment', o_c_mktsegment, n_c_mktsegment FROM j)
        SELECT field, count(*) FILTER (o IS NULL AND n IS NOT NULL) AS newly_populated, count(*) FILTER (o <> n) AS changed, count(*) FILTER (o IS NOT NULL AND n IS NULL) AS emptied FROM x GROUP BY field""",
    "sequence_diff": """WITH a AS (SELECT n_nationkey AS pos, n_name AS v FROM nation), b AS (SELECT pos, CASE WHEN pos >= 7 THEN lower(v) ELSE v END AS v FROM a WHERE pos < 20)
        SELECT min(CASE WHEN a.v IS DISTINCT FROM b.v THEN pos END) AS first_diff, count(a.v) AS len_a, count(b.v) AS len_b FROM a FULL JOIN b USING (pos)""",
    "count_guard": """WITH x AS (SELECT county, count(*) AS n_before, count(*) FILTER (crawl_status = 'success') AS n_after FROM marin WHERE county IS NOT NULL GROUP BY county)
        SELECT *, CASE WHEN n_before > 0 AND n_after = 0 THEN 'emptied' WHEN n_after < n_before THEN 'shrunk' ELSE 'ok' END AS verdict FROM x""",
    "apply_changes": "SELECT listing_id, county, CASE WHEN county IS NULL THEN booking_capability ELSE coalesce(max(booking_capability) OVER (PARTITION BY county), booking_capability) END AS booking_capability FROM marin",
    "tiered_match": f"""WITH l AS (SELECT row_id AS id, lower(trim(county, ' ')) AS blk, {_ASCII} AS nm, {_HOST} AS h FROM vendors_placeid_smoke_out), r AS (SELECT listing_id AS id, lower(trim(county, ' ')) AS blk, {_ASCII} AS nm, {_HOST} AS h FROM marin),
        t AS (SELECT l.id, r.id AS rid, 1 AS tier FROM l JOIN r ON l.blk = r.blk AND l.nm = r.nm UNION ALL SELECT l.id, r.id, 2 FROM l JOIN r ON l.blk = r.blk AND starts_with(r.nm, l.nm || ' ')
          UNION ALL SELECT l.id, r.id, 3 FROM l JOIN r ON l.blk = r.blk AND l.h = r.h),
        p AS (SELECT id, tier, count(DISTINCT rid) AS n, min(rid) AS rid FROM t GROUP BY id, tier QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier) = 1)
        SELECT l.id, CASE WHEN n = 1 THEN rid END AS match_id, CASE WHEN n IS NULL THEN 'no_match' WHEN n = 1 THEN ['exact', 'prefix', 'domain'][tier] ELSE ['duplicate_exact', 'ambiguous_prefix', 'ambiguous_domain'][tier] END AS outcome FROM l LEFT JOIN p USING (id)""",
    "domain_best_source": f"""WITH v AS (SELECT row_id, {_HOST} AS host FROM vendors_placeid_smoke_out), m AS (SELECT {_HOST} AS host, listing_id, crawl_status, price_16hr_full FROM marin),
        b AS (SELECT * FROM m WHERE host IS NOT NULL QUALIFY row_number() OVER (PARTITION BY host ORDER BY CASE WHEN coalesce(crawl_status, '') = 'success' THEN 0 ELSE 1 END, CASE WHEN price_16hr_full IS NOT NULL THEN 0 ELSE 1 END, listing_id) = 1)
        SELECT row_id, v.host, listing_id, crawl_status FROM v LEFT JOIN b USING (host) WHERE v.host IS NOT NULL""",
    "candidate_rank_margin": f"""WITH k AS (SELECT row_id, trim(google_place_id, ' ') AS pid, raw_candidate_place_ids AS raw, coalesce({_DIG.format('phone')}, '') AS phone, coalesce({_HOST}, '') AS domain,
            {_fold('vendor_name')} AS name, {_fold('city')} AS city, {_fold('state')} AS state, {_fold('address')} AS address FROM vendors_placeid_smoke_out),
        e AS (SELECT *, list_filter(list_transform(string_split_regex(raw, '[,|]'), lambda x: trim(x, ' ')), lambda x: x <> '') AS ids FROM k WHERE raw IS NOT NULL),
        u AS (SELECT *, list_slice(list_filter(ids, lambda x, i: list_position(ids, x) = i), 1, 5) AS five FROM e),
        c AS (SELECT row_id, phone, domain, name, city, state, address, unnest(five) AS candidate, unnest(range(len(five))) AS position FROM u),
        p AS (SELECT pid, phone AS cp, domain AS cd, name AS cn, address AS ca FROM k WHERE pid <> '' QUALIFY row_number() OVER (PARTITION BY pid ORDER BY row_id) = 1),
        o AS (SELECT *, {_overlap('name', 'cn')} AS no, {_overlap('address', 'ca')} AS ao FROM c JOIN p ON candidate = pid),
        q AS (SELECT row_id, candidate, CAST(position AS INT) AS position,
            [CASE WHEN phone = '' OR cp = '' THEN 0 WHEN phone = cp THEN 45 ELSE -15 END, CASE WHEN domain = '' OR cd = '' THEN 0 WHEN domain = cd THEN 25 ELSE -8 END,
             CASE WHEN no >= 0.85 THEN 25 WHEN no >= 0.6 THEN 16 WHEN no > 0 THEN 6 ELSE -15 END, CASE WHEN city = '' THEN 0 WHEN contains(ca, city) THEN 10 ELSE -7 END,
             CASE WHEN state = '' THEN 0 WHEN contains(ca, state) THEN 6 ELSE -5 END, CASE WHEN address = '' THEN 0 WHEN ao >= 0.6 THEN 12 WHEN ao >= 0.35 THEN 6 ELSE 0 END] AS pts FROM o),
        s AS (SELECT row_id, candidate, position, CAST(list_sum(pts) AS DOUBLE) AS score, array_to_string(list_filter([CASE pts[1] WHEN 45 THEN 'exact_phone_match' WHEN -15 THEN 'phone_conflict' END,
            CASE pts[2] WHEN 25 THEN 'website_domain_match' WHEN -8 THEN 'website_domain_conflict' END,
            CASE pts[3] WHEN 25 THEN 'strong_name_similarity' WHEN 16 THEN 'moderate_name_similarity' WHEN 6 THEN 'weak_name_overlap' ELSE 'name_mismatch' END,
            CASE pts[4] WHEN 10 THEN 'city_match' WHEN -7 THEN 'city_mismatch' END, CASE pts[5] WHEN 6 THEN 'state_match' WHEN -5 THEN 'state_mismatch' END,
            CASE pts[6] WHEN 12 THEN 'address_proximity_strong' WHEN 6 THEN 'address_proximity_partial' END], lambda x: x IS NOT NULL), '|') AS reasons FROM q),
        r AS (SELECT *, row_number() OVER w AS rank, coalesce(score - lead(score) OVER w, 999.0) AS margin FROM s WINDOW w AS (PARTITION BY row_id ORDER BY score DESC, position))
        SELECT *, CASE WHEN score >= 80 AND (rank > 1 OR margin >= 10) THEN 'high' WHEN score >= 58 THEN 'medium' WHEN score >= 35 THEN 'low' ELSE 'none' END AS band FROM r""",
    "token_overlap": """WITH v AS (SELECT google_place_id AS g, row_id, list_distinct(string_split(trim(regexp_replace(lower(vendor_name), '[^a-z0-9]+', ' ', 'g')), ' ')) AS t FROM vendors_placeid_smoke_out WHERE google_place_id <> '')
        SELECT a.row_id AS row_a, b.row_id AS row_b, round(100.0 * len(list_intersect(a.t, b.t)) / greatest(len(a.t), len(b.t)), 6) AS overlap FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY g ORDER BY row_id) = 1) a JOIN v b ON a.g = b.g AND a.row_id < b.row_id""",
    "membership_label": """SELECT job_id, run_id, CASE WHEN run_id IN (SELECT run_id FROM enrichment_jobs WHERE job_id % 7 = 0 AND run_id IS NOT NULL) THEN 'indexed' WHEN regexp_matches(run_id, '[a-f0-9]{10}$') THEN 'not_indexed' ELSE 'unknown' END AS label FROM enrichment_jobs""",
    "county_cascade": f"""WITH m AS (SELECT listing_id, county FROM marin), t AS (SELECT m.listing_id, c.county_id, 0 AS step FROM m JOIN counties c ON m.county = c.slug UNION ALL SELECT m.listing_id, c.county_id, 1 FROM m JOIN counties c ON {_COUNTY_SLUG.format('m.county')} = c.slug
          UNION ALL SELECT m.listing_id, c.county_id, 2 FROM m JOIN counties c ON lower({_W.format('m.county')}) = lower(c.county_name)),
        p AS (SELECT listing_id, step, count(DISTINCT county_id) AS n, min(county_id) AS county_id FROM t GROUP BY listing_id, step QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY step) = 1)
        SELECT m.listing_id, CASE WHEN n = 1 THEN p.county_id END AS county_id, CASE WHEN n IS NULL THEN 'unknown' WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS outcome FROM m LEFT JOIN p USING (listing_id)""",
    "single_lookup": "SELECT county_id, slug FROM counties WHERE lower(county_name) = lower('SAN DIEGO')",
    "status_counts": f"SELECT coalesce(nullif({_W.format('crawl_status')}, ''), 'null') AS crawl_status, count(*) AS n FROM marin GROUP BY 1",
    "conditional_counts": """SELECT count(*) AS total, count(website_url) AS with_url, count(*) FILTER (crawl_status = 'failed') AS failed, count(*) FILTER (regexp_matches(price_16hr_full, '[0-9]')) AS priced,
        round(100.0 * count(*) FILTER (crawl_status = 'success') / greatest(count(*), 1), 1) AS success_pct FROM marin""",
    "field_coverage": " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS filled, count(*) AS total, round(100.0 * count({c}) / greatest(count(*), 1), 1) AS pct FROM marin" for c in ("email", "phone", "website_url", "address", "price_16hr_full", "price_8hr_renewal", "price_add_a_gun")),
    "group_plus_total": f"""SELECT source_type, count(*) AS total, count(*) FILTER (coalesce({_W.format('website_url')}, '') <> '') AS with_value, count(*) FILTER (coalesce({_W.format('website_url')}, '') = '') AS without_value, grouping(source_type) AS is_total FROM san_diego GROUP BY ROLLUP (source_type)""",
    "score_crosstab": f"SELECT match_confidence, count(*) FILTER ({_MISS.format('needs_review')}) AS clean, count(*) FILTER (NOT {_MISS.format('needs_review')}) AS flagged FROM vendors_placeid_smoke_out GROUP BY match_confidence",
    "upper_median": "SELECT source_type, list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] AS upper_median, round(avg(n_chars), 4) AS mean, count(*) AS n FROM documents WHERE n_chars IS NOT NULL GROUP BY source_type",
    "mode_first_seen": """WITH c AS (SELECT state, booking_capability, count(*) AS k, min(listing_id) AS s FROM marin WHERE state IS NOT NULL AND booking_capability IS NOT NULL GROUP BY ALL)
        SELECT state, booking_capability AS mode, k AS n FROM c QUALIFY row_number() OVER (PARTITION BY state ORDER BY k DESC, s) = 1""",
    "top_errors": "SELECT error_summary, count(*) AS n FROM enrichment_jobs WHERE error_summary IS NOT NULL GROUP BY 1 ORDER BY n DESC, error_summary LIMIT 3",
    "paged_queue": """SELECT job_id, status, created_at, greatest(1, CAST(ceil((SELECT count(*) FROM enrichment_jobs) / 50.0) AS INT)) AS page_count FROM enrichment_jobs ORDER BY created_at DESC NULLS LAST, job_id LIMIT 50 OFFSET 50""",
    "newest_open": "SELECT job_id, status FROM enrichment_jobs WHERE status IN ('queued', 'running') ORDER BY created_at DESC NULLS LAST, job_id LIMIT 200",
    "two_key_order": "SELECT vendor_name, n, row_number() OVER (ORDER BY n DESC, vendor_name) AS position FROM (SELECT vendor_name, count(*) AS n FROM marin GROUP BY 1 ORDER BY n DESC, vendor_name LIMIT 25)",
    "locale_order": "SELECT county_id, county_name FROM counties",
    "round_robin_sample": "SELECT row_id, city, rn FROM (SELECT row_id, city, row_number() OVER (PARTITION BY city ORDER BY row_id) AS rn FROM san_diego WHERE city IS NOT NULL) ORDER BY rn, city LIMIT 12",
    "key_union": f"SELECT {_KEY} AS k FROM marin UNION SELECT {_KEY} FROM vendors_placeid_smoke_out",
    "key_difference": f"SELECT {_KEY} AS k FROM vendors_placeid_smoke_out EXCEPT SELECT {_KEY} FROM marin",
    "union_by_name": "SELECT row_id, vendor_name, source_type, NULL AS match_confidence FROM san_diego UNION ALL SELECT row_id, vendor_name, NULL, match_confidence FROM vendors_placeid_smoke_out",
    "dq_violations": f"""SELECT record_id, array_to_string(list_sort(list_filter([CASE WHEN NOT (parse_confidence BETWEEN 0 AND 1) THEN 'bad_confidence' END, CASE WHEN {_MISS.format('raw_text')} THEN 'no_text' END, CASE WHEN county_id IS NULL THEN 'no_county' END,
        CASE WHEN len(parse_warnings) > 0 THEN 'has_warnings' END, CASE WHEN raw_json IS NOT NULL AND NOT json_valid(raw_json) THEN 'bad_json' END], lambda x: x IS NOT NULL)), '|') AS violations FROM county_source_records""",
    "unique_rule": "SELECT county_source_id, row_index, count(*) AS n FROM county_source_records WHERE county_source_id IS NOT NULL AND row_index IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "orphan_jobs": "SELECT job_id, listing_id FROM enrichment_jobs WHERE listing_id IS NOT NULL AND listing_id NOT IN (SELECT listing_id FROM marin WHERE crawl_status = 'success')",
    "review_flags": f"""SELECT listing_id, array_to_string(list_sort(list_filter([CASE WHEN c.slug IS NULL THEN 'unknown_county' END, CASE WHEN NOT ({_MISS.format('phone')}) AND length({_DIG.format('phone')}) < 10 THEN 'bad_phone' END, CASE WHEN crawl_status = 'failed' THEN 'crawl_failed' END], lambda x: x IS NOT NULL)), '|') AS needs_review
        FROM marin m LEFT JOIN counties c ON {_COUNTY_SLUG.format('m.county')} = c.slug""",
    "confidence_display": "SELECT record_id, CASE WHEN parse_confidence >= 0.85 THEN 'high' WHEN parse_confidence >= 0.6 THEN 'medium' ELSE 'low' END AS band FROM county_source_records",
    "evidence_confidence": f"""WITH x AS (SELECT listing_id, NOT ({_MISS.format('website_url')}) AS a, NOT ({_MISS.format('phone')}) AS b, coalesce(crawl_status = 'failed', false) AS c FROM marin)
        SELECT listing_id, round(least(greatest(0.2 + CASE WHEN a THEN 0.35 ELSE 0 END + CASE WHEN b THEN 0.25 ELSE 0 END + CASE WHEN c THEN -0.4 ELSE 0 END, 0), 1), 6) AS score,
        array_to_string(list_filter([CASE WHEN a THEN 'site' END, CASE WHEN b THEN 'phone' END, CASE WHEN c THEN 'failed' END], lambda x: x IS NOT NULL), '|') AS reasons FROM x""",
    "evidence_long": f"""WITH m AS (SELECT *, {_KEY} AS vkey FROM marin), l AS ({' UNION ALL '.join(f"SELECT vkey, listing_id, '{c}' AS field, {c} AS value FROM m WHERE NOT ({_MISS.format(c)})" for c in ('phone', 'email', 'website_url'))})
        SELECT vkey, field, listing_id, value, count(*) OVER (PARTITION BY vkey, field) AS n FROM l QUALIFY row_number() OVER (PARTITION BY vkey, field ORDER BY listing_id DESC) = 1""",
}
