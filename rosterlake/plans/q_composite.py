"""Composite pipelines: lookups with defaults, outcome ladders, clean-up passes, projections, reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.functions import contacts as C
from rosterlake.functions import scoring as S
from rosterlake.functions import text as X
from rosterlake.operators import dedupe, match, quality, report
from rosterlake.plans.fragments import COUNTY_SLUG as _COUNTY_SLUG, HOST as _HOST, MISS as _MISS, SLUG as _SLUG, SP as _SP, W as _W
from rosterlake.plans.q_text import BLOCKED
from rosterlake.session import table, work_root
from rosterlake.sources import files


def lookup_with_default(spark, d):
    """Jobs with their listing's vendor name, a default where the listing is unknown."""
    m = table(spark, d, "marin").select("listing_id", "vendor_name")
    return table(spark, d, "enrichment_jobs").select("job_id", "listing_id").join(m, "listing_id", "left").select("job_id", F.coalesce("vendor_name", F.lit("Vendor")).alias("vendor_name"))


def semi_join_county(spark, d):
    """Jobs of listings of one county (case-insensitive), by a semi join."""
    m = table(spark, d, "marin").where(F.lower(F.trim("county")) == "san-diego").select("listing_id")
    return table(spark, d, "enrichment_jobs").join(m, "listing_id", "left_semi").select("job_id", "listing_id")


def positional_lookup(spark, d):
    """Parsed lines joined back to saved rows by source and row index; repeated positions take the first row."""
    r = table(spark, d, "county_source_records").where("county_source_id IS NOT NULL AND row_index IS NOT NULL")
    saved = dedupe.first_seen(r.select("county_source_id", "row_index", "record_id"), ["county_source_id", "row_index"], "record_id").withColumnRenamed("record_id", "saved_id")
    return r.select("record_id", "county_source_id", "row_index").join(saved, ["county_source_id", "row_index"]).select("record_id", "saved_id")


def _slug_sides(spark, d):
    names = table(spark, d, "vendors_placeid_smoke_out").select(
        F.col("row_id").alias("id"), F.coalesce(X.slugify(F.col("vendor_name")), F.lit("")).alias("name"), F.coalesce(F.replace(C.host(F.col("website_url")), F.lit("."), F.lit("-")), F.lit("")).alias("domain"))
    slugs = table(spark, d, "marin").select(F.concat(X.slugify(F.col("vendor_name")), F.lit("-"), "listing_id").alias("slug")).where("slug IS NOT NULL")
    return names, slugs


def slug_exact(spark, d):
    """Place rows' names to profile slugs by exact name and by domain."""
    return match.slug_exact(*_slug_sides(spark, d)).select(F.col("id").alias("row_id"), "slug", "method")


def slug_cascade(spark, d):
    """Place rows' names to profile slugs by the whole cascade: exact, domain, fuzzy, constructed."""
    return match.slug_cascade(*_slug_sides(spark, d)).select(F.col("id").alias("row_id"), "slug", "method")


def failed_head(spark, d):
    """The first twelve failed listings by name and id (missing names last) and how many more there are."""
    m = table(spark, d, "marin").where("crawl_status = 'failed'")
    return report.head_sample(m, [F.col("vendor_name").isNull(), F.col("vendor_name"), F.col("listing_id")], "vendor_name", 12)


def skip_reasons(spark, d):
    """Why jobs can't be processed, counted."""
    m = table(spark, d, "marin").select("listing_id", "website_url", "crawl_status", F.lit(True).alias("known"))
    j = table(spark, d, "enrichment_jobs").select("job_id", "listing_id").join(m, "listing_id", "left")
    why = F.when(F.col("known").isNull(), "unknown_listing").when(X.is_missing(F.col("website_url")), "no_site").when(F.col("crawl_status") == "failed", "failed_before").otherwise("eligible")
    return j.groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


def rows_to_process(spark, d):
    """The first 100 rows (by id) whose site is blank."""
    return table(spark, d, "san_diego").where(X.is_missing(F.col("website_url"))).select("row_id").orderBy("row_id").limit(100)


def crawl_outcome(spark, d):
    """Outcome ladder of a crawl: no usable URL, failed, unreadable, or success with its fields."""
    m = table(spark, d, "marin")
    out = F.when(C.url_problem(F.col("website_url")).isNotNull(), "no_website").when(F.col("crawl_status") == "failed", "failed").when(F.col("crawl_status") == "parse_error", "parse_error").otherwise("success")
    return m.select("listing_id", out.alias("outcome"), F.when(out == "success", X.blank_to_null(F.col("address"))).alias("address"))


def lookup_outcome(spark, d):
    """Lookup of sites from candidate rows of the same vendor: found, only blocked candidates, or none."""
    m = table(spark, d, "marin").select("listing_id", X.listing_key(F.col("vendor_name")).alias("k"))
    host = C.host(F.col("website_url"))
    v = table(spark, d, "vendors_placeid_smoke_out").where(host.isNotNull()).select(X.listing_key(F.col("vendor_name")).alias("k"), host.alias("host"), "row_id")
    per = v.groupBy("k").agg(F.min(F.when(~F.col("host").isin(*BLOCKED), F.struct("row_id", "host"))).alias("b"), F.count("*").alias("n"))
    j = m.join(per, "k", "left")
    return j.select("listing_id", F.when(F.col("b").isNotNull(), "found").when(F.col("n") > 0, "not_found_blocked").otherwise("not_found").alias("outcome"), F.col("b.host").alias("host"))


def id_assembly(spark, d):
    """Place ids written only for accepted confidences, others kept blank, with the flattened match columns."""
    ok = F.col("match_confidence").isin("high", "medium") & ~X.is_missing(F.col("google_place_id"))
    return table(spark, d, "vendors_placeid_smoke_out").select("row_id", F.when(ok, F.trim("google_place_id")).otherwise("").alias("place_id"), X.list_cell(F.array("match_confidence", "match_reason"), " | ").alias("match"))


def cleanup_pass(spark, d):
    """Slug, first-seen dedup, placeholder drop, state default, phone normalisation and flags, in this order."""
    m = table(spark, d, "san_diego").select("row_id", X.county_slug(F.col("county")).alias("county"), X.name_key_ascii(F.col("vendor_name")).alias("vkey"), F.coalesce(X.blank_to_null(F.col("state")), F.lit("CA")).alias("state"),
                                           C.phone_digits(F.coalesce(F.col("phone"), F.lit(""))).alias("digits"))
    first = dedupe.first_seen(m, ["county", "vkey"], "row_id").where(~F.col("vkey").isin("tbd", "private instructor"))
    rules = {"bad_phone": (F.col("digits") != "") & (F.length("digits") < 10), "no_phone": F.col("digits") == ""}
    return first.select("row_id", "county", "vkey", "state", quality.violations(rules).alias("needs_review"))


TARGET = ("listing_id", "county", "vendor_name", "phone", "google_place_id")


def target_projection(spark, d):
    """Projection to a target column list, blanks for missing columns."""
    return table(spark, d, "marin").select(*files.project_columns(table(spark, d, "marin"), list(TARGET)))


def url_set(spark, d):
    """Distinct canonical URLs of either table."""
    a, b = table(spark, d, "marin").select("website_url"), table(spark, d, "san_diego").select("website_url")
    return a.unionByName(b).where(C.host(F.col("website_url")).isNotNull()).select(C.host(F.col("website_url")).alias("host")).distinct()


def evidence_check(spark, d):
    """Is the record's vendor name contained in its raw line, with an excerpt of at most forty characters."""
    r = table(spark, d, "county_source_records").where("raw_text IS NOT NULL")
    name = F.try_variant_get(F.try_parse_json("raw_json"), "$.vendor_name", "string")
    cut = F.when(F.length("raw_text") > 40, F.concat(F.substring("raw_text", 1, 40), F.lit("…"))).otherwise(F.col("raw_text"))
    return r.select("record_id", F.contains("raw_text", name).alias("supported"), cut.alias("excerpt"))


def combine_jsonl(spark, d):
    """Several JSON-lines files, one name excluded, combined into one frame in file order."""
    root = f"{work_root(spark)}/combine-{id(spark)}"
    n = table(spark, d, "nation")
    schema = T.StructType([T.StructField("n_nationkey", T.LongType()), T.StructField("n_name", T.StringType())])
    for r in range(3):
        files.write_jsonl(n.where(F.col("n_regionkey") == r).select("n_nationkey", "n_name"), f"{root}/part={r}")
    return files.read_jsonl(spark, root, schema.add("part", T.IntegerType())).where("part <> 1").select("n_nationkey", "n_name", "part")


def report_rows(spark, d):
    """A report as long rows: section, key, value, from one pass per section."""
    m = table(spark, d, "marin")
    one = m.agg(F.count("*").alias("rows"), F.count_if(X.is_missing(F.col("phone"))).alias("no_phone"), F.count_if(X.is_missing(F.col("address"))).alias("no_address"))
    totals = one.select(F.explode(F.array(*[F.struct(F.lit("totals").alias("section"), F.lit(c).alias("key"), F.col(c).alias("value")) for c in ("rows", "no_phone", "no_address")])).alias("x")).select("x.*")
    status = report.group_counts(m, "booking_capability").select(F.lit("booking").alias("section"), F.col("booking_capability").alias("key"), F.col("n").alias("value"))
    return totals.unionByName(status)


def overlap_bands(spark, d):
    """Place rows banded by the overlap of their name's tokens with their county's name."""
    v = table(spark, d, "vendors_placeid_smoke_out").where("county IS NOT NULL")
    o = S.token_overlap(F.split(X.merge_key_hard(F.col("vendor_name")), " "), F.split(X.merge_key_hard(F.col("county")), " "))
    return v.groupBy(S.band(o, [(80, "high"), (58, "medium"), (35, "low")], "none").alias("band")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (lookup_with_default, semi_join_county, positional_lookup, slug_exact, slug_cascade, failed_head, skip_reasons, rows_to_process, crawl_outcome, lookup_outcome, id_assembly, cleanup_pass, target_projection,
                                   url_set, evidence_check, combine_jsonl, report_rows, overlap_bands)}

_ASCII = _SP.format(r"regexp_replace(lower(" + _W.format("vendor_name") + r"), '[^A-Za-z0-9_\s]', '', 'g')")
_DIG = "regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g')"
_BL = ", ".join(f"'{b}'" for b in BLOCKED)
SQL = {
    "lookup_with_default": "SELECT job_id, coalesce(vendor_name, 'Vendor') AS vendor_name FROM enrichment_jobs LEFT JOIN marin USING (listing_id)",
    "semi_join_county": "SELECT job_id, listing_id FROM enrichment_jobs WHERE listing_id IN (SELECT listing_id FROM marin WHERE lower(trim(county, ' ')) = 'san-diego')",
    "positional_lookup": "SELECT record_id, min(record_id) OVER (PARTITION BY county_source_id, row_index) AS saved_id FROM county_source_records WHERE county_source_id IS NOT NULL AND row_index IS NOT NULL",
    "slug_exact": f"""WITH sl AS (SELECT {_SLUG.format('vendor_name')} || '-' || listing_id AS slug FROM marin WHERE vendor_name IS NOT NULL), pt AS (SELECT slug, regexp_replace(slug, '-[^-]*$', '') AS part FROM sl),
        v AS (SELECT row_id, coalesce({_SLUG.format('vendor_name')}, '') AS name, coalesce(replace({_HOST}, '.', '-'), '') AS dom FROM vendors_placeid_smoke_out),
        e AS (SELECT v.row_id, count(pt.slug) AS n, min(pt.slug) AS least_slug, min(CASE WHEN dom <> '' AND (contains(pt.slug, substr(dom, 1, 12)) OR starts_with(part, substr(dom, 1, 8))) THEN pt.slug END) AS told FROM v LEFT JOIN pt ON part = name GROUP BY v.row_id),
        h AS (SELECT DISTINCT string_split(dom, '-')[1] AS hint FROM v JOIN e USING (row_id) WHERE n = 0 AND dom <> ''), o AS (SELECT hint, min(slug) AS only_slug FROM h JOIN sl ON contains(slug, hint) WHERE hint <> '' GROUP BY hint HAVING count(*) = 1)
        SELECT row_id, CASE WHEN n = 1 THEN least_slug WHEN n > 1 THEN coalesce(told, least_slug) ELSE only_slug END AS slug, CASE WHEN n = 1 THEN 'exact' WHEN n > 1 THEN CASE WHEN told IS NOT NULL THEN 'domain' ELSE 'ambiguous_exact' END WHEN only_slug IS NOT NULL THEN 'domain' END AS method
        FROM v JOIN e USING (row_id) LEFT JOIN o ON n = 0 AND hint = string_split(dom, '-')[1]""",
    "failed_head": """WITH f AS (SELECT vendor_name, row_number() OVER (ORDER BY vendor_name NULLS LAST, listing_id) AS position FROM marin WHERE crawl_status = 'failed')
        SELECT CAST(position AS INT) AS position, vendor_name AS line FROM f WHERE position <= 12 UNION ALL SELECT 13, '... and ' || (count(*) - 12) || ' more' FROM f HAVING count(*) > 12""",
    "skip_reasons": f"SELECT CASE WHEN m.listing_id IS NULL THEN 'unknown_listing' WHEN {_MISS.format('website_url')} THEN 'no_site' WHEN crawl_status = 'failed' THEN 'failed_before' ELSE 'eligible' END AS reason, count(*) AS n FROM enrichment_jobs j LEFT JOIN marin m ON j.listing_id = m.listing_id GROUP BY 1",
    "rows_to_process": f"SELECT row_id FROM san_diego WHERE {_MISS.format('website_url')} ORDER BY row_id LIMIT 100",
    "crawl_outcome": rf"""WITH o AS (SELECT listing_id, address, CASE WHEN website_url IS NULL OR {_W.format('website_url')} = '' OR regexp_matches({_W.format('website_url')}, '\s') OR NOT regexp_matches(lower({_W.format('website_url')}), '^https?://[^/?#\s]*[a-z0-9]') THEN 'no_website'
        WHEN crawl_status = 'failed' THEN 'failed' WHEN crawl_status = 'parse_error' THEN 'parse_error' ELSE 'success' END AS outcome FROM marin) SELECT listing_id, outcome, CASE WHEN outcome = 'success' THEN nullif({_W.format('address')}, '') END AS address FROM o""",
    "lookup_outcome": f"""WITH v AS (SELECT lower(trim(vendor_name, ' ')) AS k, {_HOST} AS host, row_id FROM vendors_placeid_smoke_out), c AS (SELECT k, count(*) AS n FROM v WHERE host IS NOT NULL GROUP BY k),
        b AS (SELECT k, host FROM v WHERE host IS NOT NULL AND host NOT IN ({_BL}) QUALIFY row_number() OVER (PARTITION BY k ORDER BY row_id) = 1)
        SELECT listing_id, CASE WHEN b.host IS NOT NULL THEN 'found' WHEN n > 0 THEN 'not_found_blocked' ELSE 'not_found' END AS outcome, b.host FROM (SELECT listing_id, lower(trim(vendor_name, ' ')) AS k FROM marin) m LEFT JOIN c USING (k) LEFT JOIN b USING (k)""",
    "id_assembly": f"""SELECT row_id, CASE WHEN coalesce(match_confidence IN ('high', 'medium'), false) AND NOT ({_MISS.format('google_place_id')}) THEN trim(google_place_id, ' ') ELSE '' END AS place_id,
        array_to_string(list_filter([match_confidence, match_reason], lambda x: coalesce({_W.format('x')}, '') <> ''), ' | ') AS match FROM vendors_placeid_smoke_out""",
    "cleanup_pass": f"""WITH m AS (SELECT row_id, {_COUNTY_SLUG.format('county')} AS county, {_ASCII} AS vkey, coalesce(nullif({_W.format('state')}, ''), 'CA') AS state, CASE WHEN length({_DIG}) = 11 AND {_DIG} LIKE '1%' THEN substr({_DIG}, 2, 10) ELSE {_DIG} END AS digits FROM san_diego),
        f AS (SELECT * FROM m WHERE county <> '' AND vkey <> '' QUALIFY row_number() OVER (PARTITION BY county, vkey ORDER BY row_id) = 1)
        SELECT row_id, county, vkey, state, CASE WHEN digits = '' THEN 'no_phone' WHEN length(digits) < 10 THEN 'bad_phone' ELSE '' END AS needs_review FROM f WHERE vkey NOT IN ('tbd', 'private instructor')""",
    "target_projection": "SELECT CAST(listing_id AS VARCHAR) AS listing_id, coalesce(county, '') AS county, coalesce(vendor_name, '') AS vendor_name, coalesce(phone, '') AS phone, '' AS google_place_id FROM marin",
    "url_set": f"SELECT DISTINCT {_HOST} AS host FROM (SELECT website_url FROM marin UNION ALL SELECT website_url FROM san_diego) WHERE {_HOST} IS NOT NULL",
    "evidence_check": """SELECT record_id, contains(raw_text, CASE WHEN json_valid(raw_json) THEN raw_json ->> '$.vendor_name' END) AS supported, CASE WHEN length(raw_text) > 40 THEN substr(raw_text, 1, 40) || '…' ELSE raw_text END AS excerpt FROM county_source_records WHERE raw_text IS NOT NULL""",
    "combine_jsonl": "SELECT n_nationkey, n_name, n_regionkey AS part FROM nation WHERE n_regionkey IN (0, 2)",
    "report_rows": f"""SELECT 'totals' AS section, 'rows' AS key, count(*) AS value FROM marin UNION ALL SELECT 'totals', 'no_phone', count(*) FILTER ({_MISS.format('phone')}) FROM marin UNION ALL SELECT 'totals', 'no_address', count(*) FILTER ({_MISS.format('address')}) FROM marin
        UNION ALL SELECT 'booking', coalesce(nullif({_W.format('booking_capability')}, ''), 'null'), count(*) FROM marin GROUP BY 2""",
    "overlap_bands": """WITH v AS (SELECT list_distinct(string_split(trim(regexp_replace(lower(vendor_name), '[^a-z0-9]+', ' ', 'g')), ' ')) AS a, list_distinct(string_split(trim(regexp_replace(lower(county), '[^a-z0-9]+', ' ', 'g')), ' ')) AS b FROM vendors_placeid_smoke_out WHERE county IS NOT NULL),
        o AS (SELECT 100.0 * len(list_intersect(a, b)) / greatest(len(a), len(b)) AS o FROM v) SELECT CASE WHEN o >= 80 THEN 'high' WHEN o >= 58 THEN 'medium' WHEN o >= 35 THEN 'low' ELSE 'none' END AS band, count(*) AS n FROM o GROUP BY 1""",
}
