"""Queries over the text, contact and place functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlake.functions import contacts as C
from rosterlake.functions import places as P
from rosterlake.functions import text as X
from rosterlake.plans.fragments import COUNTY_SLUG as _COUNTY_SLUG, SLUG as _SLUG, SP as _SP, W as _W
from rosterlake.session import table


def name_keys(spark, d):
    v = F.col("vendor_name")
    return table(spark, d, "marin").select(
        "listing_id", X.name_key_ascii(v).alias("ascii_key"), X.name_key_unicode(v).alias("unicode_key"), X.listing_key(v).alias("listing_key"),
        X.merge_key_soft(v).alias("soft_key"), X.merge_key_hard(v).alias("hard_key"))


def nfkd_keys(spark, d):
    return table(spark, d, "san_diego").select("row_id", X.nfkd_key_udf("instructor_names").alias("nfkd_key"))


def slugs(spark, d):
    s = X.slugify(F.col("vendor_name"))
    return table(spark, d, "san_diego").select("row_id", s.alias("slug"), X.drop_last_slug_part(s).alias("short_slug"))


def blank_to_null(spark, d):
    cols = ["email", "phone", "address", "price_16hr_full", "vendor_description"]
    return table(spark, d, "marin").select("listing_id", *[X.blank_to_null(F.col(c)).alias(c) for c in cols])


def blank_flags(spark, d):
    return table(spark, d, "marin").select("listing_id", X.is_missing(F.col("address")).alias("no_address"), X.is_missing(F.col("phone")).alias("no_phone"))


def email_extract(spark, d):
    e = F.explode(C.emails(F.col("text")))
    return table(spark, d, "documents").select("doc_id", e.alias("email"))


def phone_extract(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(C.phones(F.col("text"))).alias("phone"))


def phone_normalise(spark, d):
    p = F.col("phone")
    return table(spark, d, "marin").select("listing_id", C.nanp(p).alias("nanp"), C.phone_digits(p).alias("digits"), C.phone_well_formed(C.nanp(p)).alias("ok"))


def website_canonical(spark, d):
    u = F.col("website_url")
    return table(spark, d, "marin").select("listing_id", C.website(u).alias("website"), C.host(u).alias("host"), C.index_url(u).alias("index_url"), C.url_problem(u).alias("problem"))


def host_rollup(spark, d):
    t = table(spark, d, "marin").select(C.host(F.col("website_url")).alias("host"), "listing_id").where("host IS NOT NULL")
    return t.groupBy("host").agg(F.count("*").alias("listings"), F.min("listing_id").alias("first_listing"))


# Domains that are directories, not a business's own site.
BLOCKED = ("facepages.example", "rangebook.example", "classfinder.example")


def blocklist_hosts(spark, d):
    t = table(spark, d, "marin").select("listing_id", C.host(F.col("website_url")).alias("host"))
    blocked = spark.createDataFrame([(b,) for b in BLOCKED], "suffix string")
    hits = t.where("host IS NOT NULL").select("listing_id", F.explode(C.host_suffixes(F.col("host"))).alias("suffix")).join(F.broadcast(blocked), "suffix")  # a fixed list
    gone = hits.select("listing_id").distinct()
    return t.where("host IS NOT NULL AND NOT host LIKE '%.gov'").join(gone, "listing_id", "left_anti")


def private_addresses(spark, d):
    ip = F.concat_ws(".", F.pmod("event_id", F.lit(256)), F.pmod("user_id", F.lit(256)), F.pmod(F.col("event_id") * 7, F.lit(256)), F.pmod("event_id", F.lit(300)))
    return table(spark, d, "events").select("event_id", C.is_private_ipv4(ip.cast("string")).alias("is_private"))


def private_addresses_six(spark, d):
    """Event ids written as IPv6 addresses, some of them mapped IPv4 ones; private or not."""
    k, h = F.pmod("event_id", F.lit(7)), F.lower(F.hex(F.pmod(F.col("event_id") * 7919, F.lit(65536))))
    four = F.concat_ws(".", F.pmod("user_id", F.lit(256)), F.pmod("event_id", F.lit(256)), F.lit("0"), F.lit("9"))
    ip = F.when(k == 0, F.concat(F.lit("::ffff:"), four)).when(k == 1, F.lit("::1")).when(k == 2, F.lit("not one")).otherwise(F.concat(h, F.lit("::"), F.lower(F.hex(k))))
    return table(spark, d, "events").select("event_id", C.is_private_address(ip).alias("is_private"))


def text_shape(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where("text IS NOT NULL").select(
        "doc_id", F.size(X.tokens(t)).alias("n_tokens"), F.size(X.sentences(t)).alias("n_sentences"))


def opening_words(spark, d):
    t = F.col("vendor_description")
    return table(spark, d, "marin").where("vendor_description IS NOT NULL").select("listing_id", X.opening_words(t).alias("opening"))


def joined_location(spark, d):
    parts = [F.col("city"), F.col("state")]
    return table(spark, d, "marin").select("listing_id", X.join_nonblank(parts).alias("location"), F.replace("county", F.lit("-"), F.lit(" ")).alias("county_label"))


def rebased_paths(spark, d):
    return table(spark, d, "marin").select("listing_id", X.rebase_paths(F.col("training_image_paths"), "images/").alias("paths"))


def phrase_prevalence(spark, d):
    phrases = ("carry courses", "permit classes", "weekend", "live fire", "small groups")
    t = table(spark, d, "marin").where("vendor_description IS NOT NULL")
    one = t.agg(*[F.sum(X.occurrences(F.col("vendor_description"), p)).alias(f"p{i}") for i, p in enumerate(phrases)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(p).alias("phrase"), F.col(f"p{i}").alias("n")) for i, p in enumerate(phrases)])).alias("x")).select("x.*")


def city_clean(spark, d):
    return table(spark, d, "vendors_placeid_smoke_out").select("row_id", P.clean_city(F.col("city"), X.county_slug(F.col("county"))).alias("city"))


def city_from_address(spark, d):
    return table(spark, d, "vendors_placeid_smoke_out").select("row_id", P.city_from_address(F.col("address")).alias("city"), P.is_city_only(F.col("address")).alias("city_only"))


QUERIES = {f.__name__: f for f in (name_keys, nfkd_keys, slugs, blank_to_null, blank_flags, email_extract, phone_extract, phone_normalise, website_canonical, host_rollup,
                                   blocklist_hosts, private_addresses, private_addresses_six, text_shape, opening_words, joined_location, rebased_paths, phrase_prevalence, city_clean, city_from_address)}

_BARE = r"regexp_replace(lower(regexp_replace(website_url, '^\s+|\s+$', '', 'g')), '^[a-z][a-z0-9+.-]*://', '')"
_HOST = rf"regexp_replace(regexp_replace(regexp_replace(regexp_extract({_BARE}, '^([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '^www\.', '')"


def _phone_sql() -> str:
    """The SQL of ``contacts.nanp`` and its check."""
    dash = lambda x: f"substr({x}, 1, 3) || '-' || substr({x}, 4, 3) || '-' || substr({x}, 7, 4)"
    one = "[2-9][0-9]{2}[2-9][0-9]{6}"
    return rf"""WITH a AS (SELECT listing_id, phone, {_W.format('phone')} AS t FROM marin),
        b AS (SELECT *, regexp_extract(t, '{C.EXTENSION}', 1) AS ext, {_W.format(f"regexp_replace(t, '{C.EXTENSION}', '')")} AS body FROM a),
        e AS (SELECT *, list_transform(regexp_extract_all(body, '{C.NANP}'), lambda x: right(regexp_replace(x, '[^0-9]', '', 'g'), 10)) AS found, regexp_replace(body, '[^0-9]', '', 'g') AS d0, regexp_replace(phone, '[^0-9]', '', 'g') AS p0 FROM b),
        f AS (SELECT *, CASE WHEN length(d0) = 11 AND d0 LIKE '1%' THEN substr(d0, 2, 10) ELSE d0 END AS d FROM e),
        g AS (SELECT *, CASE WHEN len(found) > 0 AND NOT regexp_matches(body, '^{one}{one}$') THEN array_to_string(list_transform(found, lambda x: {dash('x')}), ' / ') WHEN regexp_matches(d, '^{one}{one}$') THEN {dash('d')} || ' / ' || {dash('substr(d, 11, 10)')} WHEN regexp_matches(d, '^{one}$') THEN {dash('d')} END AS main FROM f),
        h AS (SELECT listing_id, CASE WHEN main IS NULL THEN t WHEN ext <> '' THEN main || ' ext. ' || ext ELSE main END AS nanp, CASE WHEN length(p0) = 11 AND p0 LIKE '1%' THEN substr(p0, 2, 10) ELSE p0 END AS digits FROM g)
        SELECT *, len(list_filter(list_transform(string_split({_W.format(r"regexp_replace(nanp, '(?i)\s+ext\.\s*[0-9]{1,8}\s*$', '')")}, ' / '), lambda x: {_W.format('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '^[2-9][0-9]{{2}}-[0-9]{{3}}-[0-9]{{4}}$'))) = 0 AS ok FROM h"""


SQL = {
    "name_keys": rf"""SELECT listing_id, {_SP.format("regexp_replace(lower(" + _W.format("vendor_name") + r"), '[^A-Za-z0-9_\s]', '', 'g')")} AS ascii_key,
        {_SP.format("regexp_replace(lower(" + _W.format("vendor_name") + r"), '[^\p{L}\p{N}_\s]', '', 'g')")} AS unicode_key, lower(trim(vendor_name, ' ')) AS listing_key,
        {_SP.format("regexp_replace(lower(" + _W.format("vendor_name") + r"), '[.,]+', ' ', 'g')")} AS soft_key, trim(regexp_replace(lower(vendor_name), '[^a-z0-9]+', ' ', 'g')) AS hard_key FROM marin""",
    "phone_normalise": _phone_sql(),
    "city_clean": rf"""WITH v AS (SELECT row_id, {_W.format('city')} AS t, replace({_COUNTY_SLUG.format('county')}, '-', ' ') AS name FROM vendors_placeid_smoke_out),
        p AS (SELECT *, list_filter(list_transform(string_split_regex(t, '[/,]'), lambda x: {_W.format('x')}), lambda x: x <> '' AND lower(x) <> 'online' AND NOT regexp_matches(lower(x), '^[a-z]{{2}}$') AND NOT regexp_matches(lower(x), '\sco\.?$')
            AND NOT regexp_matches(lower(x), 'county|counties') AND NOT regexp_matches(x, '{P.VENUE}')) AS raw FROM v),
        c AS (SELECT *, list_transform(raw, lambda x: regexp_replace(x, '\s+(?:{'|'.join(P.STATES)})$', '')) AS parts FROM p)
        SELECT row_id, CASE WHEN NOT (lower(t) IN ({', '.join("'" + x + "'" for x in P.NO_CITY)}) OR regexp_matches(lower(t), 'county|counties')) THEN coalesce(list_filter(parts, lambda x: contains(lower(x), name) OR contains(name, lower(x)))[1], parts[1]) END AS city FROM c""",
    "slugs": rf"""WITH s AS (SELECT row_id, {_SLUG.format('vendor_name')} AS slug FROM san_diego)
        SELECT row_id, slug, regexp_replace(slug, '-[^-]*$', '') AS short_slug FROM s""",
    "blank_to_null": "SELECT listing_id, " + ", ".join(f"nullif({_W.format(c)}, '') AS {c}" for c in ("email", "phone", "address", "price_16hr_full", "vendor_description")) + " FROM marin",
    "blank_flags": f"""SELECT listing_id, coalesce(lower({_W.format('address')}), '') IN ('', 'null', 'none', 'nan') AS no_address,
        coalesce(lower({_W.format('phone')}), '') IN ('', 'null', 'none', 'nan') AS no_phone FROM marin""",
    "email_extract": rf"""SELECT DISTINCT doc_id, lower(e) AS email FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{C.EMAIL}')) AS e FROM documents)""",
    "phone_extract": rf"""SELECT DISTINCT doc_id, trim(p) AS phone FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{C.PHONE}')) AS p FROM documents)""",
    "host_rollup": f"""SELECT h AS host, count(*) AS listings, min(listing_id) AS first_listing FROM (SELECT listing_id, {_HOST} AS h FROM marin) WHERE h <> '' GROUP BY h""",
    "blocklist_hosts": f"""SELECT listing_id, h AS host FROM (SELECT listing_id, {_HOST} AS h FROM marin) WHERE h <> '' AND h NOT LIKE '%.gov'
        AND NOT ({' OR '.join(f"h = '{b}' OR h LIKE '%.{b}'" for b in BLOCKED)})""",
    "private_addresses": """WITH p AS (SELECT event_id, event_id % 256 AS a, user_id % 256 AS b, event_id % 300 AS dd FROM events)
        SELECT event_id, CASE WHEN dd <= 255 THEN a IN (0, 10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127) END AS is_private FROM p""",
    "private_addresses_six": """WITH p AS (SELECT event_id, event_id % 7 AS k, lower(to_hex(event_id * 7919 % 65536)) AS h, user_id % 256 AS a, event_id % 256 AS b FROM events)
        SELECT event_id, CASE k WHEN 0 THEN a IN (0, 10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127) WHEN 1 THEN true WHEN 2 THEN NULL
            ELSE regexp_matches(h, '^f[cd]') OR h = 'fe80' END AS is_private FROM p""",
    "text_shape": rf"""SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z'']+')) AS n_tokens,
        len(list_filter(string_split(regexp_replace({_W.format('text')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')) AS n_sentences FROM documents WHERE text IS NOT NULL""",
    "opening_words": rf"""WITH f AS (SELECT listing_id, coalesce(list_filter(string_split(regexp_replace({_W.format('vendor_description')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')[1], '') AS s
        FROM marin WHERE vendor_description IS NOT NULL) SELECT listing_id, array_to_string(list_slice(string_split({_SP.format('lower(s)')}, ' '), 1, 8), ' ') AS opening FROM f""",
    "joined_location": f"""SELECT listing_id, array_to_string(list_filter([city, state], lambda x: coalesce({_W.format('x')}, '') <> ''), ', ') AS location, replace(county, '-', ' ') AS county_label FROM marin""",
    "rebased_paths": rf"""SELECT listing_id, array_to_string(list_transform(list_filter(list_transform(string_split(training_image_paths, '|'), lambda p: regexp_replace({_W.format('p')}, '^/+', '')), lambda p: p <> ''), lambda p: 'images/' || p), '|') AS paths FROM marin""",
    "phrase_prevalence": " UNION ALL ".join(
        f"SELECT '{p}' AS phrase, CAST(sum((length(lower(vendor_description)) - length(replace(lower(vendor_description), '{p}', ''))) // {len(p)}) AS BIGINT) AS n FROM marin"
        for p in ("carry courses", "permit classes", "weekend", "live fire", "small groups")),
}
