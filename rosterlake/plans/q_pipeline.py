"""Queries over sources, segments, text statistics and the job queue."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from rosterlake.functions import contacts as C
from rosterlake.functions import scoring as S
from rosterlake.functions import structured as H
from rosterlake.functions import text as X
from rosterlake.operators import segments, textstats
from rosterlake.plans.fragments import SP as _SP, W as _W
from rosterlake.session import materialise, table, work_root
from rosterlake.sources import files, registry
from rosterlake.streaming import jobs


def line_ingest(spark, d):
    """Documents to numbered lines with name part, first e-mail and first phone."""
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(segments.numbered_lines(F.col("text"))).alias("row_index", "raw_text"))
    return rows.select("doc_id", "row_index", F.get(F.split("raw_text", " - "), F.lit(0)).alias("name_part"), F.get(C.emails(F.col("raw_text")), F.lit(0)).alias("email"))


def header_footer_lines(spark, d):
    t = F.col("raw_text")
    return table(spark, d, "county_source_records").where("raw_text IS NOT NULL").select("record_id", segments.is_header(t).alias("is_header"), segments.is_footer(t).alias("is_footer"))


def block_segments(spark, d):
    """Blocks of each source's list: header lines open them, footers are skipped.

    Lines of a source form one ordered text; a running count of headers numbers the blocks."""
    t = table(spark, d, "county_source_records").where("raw_text IS NOT NULL AND county_source_id IS NOT NULL").withColumn("line", X.strip_ws(F.col("raw_text"))).where("line <> ''")
    h = t.where(~segments.is_footer(F.col("line"))).withColumn("opens", F.length(F.regexp_extract("line", r"^(\S+ \S+ \S+)", 1)) > 20)
    b = segments.running_total(h, "county_source_id", "record_id", F.col("opens").cast("int"), "block").where("block > 0")
    return b.groupBy("county_source_id", "block").agg(F.count("*").alias("lines"), F.min("record_id").alias("first_record"), F.sum(F.length("line")).alias("chars"))


def greedy_chunks(spark, d):
    """Lines of each document in chunks of at most 400 characters, a line break counted as one."""
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", segments.numbered_lines(F.col("text")).alias("lines")).where("size(lines) > 0")
    return segments.chunk_sizes(t, "doc_id", "lines", 400, 1)


def top_ngrams(spark, d):
    return textstats.top_ngrams(table(spark, d, "marin").where("vendor_description IS NOT NULL").select("vendor_description"), "vendor_description", (3, 4, 5), 10)


def tfidf_top(spark, d):
    """The heaviest term of each description."""
    w = textstats.tfidf(table(spark, d, "marin").where("vendor_description IS NOT NULL"), "listing_id", "vendor_description")
    return w.groupBy("id").agg(F.max(F.struct(F.round("w", 6).alias("w"), "term")).alias("b"), F.count("*").alias("n_terms")).select("id", F.col("b.w").alias("w"), "n_terms")


def centroid_terms(spark, d):
    m = table(spark, d, "marin").where("vendor_description IS NOT NULL")
    return textstats.centroid(textstats.tfidf(m, "listing_id", "vendor_description"), m).select("term", F.round("w", 6).alias("w"))


def nearest_neighbor(spark, d):
    """Every listing whose id is divisible by 50 against all: similarity of the nearest description."""
    m = table(spark, d, "marin").where("vendor_description IS NOT NULL AND vendor_description <> ''")
    w = materialise(textstats.tfidf(m, "listing_id", "vendor_description"), "tfidf")
    out = textstats.nearest(w, m.where("listing_id % 50 = 0").select(F.col("listing_id").alias("id")))
    return out.select("id", F.round("similarity", 5).alias("similarity"))


def opening_clusters(spark, d):
    m = table(spark, d, "marin").where("vendor_description IS NOT NULL").withColumn("opening", X.opening_key(F.col("vendor_description")))
    c = textstats.clusters_by_frequency(m, "opening")
    return c.select("opening", "size", F.col("cluster_id").cast("long").alias("cluster_id"))


def uniqueness_audit(spark, d):
    """Scores 1 to 5 of descriptions from opening cluster, centroid distance, nearest similarity and sentence count, counted."""
    return textstats.uniqueness(table(spark, d, "marin"), "listing_id", "vendor_description").groupBy("score").agg(F.count("*").alias("n"))


def json_fields(spark, d):
    """Fields of JSON lines whatever their key order; unreadable ones give nulls."""
    r = table(spark, d, "county_source_records").select("record_id", F.try_parse_json("raw_json").alias("v"))
    return r.select("record_id", *[F.try_variant_get("v", f"$.{k}", "string").alias(k) for k in ("vendor_name", "phone", "email", "county")])


def lenient_json(spark, d):
    """Responses around the records' JSON (fenced, padded, wrapped in an object) read back to records."""
    r = table(spark, d, "county_source_records").where("raw_json IS NOT NULL").select("record_id", "raw_json")
    k = F.col("record_id") % 4
    text = F.when(k == 0, F.concat(F.lit("```json\n"), "raw_json", F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here it is: "), "raw_json", F.lit(" done"))) \
        .when(k == 2, F.concat(F.lit('{"vendors": ['), "raw_json", F.lit("]}"))).otherwise(F.col("raw_json"))
    out = registry.records_of(r.select("record_id", text.alias("raw_text")))
    return out.select("record_id", "rec.vendor_name", "rec.phone", "rec.county")


def event_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k")).groupBy((F.col("k") % 10).alias("k_mod")).agg(F.count("*").alias("n"))


def html_lines(spark, d):
    """Texts wrapped as pages with furniture; parsed back to their visible text."""
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.collapse_ws(F.regexp_replace("text", r"[<>&]", " ")).alias("plain"))
    page = F.concat(F.lit("<html><head><style>p{}</style></head><body><nav>Home</nav><p>"), "plain", F.lit("</p><script>x=1</script><footer>End</footer></body></html>"))
    return t.select("doc_id", H.html_text_udf(page).alias("text"))


def csv_roundtrip(spark, d):
    path = f"{work_root(spark)}/csv-{id(spark)}-nation"
    cols = ["n_nationkey", "n_name", "n_regionkey", "extra"]
    files.write_csv(table(spark, d, "nation"), path, cols)
    return files.read_csv(spark, path, cols, strict=True)


def jsonl_roundtrip(spark, d):
    path = f"{work_root(spark)}/jsonl-{id(spark)}-region"
    files.write_jsonl(table(spark, d, "region"), path)
    return files.read_jsonl(spark, path, T.StructType([T.StructField("r_regionkey", T.LongType()), T.StructField("r_name", T.StringType())]))


def registry_totals(spark, d):
    """Records per county of the fixed list, counties without records included, and the grand total."""
    c = table(spark, d, "counties").select("county_id", "slug")
    n = table(spark, d, "county_source_records").where("county_id IS NOT NULL").groupBy("county_id").agg(F.count("*").alias("n"))
    return c.join(n, "county_id", "left").rollup("slug").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))


def source_dispatch(spark, d):
    """Text pages through the source registry: lines per document."""
    pages = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("slug"), F.col("text").alias("content"))
    return registry.lines_of(pages, "text").groupBy("slug").agg(F.count("*").alias("lines"))


def enqueue_jobs(spark, d):
    m = table(spark, d, "marin").where("website_url IS NOT NULL AND crawl_status = 'pending'").select("listing_id")
    return jobs.enqueue(m, table(spark, d, "enrichment_jobs").where("listing_id IS NOT NULL"), ["listing_id"])


def claim_oldest(spark, d):
    return jobs.claim_oldest(table(spark, d, "enrichment_jobs"), 25).select("job_id", "attempts", "status")


def resume_anti_join(spark, d):
    j = table(spark, d, "enrichment_jobs")
    return jobs.remaining(j.where("listing_id IS NOT NULL").select("listing_id").distinct(), j.where("status = 'completed' AND listing_id IS NOT NULL"), "listing_id")


def fingerprint_memo(spark, d):
    """How many rows share each lookup fingerprint of name and city: calls saved by memoisation."""
    v = table(spark, d, "vendors_placeid_smoke_out")
    empty = spark.createDataFrame([], "fingerprint string, result string")
    rows, _ = jobs.memoised(v.select("row_id", "vendor_name", "city"), ["vendor_name", "city"], empty)
    return rows.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))


def review_open_dedupe(spark, d):
    j = table(spark, d, "enrichment_jobs")
    items = j.where("status = 'failed' AND listing_id IS NOT NULL AND error_summary IS NOT NULL").select("listing_id", "error_summary", "job_id")
    opened = j.where("status = 'queued' AND error_summary IS NOT NULL AND listing_id IS NOT NULL").select("listing_id", "error_summary")
    return jobs.open_once(items, ["listing_id", "error_summary"], "job_id", opened)


def stream_latest(spark, d):
    """Latest value per user and type of the event stream, by micro-batches over the file."""
    root = f"{work_root(spark)}/stream-{uuid.uuid4().hex}"
    src = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    state = f"{root}/state"

    def step(batch, n):
        jobs.latest_state(batch.select("user_id", "event_id", "event_type", "value"), "user_id", "event_id").write.mode("append").parquet(state)

    jobs.run_stream(src, step, f"{root}/checkpoint")
    return jobs.latest_state(spark.read.parquet(state), "user_id", "event_id")


def job_transitions(spark, d):
    """Every job after its run: completed, queued again while attempts are left, or failed; and whether its
    claim was released."""
    j = table(spark, d, "enrichment_jobs")
    return jobs.settle(j, F.col("error_summary")).select("job_id", "status", F.col("released"))


def retryable_errors(spark, d):
    """Error texts of jobs, whether they may pass, and how often they occur."""
    j = table(spark, d, "enrichment_jobs").where("error_summary IS NOT NULL")
    return j.groupBy("error_summary").agg(F.count("*").alias("n")).select("error_summary", S.retryable(F.col("error_summary")).alias("retryable"), "n")


def county_count_delta(spark, d):
    """Distinct lines of each county against its lines: over, under or exact match, with the difference."""
    r = table(spark, d, "county_source_records").where("county_id IS NOT NULL").groupBy("county_id").agg(F.count("*").alias("lines"), F.count_distinct("raw_text").alias("distinct_lines"))
    return table(spark, d, "counties").join(r, "county_id", "left").select("slug", S.count_delta(F.coalesce("distinct_lines", F.lit(0)), F.col("lines")).alias("label"))


def priority_order(spark, d):
    """The hundred place rows to see first: those without a place id, then by rising confidence, then by id."""
    v = table(spark, d, "vendors_placeid_smoke_out")
    needs = F.coalesce(F.trim("google_place_id"), F.lit("")) == ""
    conf = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in ("none", "low", "medium", "high")]), F.lower(F.trim("match_confidence"))), F.lit(0))
    top = v.select("row_id", needs.cast("int").alias("needs"), F.when(conf == 0, 4).otherwise(conf - 1).alias("conf")).orderBy(F.desc("needs"), "conf", "row_id").limit(100)
    return top.select("row_id", F.row_number().over(W.orderBy(F.desc("needs"), "conf", "row_id")).cast("long").alias("place"))  # a hundred rows


def history_window(spark, d):
    """The last forty openings before each listing within a county, as a number of distinct ones."""
    m = table(spark, d, "san_diego").where("city IS NOT NULL").select("row_id", "city", X.listing_key(F.col("vendor_name")).alias("k"))
    w = W.partitionBy("city").orderBy("row_id").rowsBetween(-40, -1)
    return m.select("row_id", F.size(F.array_distinct(F.collect_list("k").over(w))).alias("distinct_before"))


def top_distinct_candidates(spark, d):
    """Up to five distinct candidate ids of a place row, with their position."""
    v = table(spark, d, "vendors_placeid_smoke_out").where("raw_candidate_place_ids IS NOT NULL")
    return v.select("row_id", F.posexplode(S.candidate_ids(F.col("raw_candidate_place_ids"))).alias("pos", "candidate"))


def search_query_text(spark, d):
    """Query text of a lookup from the parts at hand, URL-encoded."""
    v = table(spark, d, "vendors_placeid_smoke_out")
    q = X.join_nonblank([F.col("vendor_name"), F.col("city"), F.lit("CA")], " ")
    return v.select("row_id", F.replace(F.url_encode(q), F.lit("+"), F.lit("%20")).alias("q"))


def score_bands(spark, d):
    """Scores recorded in match reasons, banded."""
    s = F.regexp_extract("match_reason", r"score=([0-9]+)", 1).try_cast("int")
    return table(spark, d, "vendors_placeid_smoke_out").select(S.band(s, [(80, "high"), (58, "medium"), (35, "low")], "none").alias("band")).groupBy("band").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    line_ingest, header_footer_lines, block_segments, greedy_chunks, top_ngrams, tfidf_top, centroid_terms, nearest_neighbor, opening_clusters, uniqueness_audit, json_fields, lenient_json, event_props,
    html_lines, csv_roundtrip, jsonl_roundtrip, registry_totals, source_dispatch, enqueue_jobs, claim_oldest, resume_anti_join, fingerprint_memo, review_open_dedupe, stream_latest, history_window,
    top_distinct_candidates, search_query_text, score_bands, job_transitions, retryable_errors, county_count_delta, priority_order)}

_LINES = rf"list_filter(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: {_W.format('x')}), lambda x: x <> '')"
_TOK = "regexp_extract_all(lower(vendor_description), '[a-z'']+')"
def _tfidf(having: str) -> str:
    """SQL of the weights: share of the text times ln((N + 1) / (df + 1)) + 1, N the texts for which ``having``."""
    return f"""src AS (SELECT listing_id AS id, vendor_description FROM marin WHERE {having}), t AS (SELECT id, unnest({_TOK}) AS term FROM src), tc AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL),
    n AS (SELECT count(*) AS n FROM src), tt AS (SELECT id, sum(tf) AS total FROM tc GROUP BY id), dd AS (SELECT term, count(*) AS df FROM tc GROUP BY term),
    w AS (SELECT tc.id, tc.term, tf::DOUBLE / total * (ln((n.n + 1)::DOUBLE / (df + 1)) + 1) AS w FROM tc JOIN dd USING (term) JOIN tt ON tt.id = tc.id, n)"""


_NEAR = """z AS (SELECT id, count(*) AS n, sqrt(sum(w * w)) AS norm FROM w GROUP BY id),
        p AS (SELECT a.id AS a, b.id AS b, sum(a.w * b.w) AS dot, count(*) AS c FROM w a JOIN w b ON a.term = b.term AND a.id <> b.id WHERE {0} GROUP BY ALL),
        s AS (SELECT p.a, max(greatest(dot / (x.norm * y.norm), c::DOUBLE / (x.n + y.n - c))) AS similarity FROM p JOIN z x ON x.id = p.a JOIN z y ON y.id = p.b GROUP BY p.a)"""
_SENT = rf"list_filter(string_split(regexp_replace({_W.format('vendor_description')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
_OPENING = rf"""array_to_string(list_slice(string_split({_SP.format(rf"regexp_replace(lower(coalesce({_SENT}[1], '')), '\(?[0-9]{{3}}\)?[-. ]?[0-9]{{3}}[-. ]?[0-9]{{4}}', '{{phone}}', 'g')")}, ' '), 1, 6), ' ')"""
_FOOT = r"regexp_matches(lower({0}), '\bpage\b|revised|updated|disclaimer')"
SQL = {
    "top_distinct_candidates": """WITH e AS (SELECT row_id, list_filter(list_transform(string_split_regex(raw_candidate_place_ids, '[,|]'), lambda x: trim(x, ' ')), lambda x: x <> '') AS ids FROM vendors_placeid_smoke_out WHERE raw_candidate_place_ids IS NOT NULL),
        u AS (SELECT row_id, list_slice(list_filter(ids, lambda x, i: list_position(ids, x) = i), 1, 5) AS five FROM e)
        SELECT row_id, unnest(five) AS candidate, CAST(unnest(range(len(five))) AS INT) AS pos FROM u""",
    "job_transitions": """SELECT job_id, CASE WHEN status <> 'running' THEN status WHEN error_summary IS NULL THEN 'completed' WHEN coalesce(attempts, 0) < coalesce(max_attempts, 3) THEN 'queued' ELSE 'failed' END AS status,
        status = 'running' AND error_summary IS NOT NULL AND coalesce(attempts, 0) < coalesce(max_attempts, 3) AS released FROM enrichment_jobs""",
    "retryable_errors": """SELECT error_summary, regexp_matches(lower(error_summary), 'overloaded|529|rate_limit|timeout|temporarily unavailable') AS retryable, count(*) AS n FROM enrichment_jobs WHERE error_summary IS NOT NULL GROUP BY ALL""",
    "county_count_delta": """WITH f AS (SELECT county_id, count(*) AS n FROM county_source_records WHERE county_id IS NOT NULL GROUP BY 1), x AS (SELECT county_id, count(DISTINCT raw_text) AS n FROM county_source_records WHERE county_id IS NOT NULL GROUP BY 1),
        j AS (SELECT slug, coalesce(x.n, 0) - f.n AS d FROM counties LEFT JOIN f USING (county_id) LEFT JOIN x USING (county_id))
        SELECT slug, CASE WHEN d > 0 THEN 'over ' WHEN d < 0 THEN 'under ' ELSE 'exact match ' END || CASE WHEN d >= 0 THEN '+' ELSE '' END || CAST(d AS VARCHAR) AS label FROM j WHERE d IS NOT NULL
        UNION ALL SELECT slug, NULL FROM j WHERE d IS NULL""",
    "priority_order": """SELECT row_id, row_number() OVER (ORDER BY needs DESC, conf, row_id) AS place FROM (SELECT row_id, CASE WHEN google_place_id IS NULL OR trim(google_place_id, ' ') = '' THEN 1 ELSE 0 END AS needs,
        CASE lower(trim(match_confidence, ' ')) WHEN 'none' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END AS conf FROM vendors_placeid_smoke_out) QUALIFY place <= 100""",
    "line_ingest": f"""WITH l AS (SELECT doc_id, {_LINES} AS ls FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, unnest(range(len(ls))) AS row_index, unnest(ls) AS raw FROM l)
        SELECT doc_id, CAST(row_index AS INT) AS row_index, string_split(raw, ' - ')[1] AS name_part, lower(nullif(regexp_extract(raw, '{C.EMAIL}'), '')) AS email FROM x""",
    "header_footer_lines": rf"""SELECT record_id, len(string_split_regex(trim(raw_text), '\s+')) >= 3 AND length(regexp_replace(raw_text, '[^\p{{L}}]', '', 'g')) > 0 AND length(regexp_replace(raw_text, '[^\p{{Lu}}]', '', 'g')) >= 0.8 * length(regexp_replace(raw_text, '[^\p{{L}}]', '', 'g')) AS is_header,
        {_FOOT.format('raw_text')} AS is_footer FROM county_source_records WHERE raw_text IS NOT NULL""",
    "block_segments": rf"""WITH t AS (SELECT county_source_id, record_id, {_W.format('raw_text')} AS line FROM county_source_records WHERE raw_text IS NOT NULL AND county_source_id IS NOT NULL),
        h AS (SELECT *, length(regexp_extract(line, '^(\S+ \S+ \S+)', 1)) > 20 AS opens FROM t WHERE line <> '' AND NOT {_FOOT.format('line')}),
        b AS (SELECT *, sum(opens::INT) OVER (PARTITION BY county_source_id ORDER BY record_id) AS block FROM h)
        SELECT county_source_id, CAST(block AS BIGINT) AS block, count(*) AS lines, min(record_id) AS first_record, CAST(sum(length(line)) AS BIGINT) AS chars FROM b WHERE block > 0 GROUP BY ALL""",
    "greedy_chunks": f"""WITH RECURSIVE l AS (SELECT doc_id, {_LINES} AS ls FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS s FROM l),
        r AS (SELECT doc_id, i, 0 AS chunk, length(s) + 1 AS used, length(s) + 1 AS sz FROM x WHERE i = 1 UNION ALL
          SELECT x.doc_id, x.i, CASE WHEN r.used + length(x.s) + 1 > 400 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.used + length(x.s) + 1 > 400 THEN length(x.s) + 1 ELSE r.used + length(x.s) + 1 END, length(x.s) + 1 FROM r JOIN x ON x.doc_id = r.doc_id AND x.i = r.i + 1)
        SELECT doc_id, chunk, count(*) AS n_lines, CAST(sum(sz) AS BIGINT) AS chars FROM r GROUP BY doc_id, chunk""",
    "top_ngrams": f"""WITH d AS (SELECT {_TOK} AS t FROM marin WHERE vendor_description IS NOT NULL), g AS ({' UNION ALL '.join(f"SELECT {n} AS n, unnest(list_transform(range(1, greatest(len(t) - {n - 2}, 1)), lambda i: array_to_string(list_slice(t, i, i + {n - 1}), ' '))) AS gram FROM d WHERE len(t) >= {n}" for n in (3, 4, 5))}),
        c AS (SELECT n, gram, count(*) AS cnt FROM g GROUP BY ALL) SELECT n, gram, cnt, row_number() OVER (PARTITION BY n ORDER BY cnt DESC, gram) AS rnk FROM c QUALIFY rnk <= 10""",
    "tfidf_top": f"WITH {_tfidf('vendor_description IS NOT NULL')} SELECT id, round(max(w), 6) AS w, count(*) AS n_terms FROM w GROUP BY id",
    "centroid_terms": f"WITH {_tfidf('vendor_description IS NOT NULL')} SELECT term, round(sum(w) / (SELECT n FROM n), 6) AS w FROM w GROUP BY term",
    "nearest_neighbor": f"""WITH {_tfidf("vendor_description IS NOT NULL AND vendor_description <> ''")}, {_NEAR.format('a.id % 50 = 0')}
        SELECT id, round(coalesce(similarity, 0.0), 5) AS similarity FROM src LEFT JOIN s ON s.a = id WHERE id % 50 = 0""",
    "opening_clusters": rf"""WITH o AS (SELECT {_OPENING} AS opening FROM marin WHERE vendor_description IS NOT NULL),
        c AS (SELECT opening, count(*) AS size FROM o GROUP BY opening) SELECT opening, size, row_number() OVER (ORDER BY size DESC, opening) - 1 AS cluster_id FROM c""",
    "uniqueness_audit": rf"""WITH {_tfidf(_W.format('vendor_description') + " <> ''")}, {_NEAR.format('true')},
        m AS (SELECT id, {_OPENING} AS opening, greatest(len({_SENT}), 1) AS n_s, len({_TOK}) = 0 AS wordless FROM src),
        sz AS (SELECT opening, count(*) AS size FROM m GROUP BY opening), md AS (SELECT n_s AS mode FROM m GROUP BY n_s ORDER BY count(*) DESC, n_s LIMIT 1), em AS (SELECT count(*) FILTER (WHERE wordless) AS empties FROM m),
        ce AS (SELECT term, sum(w) / (SELECT n FROM n) AS m FROM w GROUP BY term), cl AS (SELECT sqrt(sum(m * m)) AS len FROM ce),
        di AS (SELECT id, 1 - sum(w * m) / (sqrt(sum(w * w)) * any_value(len)) AS distance FROM w JOIN ce USING (term), cl GROUP BY id),
        j AS (SELECT size, coalesce(distance, 1.0) AS distance, abs(n_s - mode) <= 1 AS modal, CASE WHEN wordless THEN CASE WHEN empties > 1 THEN 1.0 ELSE 0.0 END ELSE coalesce(similarity, 0.0) END AS sim
            FROM m JOIN sz USING (opening) LEFT JOIN di ON di.id = m.id LEFT JOIN s ON s.a = m.id, md, em)
        SELECT CASE WHEN size <= 2 AND distance >= 0.35 AND sim < 0.45 THEN 5 WHEN size <= 5 AND distance >= 0.25 AND sim < 0.55 THEN 4 WHEN size <= 15 AND sim < 0.65 THEN 3
            WHEN size <= 40 OR sim >= 0.72 OR modal THEN 2 ELSE 1 END AS score, count(*) AS n FROM j GROUP BY 1""",
    "json_fields": """WITH j AS (SELECT record_id, CASE WHEN json_valid(raw_json) THEN raw_json END AS r FROM county_source_records) SELECT record_id, r ->> '$.vendor_name' AS vendor_name, r ->> '$.phone' AS phone, r ->> '$.email' AS email, r ->> '$.county' AS county FROM j""",
    "lenient_json": """SELECT record_id, CASE WHEN json_valid(raw_json) THEN raw_json ->> '$.vendor_name' END AS vendor_name, CASE WHEN json_valid(raw_json) THEN raw_json ->> '$.phone' END AS phone, CASE WHEN json_valid(raw_json) THEN raw_json ->> '$.county' END AS county FROM county_source_records WHERE raw_json IS NOT NULL""",
    "event_props": "SELECT CAST(props ->> '$.k' AS INT) % 10 AS k_mod, count(*) AS n FROM events GROUP BY 1",
    "csv_roundtrip": "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey, '' AS extra FROM nation",
    "jsonl_roundtrip": "SELECT r_regionkey, r_name FROM region",
    "registry_totals": "SELECT slug, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n FROM counties LEFT JOIN (SELECT county_id, count(*) AS n FROM county_source_records WHERE county_id IS NOT NULL GROUP BY 1) USING (county_id) GROUP BY ROLLUP (slug)",
    "source_dispatch": f"SELECT CAST(doc_id AS VARCHAR) AS slug, CAST(len({_LINES}) AS BIGINT) AS lines FROM documents WHERE text IS NOT NULL AND len({_LINES}) > 0",
    "enqueue_jobs": "SELECT DISTINCT listing_id FROM marin WHERE website_url IS NOT NULL AND crawl_status = 'pending' AND listing_id NOT IN (SELECT listing_id FROM enrichment_jobs WHERE listing_id IS NOT NULL)",
    "claim_oldest": "SELECT job_id, coalesce(attempts, 0) + 1 AS attempts, 'running' AS status FROM enrichment_jobs WHERE status = 'queued' ORDER BY created_at NULLS LAST, job_id LIMIT 25",
    "resume_anti_join": "SELECT DISTINCT listing_id FROM enrichment_jobs WHERE listing_id IS NOT NULL AND listing_id NOT IN (SELECT listing_id FROM enrichment_jobs WHERE status = 'completed' AND listing_id IS NOT NULL)",
    "fingerprint_memo": "SELECT sha256(coalesce(lower(trim(vendor_name, ' ')), '') || '|' || coalesce(lower(trim(city, ' ')), '')) AS fingerprint, count(*) AS n, min(row_id) AS first_row FROM vendors_placeid_smoke_out GROUP BY 1",
    "review_open_dedupe": """SELECT listing_id, error_summary, job_id FROM enrichment_jobs e WHERE status = 'failed' AND listing_id IS NOT NULL AND error_summary <> '' AND NOT EXISTS (SELECT 1 FROM enrichment_jobs q WHERE q.status = 'queued' AND q.listing_id = e.listing_id AND q.error_summary = e.error_summary)
        QUALIFY row_number() OVER (PARTITION BY listing_id, error_summary ORDER BY job_id) = 1""",
    "stream_latest": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "history_window": "SELECT row_id, len(list_distinct(coalesce(list(k) OVER (PARTITION BY city ORDER BY row_id ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING), []))) AS distinct_before FROM (SELECT row_id, city, lower(trim(vendor_name, ' ')) AS k FROM san_diego WHERE city IS NOT NULL)",
    "score_bands": "WITH s AS (SELECT TRY_CAST(regexp_extract(match_reason, 'score=([0-9]+)', 1) AS INT) AS s FROM vendors_placeid_smoke_out) SELECT CASE WHEN s >= 80 THEN 'high' WHEN s >= 58 THEN 'medium' WHEN s >= 35 THEN 'low' ELSE 'none' END AS band, count(*) AS n FROM s GROUP BY 1",
    "html_lines": r"SELECT doc_id, trim(regexp_replace(text, '[<>&\s\x{A0}\x{85}\x{2000}-\x{200A}\x{3000}]+', ' ', 'g')) AS text FROM documents WHERE text IS NOT NULL",
}
