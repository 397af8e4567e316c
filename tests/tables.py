"""Small tables for tests: schemas of the test tables and a writer."""

from __future__ import annotations

STRINGS = lambda names: ", ".join(f"{n} string" for n in names.split())
SCHEMAS = {
    "marin": "listing_id bigint, " + STRINGS("county vendor_name instructor_names email phone website_url booking_capability city state address price_16hr_day1 price_16hr_day2 price_16hr_full price_8hr_renewal price_8hr_initial price_add_a_gun vendor_description crawl_status enrichment_confidence confidence_notes logo_path instructor_image_paths training_image_paths") + ", enriched_at timestamp_ntz",
    "san_diego": "row_id bigint, " + STRINGS("county vendor_name instructor_names website_url phone email city state source_url source_type"),
    "vendors_placeid_smoke_out": "row_id bigint, " + STRINGS("county needs_review vendor_name instructor_names email phone website_url booking_capability city state address google_place_id match_confidence match_reason raw_candidate_place_ids"),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, source_type string, county string, fetched_at timestamp_ntz",
    "containers": "container_kind string, capacity_tokens int",
}


def write(spark, root, data: dict[str, list[dict]], extra: str = "") -> str:
    """Write every table of SCHEMAS below ``root`` (absent ones empty); ``extra`` adds columns to all."""
    from pyspark.sql.types import _parse_datatype_string

    for name, ddl in SCHEMAS.items():
        schema = _parse_datatype_string(ddl)
        rows = [tuple(r.get(f.name) for f in schema) for r in data.get(name, [])]
        df = spark.createDataFrame(rows, schema)
        for i, c in enumerate(x for x in extra.split() if x not in df.columns):
            df = df.selectExpr("*", f"'{i}' AS {c}")
        df.coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}.parquet")
    return str(root)
