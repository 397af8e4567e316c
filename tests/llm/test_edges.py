"""Every query on empty tables and on hostile rows: nulls everywhere, blanks, long texts, repeats, extra columns."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from tables import write  # noqa: E402

from rosterlake.llm.queries import queries  # noqa: E402

NAMES = sorted(queries())
LONG = "word " * 20_000 + "a" * 50_000 + " 123 Main Street, Elmmont, CA 93012"
CLASH = "id a b key n node root count value name src rec l r x kept_id first_id item pos t i v city_ text_"


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), {"containers": [{"container_kind": "short", "capacity_tokens": 8}]})


@pytest.fixture(scope="module")
def hostile(spark, tmp_path_factory):
    texts = [None, "", "   ", LONG, "Ünïcode 🎯 text", "same row", "same row", "TBD", "\x00odd", "(((", '"";;||', "1 2 3", "Café, S.  — x"]
    every = ["county", "vendor_name", "instructor_names", "email", "phone", "website_url", "city", "address", "price_16hr_full", "vendor_description", "crawl_status", "enrichment_confidence",
             "instructor_image_paths", "source_url", "google_place_id"]
    rows = [{"listing_id": i, "row_id": i, "doc_id": i, "text": t, **{c: t for c in every}} for i, t in enumerate(texts, 1)]
    tables = {k: rows for k in ("marin", "san_diego", "vendors_placeid_smoke_out", "documents")}
    return write(spark, tmp_path_factory.mktemp("hostile"), tables | {"containers": [{"container_kind": "short", "capacity_tokens": 512}, {"container_kind": "tiny", "capacity_tokens": 1}]}, CLASH)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_no_rows(spark, empty, name):
    assert queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_hostile_rows_do_not_crash(spark, hostile, name):
    out = queries()[name](spark, hostile).collect()
    assert len(out) == len({str(r) for r in out}), "rows are distinct"
    if name == "p8_ids":
        by = {r.doc_id: r.ids for r in out}
        assert len(by) == 13 and by[1] == [] and by[2] == [] and by[6] == by[7] and len(by[4]) > 20_000
    if name == "p7_found":  # null, blank and word-less values are no copies; repeats are
        assert {(r.kept_id, r.copy_id) for r in out} == {(6, 7)}
    if name == "p9_packed":
        used: dict = {}
        for r in out:
            k = (r.container_kind, r.container_id)
            used[k] = used.get(k, 0) + r.piece_tokens
        assert all(v <= (512 if k == "short" else 1) for (k, _), v in used.items())
        assert {r.doc_id for r in out if r.container_kind == "short"} == set(range(1, 14))
