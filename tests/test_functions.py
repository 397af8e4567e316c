"""Unit tables for functions; expected values are derived by hand."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from rosterlake.functions import contacts as C
from rosterlake.functions import places as P
from rosterlake.functions import scoring as S
from rosterlake.functions import structured as H
from rosterlake.functions import text as X
from rosterlake.operators import dedupe, match, merge, packed, quality, report, segments
from rosterlake.sources import files, registry
from rosterlake.streaming import jobs


def col(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_keys(spark):
    assert col(spark, X.name_key_ascii, ["  Café — Bar's, LLC ", None, ""]) == ["caf bars llc", None, ""]
    assert col(spark, X.name_key_unicode, ["  Café — Bar's "]) == ["café bars"]
    assert col(spark, X.nfkd_key_udf, ["façade", None]) == ["fac ade", None]
    assert col(spark, X.slugify, ["  A & B -- c "]) == ["a-b-c"]
    assert col(spark, X.blank_to_null, ["\t a \n", " \n"]) == ["a", None]


@pytest.mark.parametrize("fn,value,want", [
    (C.emails, "A@x.com, b@y.org a@X.com", ["a@x.com", "b@y.org"]), (C.phones, "(415) 555-0100 or 415.555.0101", ["(415) 555-0100", "415.555.0101"]), (C.phone_digits, "1-415-555-0100", "4155550100"),
    (C.nanp, "(415)555-0100 / 415 555 0101", "415-555-0100 / 415-555-0101"), (C.nanp, "4155550100 ext. 7", "415-555-0100 ext. 7"), (C.nanp, "14155550100", "415-555-0100"),
    (C.nanp, "41555501004155550101", "415-555-0100 / 415-555-0101"), (C.nanp, "call us", "call us"), (C.website, "HTTP://Www.A.com/b/?q=1#f", "https://www.a.com/b?q=1#f"),
    (C.host, "https://user@www.A.com:80/x", "a.com"), (C.url_problem, "ftp://x.y", "scheme"), (C.url_problem, "https://x y", "spaces"), (C.url_problem, "https://x.y", None), (C.is_private_ipv4, "192.168.1.1", True),
    (C.is_private_ipv4, "8.8.8.8", False), (C.is_private_ipv4, "300.1.1.1", None), (P.city_from_address, "1 A St, Elmmont, CA 93012", "Elmmont"), (P.is_city_only, "Elmmont, CA", True),
    (P.clean_city, "Online / New Norford, CA", "New Norford"), (P.clean_city, "Marin County", None), (S.leading_number, "85%", 85.0), (S.leading_number, "x", None),
    (lambda c: X.occurrences(c, "aa"), "aaAAa", 2), (X.paragraph_count, "A. B. C. D.", 2), (X.opening_key, "Call 415-555-0100 now please do it all. B.", "call {phone} now please do it"),
])
def test_scalars(spark, fn, value, want):
    assert col(spark, fn, [value])[0] == want
    col(spark, fn, [None, ""])  # defined for null and blank


def test_json_and_pages(spark):
    rows = ["```json\n[{\"vendor_name\": \"a\"}]\n```", "Sure: {\"vendors\": [{\"vendor_name\": \"b\"}, {\"vendor_name\": \"c\"}]} bye", "{\"vendor_name\": \"d\"}", "no json", None]
    out = registry.records_of(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw_text string")).select("i", "rec.vendor_name", "parse_error").orderBy("i", "vendor_name").collect()
    assert [(r.i, r.vendor_name, r.parse_error) for r in out] == [(0, "a", False), (1, "b", False), (1, "c", False), (2, "d", False), (3, None, True), (4, None, True)]
    html = "<body><nav>n</nav><p>Hi <b>you</b></p><table><tr><td>a</td><td>b</td></tr></table><a href='/about'>About</a><a href='https://o.example/about'>x</a><img src='logo.png'><img src='a/team1.jpg'><img src='x.svg'></body>"
    df = spark.createDataFrame([(html, "https://s.example/x/", "about|course")], "h string, b string, k string")
    r = df.select(H.html_text_udf("h").alias("t"), H.html_lines_udf("h").alias("l"), H.page_links_udf("h", "b", "k").alias("a"), H.page_images_udf("h").alias("i")).first()
    assert "Hi you" in r.t and "n " not in r.t and r.l == "a | b" and r.a == ["https://s.example/about"] and [(x.src, x.kind) for x in r.i] == [("logo.png", "logo"), ("a/team1.jpg", "instructor")]
    png = b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + struct.pack(">II", 40, 30)
    assert tuple(spark.createDataFrame([(bytearray(png),)], "b binary").select(H.image_size_udf("b").alias("s")).first().s) == (40, 30)


def test_survivors_and_merges(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "yy"), (3, "", "z"), (4, None, "z"), (5, "b", None)], "seq int, k string, t string")
    assert {(r.seq, r.k) for r in dedupe.first_seen(df, ["k"], "seq").collect()} == {(1, "a"), (5, "b")}
    assert {(r.k, r.seq, r.first_pos) for r in dedupe.last_wins(df.where("k <> ''"), ["k"], "seq").collect()} == {("a", 2, 1), ("b", 5, 5)}
    master = spark.createDataFrame([("a", "old"), ("c", "keep")], "k string, t string")
    out = merge.replace_merge(master, df.select("seq", "k", "t"), "k", "seq").collect()
    assert {(r.k, r.t, r.replaced) for r in out} == {("a", "yy", True), ("c", "keep", False)}
    safe = merge.safe_merge(master, spark.createDataFrame([("a", " "), ("c", "new")], "k string, t string"), "k", ["t"]).collect()
    assert {(r.k, r.t, r.changed) for r in safe} == {("a", "old", ""), ("c", "new", "t")}
    with pytest.raises(ValueError):
        merge.assert_untouched(master, master, ["k"])


def test_segments_and_packed(spark):
    assert col(spark, lambda c: segments.blocks(c), ["x\nFIRST HEADER LINE\na\nPage 2\nSECOND HEADER LINE\nb\nc"]) == [[["FIRST HEADER LINE", "a"], ["SECOND HEADER LINE", "b", "c"]]]
    lines = spark.createDataFrame([(1, ["abc", "de", "f", "ghijklm", "n"]), (2, []), (3, None)], "id int, p array<string>")
    got = [tuple(r) for r in segments.chunk_sizes(lines.where("p IS NOT NULL"), "id", "p", 5).collect()]
    assert got == [(1, 0, 2, 5), (1, 1, 1, 1), (1, 2, 1, 7), (1, 3, 1, 1)]
    v = ["Cole, Ann; Bo Dee", "Cole, Ann", "A. Bee, Cy Dee and Eve Eff", '"Cole, Ann","Bo Dee"', "Bo Dee, Jr.", "Bo Dee|Cy Eff Jr", None, "", "x" * 20_000, "Bo Dee\nCy Eff", "; ; Bo Dee; ; Cy Eff;"]
    df = spark.createDataFrame([(i, x, "s") for i, x in enumerate(v)], "id int, f string, src string")
    got: dict = {}
    for r in packed.split_packed(df, "id", "f", "person", "src").orderBy("row_id", "item_pos").collect():
        got.setdefault(r.row_id, []).append(r.item)
    assert got == {0: ["Cole, Ann", "Bo Dee"], 2: ["A. Bee", "Cy Dee", "Eve Eff"], 3: ["Cole, Ann", "Bo Dee"], 5: ["Bo Dee", "Cy Eff Jr"], 9: ["Bo Dee", "Cy Eff"], 10: ["Bo Dee", "Cy Eff"]}
    paths = spark.createDataFrame([(1, "a/x 1.jpg, a/staff, y 2.png"), (2, '["a/1.jpg","a/2.jpg"]'), (3, "a/staff, y 2.png")], "id int, f string")
    assert [(r.row_id, r.item) for r in packed.split_packed(paths, "id", "f", "path").orderBy("row_id", "item_pos").collect()] == [(1, "a/x 1.jpg"), (1, "a/staff, y 2.png"), (2, "a/1.jpg"), (2, "a/2.jpg")]
    assert packed.split_packed(paths.where("id > 9"), "id", "f", "path").count() == 0


def test_matching_and_reports(spark):
    left = spark.createDataFrame([(1, "m", "ab", None), (2, "m", "cd", "h"), (3, "m", "zz", None), (4, None, "ab", None)], "id int, b string, n string, h string")
    right = spark.createDataFrame([(10, "m", "ab", None), (11, "m", "cd ef", "h"), (12, "m", "cd gh", None)], "id int, b string, n string, h string")
    assert {tuple(r) for r in match.tiered_match(left, right, "b", "n", "h").collect()} == {(1, 10, "exact"), (2, None, "ambiguous_prefix"), (3, None, "no_match"), (4, None, "no_match")}
    t = spark.createDataFrame([("a", x) for x in (5, 1, 3, 9)] + [("b", None)], "k string, x int")
    assert [tuple(r) for r in report.upper_median(t, ["k"], "x").collect()] == [("a", 5, 4.5, 4)]
    assert spark.range(1).select(quality.violations({"b": F.lit(True), "a": F.lit(True), "c": F.lit(None).cast("boolean")})).first()[0] == "a|b"


def test_files_and_stream(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", None), ('q"x', "2")], "k string, v string")
    files.write_csv(df, f"{tmp_path}/c", ["v", "k", "extra"])
    assert {tuple(r) for r in files.read_csv(spark, f"{tmp_path}/c", ["v", "k", "extra"], strict=True).collect()} == {("", "a\nb", ""), ("2", 'q"x', "")}
    (tmp_path / "l.txt").write_text(" a \n\n b\n")
    assert [r.value for r in files.read_list(spark, f"{tmp_path}/l.txt").collect()] == ["a", "b"]
    assert files.read_json_or(spark, f"{tmp_path}/none.json", df.schema, df).count() == 2
    assert files.move_column_after(df, "k", "v").columns == ["v", "k"]
    q = spark.createDataFrame([(1, "queued", 0, "2024-01-02"), (2, "queued", 1, "2024-01-01"), (3, "failed", 3, "2024-01-01")], "job_id int, status string, attempts int, created_at string")
    c = jobs.claim_oldest(q, 1)
    assert [(r.job_id, r.attempts) for r in c.collect()] == [(2, 2)]
    assert {(r.job_id, r.status) for r in jobs.apply_claims(q, c).collect()} == {(1, "queued"), (2, "running"), (3, "failed")}
    with pytest.raises(KeyError):
        registry.lines_of(df, "portal")


def test_place_score(spark):
    names = ("phone", "domain", "name", "city", "state", "address")
    rows = [("5551234567", "a.example", "oak ridge ccw", "elmmont", "ca", "12 oak st elmmont ca"), ("5551234567", None, "oak ridge ccw academy", "elmmont", None, None), (None, "b.example", "other", "roseyo", "nv", "1 elm st"), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    cand = {"phone": F.lit("5551234567"), "domain": F.lit("a.example"), "name": F.lit("oak ridge ccw"), "address": F.lit("12 oak st elmmont ca 93012")}
    score, why = S.place_score({n: F.col(n) for n in names}, cand)
    got = [tuple(r) for r in df.select(score, why).collect()]
    assert got[0] == (45 + 25 + 25 + 10 + 6 + 12, "exact_phone_match|website_domain_match|strong_name_similarity|city_match|state_match|address_proximity_strong")
    assert got[1] == (45 + 16 + 10, "exact_phone_match|moderate_name_similarity|city_match")
    assert got[2] == (-8 - 15 - 7 - 5, "website_domain_conflict|name_mismatch|city_mismatch|state_mismatch") and got[3] == (-15, "name_mismatch")
    assert col(spark, X.folded_key, ["José  Muñoz-Ruiz", "ÀB", "", None]) == ["jose mun oz ruiz", "a b", "", ""]
    assert col(spark, lambda c: S.demoted(F.lit("high"), c.cast("double")), ["9", "10", None]) == ["medium", "high", "high"]
    assert col(spark, S.retryable, ["Error 529", "HTTP 404", None]) == [True, False, False]
    assert col(spark, S.candidate_ids, ["a, b|a,,c", "", None]) == [["a", "b", "c"], [], None]


def test_job_settles(spark):
    rows = [(1, "running", 1, 3, None), (2, "running", 1, 3, "timeout"), (3, "running", 3, 3, "timeout"), (4, "running", None, None, "x"), (5, "queued", 1, 3, "x"), (6, None, None, None, None)]
    df = spark.createDataFrame(rows, "job_id int, status string, attempts int, max_attempts int, e string")
    got = [(r.status, r.released) for r in jobs.settle(df, F.col("e")).orderBy("job_id").collect()]
    assert got == [("completed", False), ("queued", True), ("failed", False), ("queued", True), ("queued", False), (None, False)]


def test_slug_cascade(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(4)
    words = ["oak", "ridge", "ccw", "training", "academy", "iron", "gate", "the", "llc", "harbor", "stag", "mesa"]
    parts = sorted({"-".join(rng.sample(words, rng.randrange(1, 6))) for _ in range(120)})
    names = sorted({"-".join(rng.sample(words, rng.randrange(1, 6))) for _ in range(80)} | {"", "llc"})
    drop = {"llc", "inc", "corp", "co", "ltd", "the", "and"}

    def similarity(a, b):
        x, y = [t for t in a.split("-") if t and t not in drop], [t for t in b.split("-") if t and t not in drop]
        if not x or not y:
            return 0.0
        return 0.55 * len(set(x) & set(y)) / len(set(x) | set(y)) + 0.45 * SequenceMatcher(None, "-".join(x), "-".join(y)).ratio()

    slugs = [f"{p}-{i}" for i, p in enumerate(parts)]
    want = {}
    for n in names:
        score, slug = max(((round(similarity(n, p), 9), s) for p, s in zip(parts, slugs)), key=lambda z: (z[0], [-ord(c) for c in z[1]]))
        if score >= 0.72:
            want[n] = score
    frame = spark.createDataFrame([(s,) for s in slugs], "slug string")
    got = {r.name: r.slug for r in match.slug_fuzzy(spark.createDataFrame([(n,) for n in names], "name string"), frame).collect()}
    assert set(got) == set(want) and all(abs(similarity(n, s.rsplit("-", 1)[0]) - want[n]) < 1e-6 for n, s in got.items())
    rows = [(1, "oak-gate", ""), (2, "twin", "zz-example"), (3, "twin", "b7"), (4, "none-such", "uniquedomain-example"), (5, "oak-gatte", ""), (6, "", "")]
    more = spark.createDataFrame([("oak-gate-1",), ("twin-a1",), ("twin-b7",), ("my-uniquedomain-9",)], "slug string")
    got = {r.id: (r.slug, r.method) for r in match.slug_cascade(spark.createDataFrame(rows, "id int, name string, domain string"), more).collect()}
    assert got[1] == ("oak-gate-1", "exact") and got[2] == ("twin-a1", "ambiguous_exact") and got[4] == ("my-uniquedomain-9", "domain") and got[6] == ("", "constructed")
    assert got[5] == ("oak-gatte", "constructed") and got[3] == ("twin-b7", "domain")


def test_addresses_and_head(spark):
    ips = ["::1", "fe80::1", "fd12::9", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "2001:db8::1", "127.0.0.1", "8.8.8.8", "none", None]
    assert col(spark, C.is_private_address, ips) == [True, True, True, True, False, False, True, False, None, None]
    df = spark.createDataFrame([(i, f"r{i}") for i in range(5)], "i int, t string")
    assert [tuple(r) for r in report.head_sample(df, [F.col("i")], "t", 3).orderBy("position").collect()] == [(1, "r0"), (2, "r1"), (3, "r2"), (4, "... and 2 more")]
    assert report.head_sample(df.where("i > 9"), [F.col("i")], "t", 3).count() == 0 and report.head_sample(df, [F.col("i")], "t", 5).count() == 5
