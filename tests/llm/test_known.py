"""Operators against brute force or known answers on small inputs."""

from __future__ import annotations

import os
import random
import re
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from tables import write  # noqa: E402

from rosterlake.llm import p4_neardup, p9_packing  # noqa: E402
from rosterlake.llm.address_parts import align, osa, parse, same_place, substitution  # noqa: E402
from rosterlake.llm.common import components  # noqa: E402
from rosterlake.llm.name_parts import INF, assignment, given_cost, givens_cost, org_cost, parse_org, parse_person, typo_cost  # noqa: E402
from rosterlake.llm.p10_pii import redact  # noqa: E402
from rosterlake.llm.p8_tokens import DEFAULT_DIR, DEFAULT_FILE, SpeculativeEncoder  # noqa: E402
from rosterlake.llm.queries import queries  # noqa: E402


def run(spark, tmp, name, **tables):
    return {tuple(r) for r in queries()[name](spark, write(spark, tmp, tables)).collect()}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    joined = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in joined}


def test_address_parts():
    same = [("11584 Amberglen Ct, Quinham CA 93145", "11,584 AMBERGLEN COURT, QUINHAM, CALIFORNIA 93145-1234"), ("16600 Pebbleacre Ct. Ste. F, Roseyo, CA", "Suite F, 16600 Pebbleacre, Roseyo, Calif. 93134"),
            ("27468 W. Amberfall Ct, Arrobridge", "27468 Ambetfall West, Arrobridge"), ("5743 State Hwy 90 Arrobridge 93002", "5743 SR 90, Arrobridge, Calif. 93002"), ("22 12th St, Elmmont", "22 Twelfth Street, Elmmont, USA")]
    other = [("100 Oak Hill St, Elmmont", "100 Oak Hill Ave, Elmmont"), ("100 Oakhill St N, Elmmont", "100 Oakhill St S, Elmmont"), ("100 Oakhill St #2, Elmmont", "100 Oakhill St #3, Elmmont"), ("100 Oakhill St, Elmmont", "102 Oakhill St, Elmmont"),
             ("100 Oakhill St, Elmmont", "100 Oakhill St, Dunwick")]

    def key(s):
        n, d, name, kind, unit, city, _, _ = parse(s)
        return n, d, name, kind, unit, (city,) if city else ()

    assert all(same_place(key(a), key(b)) for a, b in same)
    assert not any(same_place(key(a), key(b)) for a, b in other)
    assert parse("By appointment") is None and parse("Elmmont, CA 93012") is None and parse("") is None and parse(None) is None
    assert align([("name", "a")], [("name", "a"), ("unit", "1"), ("city", "x")], substitution) == pytest.approx(0.5)
    assert osa("abcd", "abdc") == 1 and osa("abc", "xyz", 2) == 3


def test_p1_pairs(spark, tmp_path):
    a = [{"listing_id": i, "address": x, "city": c} for i, (x, c) in enumerate([("12 Amberglen Ct, Quinham CA 93145", "Quinham"), ("12 AMBERGLEN COURT", "quinham"), ("12 Amberglen Ct", "Roseyo"), ("Online", None), (None, "Quinham"), ("12 Amberglen Ct #4, Quinham", None),
                                                                                ("12 Amberglen Ct #5, Quinham", None), ("12 Ambergeln Ct, Quinham", None)], 1)]
    assert run(spark, tmp_path, "p1_found", marin=a) == {(1, 2), (1, 6), (1, 7), (1, 8), (2, 6), (2, 7), (2, 8), (6, 8), (7, 8)}


def test_p2_cases(spark, tmp_path):
    import datetime as dt

    base = {"county": "marin", "vendor_name": "A B"}
    rows = [dict(base, listing_id=1, crawl_status="success", enrichment_confidence="low", price_16hr_full="$400", enriched_at=dt.datetime(2024, 1, 1)),
            dict(base, listing_id=2, vendor_name="b a.", crawl_status="SUCCESS ", enrichment_confidence="High", price_16hr_full="$450", enriched_at=dt.datetime(2025, 1, 1)),
            dict(base, listing_id=3, crawl_status="failed", enrichment_confidence="high", price_16hr_full="call", enriched_at=dt.datetime(2026, 1, 1))]
    got = run(spark, tmp_path, "p2_found", marin=rows)
    # the third is latest but failed: no listing is best on all three counts for status and confidence
    assert got == {(1, 2, "price_16hr_full")}


def test_names():
    assert parse_person("Sgt. Snalgart, Greg T. (Ret.), Jr.") == ("snalgart", ("greg", "t"))
    assert parse_person("G.C. Chrierpeen - Lead") == ("chrierpeen", ("g", "c")) and parse_person("TBD") is None and parse_person("") is None
    assert given_cost("judy", "judith") < 0.4 and given_cost("w", "bill") == 0.4 and given_cost("jon", "jen") == INF
    assert parse_org("The Vrattiad Pass Tac Train. - Fairville")[0] == ("vrattiad", "pass") and parse_org("Private Instructor") is None


def test_name_assignment():
    from itertools import permutations

    rng = random.Random(5)
    for _ in range(60):
        n, m = rng.randrange(1, 5), rng.randrange(5, 7)
        cost = [[rng.choice([0.0, 0.5, 1.0, 2.0, 1000.0]) for _ in range(m)] for _ in range(n)]
        assert assignment(cost)[0] == min(sum(cost[i][p[i]] for i in range(n)) for p in permutations(range(m), n))
    # a neighbouring key is one typo, another letter is two
    assert typo_cost("jorvoll", "jorcoll") == 1 and typo_cost("jorvoll", "jorpoll") == 2 and typo_cost("harbor", "habror") == 1 and typo_cost("abc", "xyz") == 3
    # called by the second name; a second name left out; second names that contradict
    assert givens_cost(("j", "robert"), ("robert",)) < 1 and givens_cost(("robert", "l"), ("robert",)) < 1 and givens_cost(("robert", "l"), ("robert", "m")) == INF
    assert org_cost(("oak", "ridge"), ("ridge", "oak"), ("academy",), ()) == 0 and org_cost(("oak", "r"), ("oak", "ridge"), (), ()) == 0.5
    assert org_cost(("oak", "ridge"), ("oak", "bridge"), ("academy",), ("ccw", "training")) == INF and org_cost(("oak", "ridge"), ("oak", "canyon"), (), ()) == INF


def test_p3_pairs(spark, tmp_path):
    v = [("Sweankex Pioneer CCW Academy LLC", "José Mirneau; Judy Stoambette"), ("SWEANKEX PIONEER C.C.W. ACAD.", "Mirneau, Jose"), ("CCW Academy by SweankexPioneer", "J. Stoambette"),
         ("Other Harbor Gun Club", "James Stoambette"), ("TBD", "Various"), (None, None), ("Swaenkex Pioneer CCW Academy", "Judith Stoambett")]
    got = run(spark, tmp_path, "p3_found", san_diego=[{"row_id": i, "vendor_name": a, "instructor_names": b} for i, (a, b) in enumerate(v, 1)])
    orgs = {(a, b) for a, b, f in got if f == "vendor_name"}
    people = {(a, b) for a, b, f in got if f == "instructor_names"}
    assert orgs == {(a, b) for a in (1, 2, 3, 7) for b in (1, 2, 3, 7) if a < b}
    # the initial fits Judith and James Stoambette; the organisation of row 3 names only Judith
    assert {(1, 2), (1, 7), (1, 3)} <= people and (1, 4) not in people and (3, 4) not in people


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(0)
    for shared in (10, 40, 60):
        est = []
        for _ in range(20):
            u = rng.integers(0, 2**47, size=120 - shared)
            a, b = u[:60], u[60 - shared:]
            s = p4_neardup.signatures(np.concatenate([a, b]), np.array([60, 60]), 256)
            est.append((s[0] == s[1]).mean())
        assert abs(np.mean(est) - shared / (120 - shared)) < 0.03
    assert (p4_neardup.signatures(np.array([7, 7]), np.array([1, 1]), 16)[0] < 16).all()


def test_p4_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        base = rng.sample(words, 40)
        for k in range(rng.randrange(1, 5)):
            t = base[:]
            for _ in range(k * 3):
                t[rng.randrange(40)] = rng.choice(words)
            rng.shuffle(t)
            texts.append(" ".join(t).title() + ".")
    texts += ["too short text", "", None, texts[0]]
    sets = {i: set(re.findall(r"[^\W_]+", t.lower())) for i, t in enumerate(texts) if t and len(t.split()) >= 30}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j]) - 1e-9:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    want = {(find(i), i) for i in sets if find(i) != i}
    assert run(spark, tmp_path, "p4_found", marin=[{"listing_id": i, "vendor_description": t} for i, t in enumerate(texts)]) == want


def test_large_buckets_lose_no_pair(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([1, 1, 1, 2, 3, 4, 5]), 100 + rng.randrange(60)]) for i in range(300)]
    out = p4_neardup.bucket_pairs(spark.createDataFrame(rows, "node long, keys array<long>")).collect()
    for k in {k for _, ks in rows for k in ks}:
        v = sorted(n for n, ks in rows if k in ks)
        pairs = {(r.a, r.b) for r in out if r.key == k and r.b != -1}
        members = {r.a for r in out if r.key == k and r.b == -1}
        if len(v) <= p4_neardup.STAR:
            assert pairs == {(x, y) for i, x in enumerate(v) for y in v[i + 1:]} and not members
        else:
            assert {(v[0], y) for y in v[1:]} <= pairs and members == set(v)


def test_p6_links(spark, tmp_path):
    rng = random.Random(5)
    syl = ["dwel", "no", "tri", "bax", "mor", "via", "kul", "sten", "por", "lix", "gan", "tero"]
    names = list({(rng.choice(syl) + rng.choice(syl) + rng.choice(syl) + rng.choice("aeiou")).title() + " " + rng.choice(["Creek", "Wolf", "Stag", "Lake"]) for _ in range(80)})
    marin, places = [], []
    for i, n in enumerate(names):
        phone, site = f"415-555-{i:04d}", f"https://www.{n.split()[0].lower()}{i}.example"
        places.append({"row_id": i, "vendor_name": n.upper() + " GUN CLUB", "phone": phone, "website_url": site if i % 2 else None, "google_place_id": f"P{i}" if i % 10 else " "})
        marin.append({"listing_id": i, "vendor_name": f"{n} Gun Club LLC", "phone": phone if i % 3 else None, "website_url": site})
    marin.append({"listing_id": 999, "vendor_name": None, "phone": "415-555-0001"})
    got = run(spark, tmp_path, "p6_found", marin=marin, vendors_placeid_smoke_out=places)
    want = {(i, f"P{i}") for i in range(len(names)) if i % 10}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_p6_hot_name_needs_no_bucket(spark, tmp_path, monkeypatch):
    """A name with more than 400 profiles on both sides and no phone or site in common, without buckets."""
    from rosterlake.llm import p6_linkage

    monkeypatch.setattr(p6_linkage, "SKETCH_MOST", -1)
    places = [{"row_id": i, "vendor_name": "Dwelnoa Creek Gun Club", "phone": f"415-555-{i:04d}", "google_place_id": "P1"} for i in range(450)]
    marin = [{"listing_id": i, "vendor_name": "Dwelnoa Creek Gun Club LLC", "phone": f"415-666-{i:04d}"} for i in range(450)] + [{"listing_id": 900, "vendor_name": "Trivia Wolf"}]
    got = run(spark, tmp_path, "p6_found", marin=marin, vendors_placeid_smoke_out=places)
    assert got == {(i, "P1") for i in range(450)}


def test_p7_formatting(spark, tmp_path):
    rows = [("marin", "A & B, Inc."), ("MARIN.", "inc b-a"), ("marin", "A B"), ("san diego", "A & B Inc"), (None, "A & B Inc"), ("marin", None), ("san-diego", "INC, a  B"), ("marin", "O’Neil A"), ("marin", "oneil  a")]
    got = run(spark, tmp_path, "p7_found", marin=[{"listing_id": i, "county": a, "vendor_name": b} for i, (a, b) in enumerate(rows, 1)])
    assert got == {(1, 2), (4, 7), (8, 9)}


def test_p8_equals_reference_tokenizer():
    tiktoken = pytest.importorskip("tiktoken")
    path = f"{DEFAULT_DIR}/{DEFAULT_FILE}"
    if not os.path.exists(path):
        pytest.skip("no vocabulary")
    enc = SpeculativeEncoder(path)
    from rosterlake.llm.p8_tokens import SPLIT

    ref = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=enc.ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["", "Hello world's  end\n\n x", "a" * 3000, "<|endoftext|>", "🎯é漢字 ñandú"] + ["".join(rng.choice("abc XYZ019.,'é\n") for _ in range(200)) for _ in range(50)]
    assert [x.tolist() for x in enc.encode_batch(texts)] == [ref.encode_ordinary(t) for t in texts]
    assert enc.encode_batch([None])[0].tolist() == [] and enc.merged < enc.speculated


def test_p9_plan_is_tight_and_complete():
    rng = random.Random(4)
    for cap in (50, 512):
        counts = {x: rng.randrange(1, 40) for x in rng.sample(range(1, cap + 1), 30)} | {0: 5}
        ranges, bins = p9_packing.plan_lengths(counts, cap)
        fill = [0] * bins
        for length, lo, hi, first, per in ranges:
            for k in range(lo, hi):
                fill[first + (k - lo) // per] += length
        total = sum(k * v for k, v in counts.items())
        assert max(fill) <= cap and sum(fill) == total and bins <= 11 / 9 * -(-total // cap) + 1
    assert p9_packing.plan_lengths({}, 10) == ([], 0)


def test_p10_spans_and_redaction(spark, tmp_path):
    frame = ["Contact {n} at {p} for rates.", "Driver licence {d} was checked by Mr. {f} at the door.", "Invoice 2024-99093 was paid.", "The form shows social security number {s} for {n}.", "Classes meet at {a}.", "Write to {e} today.", "Course code CL-23-1042 replaces CL-20-1111."]
    rng = random.Random(7)
    docs, want = [], {}
    firsts, lasts = ["James", "Judith", "Zoë", "Robert", "Cynthia"], ["Vreldan", "Stoambett", "Klierpag", "Zwonder", "Trulbane", "Plosket", "Bwendar", "Snoalce"]
    for i in range(120):
        n, f = f"{rng.choice(firsts)} {rng.choice(lasts)}{rng.choice('aeiou')}{rng.choice('nrst')}", rng.choice(lasts) + rng.choice("xz")
        vals = {"n": n, "p": f"({rng.randrange(200, 999)}) 555-{i:04d}", "d": f"B{rng.randrange(10**6, 10**7)}", "f": f, "s": f"9{rng.randrange(10, 99)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}",
                "a": f"{rng.randrange(100, 9999)} Oakhill Street, Elmmont, CA 93012", "e": f"user{i}@mail.example"}
        kinds = {"n": "person_name", "p": "phone", "d": "id_number", "f": "person_name", "s": "id_number", "a": "address", "e": "email"}
        text, spans = "", set()
        for t in rng.sample(frame, 4):
            for piece in re.split(r"(\{\w\})", t):
                k = piece[1:-1] if piece.startswith("{") else None
                s = vals[k] if k else piece
                if k:
                    spans.add((i, len(text), len(text) + len(s), kinds[k]))
                text += s
            text += "\n"
        docs.append({"doc_id": i, "text": text})
        want[i] = spans
    got = run(spark, tmp_path, "p10_found", documents=docs + [{"doc_id": 500, "text": None}, {"doc_id": 501, "text": ""}])
    all_want = set().union(*want.values())
    assert len(got & all_want) >= 0.95 * len(all_want) and len(got - all_want) <= 0.05 * len(got)
    assert redact("mail a@b.c now", [(5, 10, "email")]) == "mail [EMAIL] now" and redact(None, []) is None


def test_p10_given_names_from_the_corpus(spark, tmp_path):
    families = ["Huberland", "Twumpall", "Klarsen", "Brodinsk", "Veskamp", "Moltrau"]
    docs = [{"doc_id": i, "text": f"Please ask for Wolfgang {f} at the gate."} for i, f in enumerate(families)]
    docs += [{"doc_id": 100 + i, "text": f"{v}wall {w} is open."} for i, (v, w) in enumerate((v, w) for v in ("Granite", "Oak", "Moss", "Iron", "Flint", "Fern", "Elder", "Birch", "Coral", "Amber", "Plum", "Rush") for w in ("Terrace", "Shooting", "Academy"))]
    docs += [{"doc_id": 20, "text": "We meet at 5 Oakhill St, Elmmont, CA 93012 on Monday."}, {"doc_id": 21, "text": None}, {"doc_id": 22, "text": ""}]
    got = run(spark, tmp_path, "p10_found", documents=docs)
    at = len("Please ask for ")
    assert {(i, at, at + len("Wolfgang ") + len(f), "person_name") for i, f in enumerate(families)} <= got
    assert not {x for x in got if x[0] > 20} and {x[3] for x in got if x[0] == 20} == {"address"}
