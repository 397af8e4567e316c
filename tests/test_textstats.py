"""Text statistics against the reference's formulas, written out in Python."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from rosterlake.operators import textstats


def vectors(texts):
    docs = [re.findall(r"[a-z']+", t.lower()) for t in texts]
    df = Counter(t for d in docs for t in set(d))
    return [{t: c / len(d) * (math.log((len(docs) + 1) / (df[t] + 1)) + 1) for t, c in Counter(d).items()} for d in docs]


def cosine(a, b):
    norm = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
    return sum(v * b.get(k, 0) for k, v in a.items()) / norm if norm else 0.0


TEXTS = ["the range is open the range is new", "the range is closed", "a calm coach and the range", "123 456", "the range is open the range is new"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")


def test_weights_are_smoothed_and_relative(spark):
    df = frame(spark, TEXTS)
    w = textstats.tfidf(df, "id", "text")
    got = {(r.id, r.term): r.w for r in w.collect()}
    assert got == {(i, t): pytest.approx(x) for i, v in enumerate(vectors(TEXTS)) for t, x in v.items()}
    mean = {r.term: r.w for r in textstats.centroid(w, df).collect()}
    assert mean["range"] == pytest.approx(sum(v.get("range", 0) for v in vectors(TEXTS)) / len(TEXTS))


def test_one_repeated_text_has_weights(spark):
    w = textstats.tfidf(frame(spark, ["the range"] * 3), "id", "text").collect()
    assert len(w) == 6 and all(r.w == pytest.approx(0.5) for r in w)


def test_audit_scores_as_written_out(spark, monkeypatch):
    """Random texts against the reference's scoring over all pairs; several passes and tiles."""
    import random

    monkeypatch.setattr(textstats, "PASS", 40)
    rng = random.Random(7)
    rare = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(70):
        opening = rng.choice(["we teach safe carry every single day here", " ".join(rare() for _ in range(6))])
        body = " ".join(rng.choice(["range", "coach", "calm", "permit", rare(), rare()]) for _ in range(rng.choice([6, 12])))
        texts.append(f"{opening} {body}. " + "Call now. " * rng.choice([0, 1, 4]))
    texts += [texts[0], texts[1], "brand new opening of this copy here " + texts[2].split(".")[0] + ".", "12 34", " "]
    kept = [t for t in texts if t.strip()]
    vec = vectors(kept)
    mean = Counter()
    for v in vec:
        mean.update(v)
    sents = [max(1, len([x for x in re.split(r"(?<=[.!?])\s+", t.strip()) if x])) for t in kept]
    key = [" ".join(re.split(r"(?<=[.!?])\s+", t.strip())[0].lower().split()[:6]) for t in kept]
    mode = max(Counter(sents).items(), key=lambda x: (x[1], -x[0]))[0]
    want = []
    for i, v in enumerate(vec):
        size, far = key.count(key[i]), 1 - cosine(v, mean)
        near = max(max(len(v.keys() & u.keys()) / max(1, len(v.keys() | u.keys())), cosine(v, u)) for j, u in enumerate(vec) if j != i)
        want.append(5 if size <= 2 and far >= 0.35 and near < 0.45 else 4 if size <= 5 and far >= 0.25 and near < 0.55 else 3 if size <= 15 and near < 0.65
                    else 2 if size <= 40 or near >= 0.72 or abs(sents[i] - mode) <= 1 else 1)
    got = {r.id: r.score for r in textstats.uniqueness(frame(spark, texts), "id", "text").collect()}
    assert got == dict(zip([i for i, t in enumerate(texts) if t.strip()], want)) and len(set(want)) > 2
    df = frame(spark, texts)
    near = {r.id: r.similarity for r in textstats.nearest(textstats.tfidf(df, "id", "text"), df.select("id")).collect()}
    assert near[0] == 1.0 and near[len(texts) - 1] == 0.0
