"""Repeated texts are split and written once."""

from __future__ import annotations

from rosterlake.llm import p4_neardup as p4


def test_words_of_repeated_texts_are_written_once(spark, monkeypatch):
    written = {}

    def noted(df, label="t", codec="zstd"):
        out = p4_materialise(df, label, codec)
        written[label] = written.get(label, 0) + out.count()
        return out

    p4_materialise = p4.materialise
    monkeypatch.setattr(p4, "materialise", noted)
    base = [" ".join(f"word{i}x{j}" for j in range(40)) for i in range(3)] + ["too short", None]
    rows = [(5 * c + i, t) for c in range(50) for i, t in enumerate(base)]
    rows += [(1000, " ".join(reversed(base[0].split())))]
    got = {r.id: r.root for r in p4.near_groups(spark.createDataFrame(rows, "id bigint, text string"), "id", "text").collect()}
    assert got == {5 * c + i: i for c in range(50) for i in range(3)} | {1000: 0}
    assert written["p4w"] <= 8  # four texts of thirty words or more, not 151 rows
