"""Problem 5: fields that pack several values behind inconsistent delimiters, split with position.

Every candidate delimiter splits a value; a candidate is scored by the regularity of its pieces (the
share that look like one value of the field's type) and, between equals, by how consistently it
explains the values of the row's source (share of its splits whose pieces are all regular, and
agreement of their piece counts), then by a fixed order. Enclosing quotes and list brackets protect
delimiters inside. All steps are built-in expressions; the only aggregate is per source.

Nulls and blank values give no rows. Empty pieces are skipped and don't count for positions. A value
with fewer than two pieces gives no rows unless ``singles`` is set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.operators.skew import skewless_lookup
from rosterlake.session import materialise, table

_WORD = r"\p{L}[\p{L}\p{M}'’\-]*+(?<=[\p{L}\p{M}]{2}|['’\-]\p{L})"
_INIT = r"(?:(?:\p{L}\.){1,3}\p{L}?|\p{L})"
_SUFFIX = r"(?:jr|sr|ii|iii|iv)\b\.?"
_TAIL = rf"(?:\s*,?\s*(?:{_SUFFIX}|\(ret\.?\)))*(?:\s+-\s+\p{{L}}+)?"
_TITLE = r"(?:(?:mr|mrs|ms|dr|sgt|lt|capt|cpl|det|dep|ofc|prof|rev|deputy|officer|sergeant|lieutenant|captain|coach)\b\.?\s+)*"
#: What one value of a type looks like.
PIECE_TYPES = {
    "path": r"(?i)(?!.*\.(?:jpe?g|png|webp|gif|svg|avif|bmp|tiff?|pdf)\s*,)[^|;\r\n]*\.(?:jpe?g|png|webp|gif|svg|avif|bmp|tiff?|pdf)(?:\?[^\s,|;]*)?",
    "person": rf"(?i)(?=[^|;\r\n]{{1,120}}$){_TITLE}(?!.*\s(?:and|&)\s)(?:(?:(?:{_WORD}|{_INIT})\s+){{1,5}}{_WORD}|{_WORD},\s*(?:{_WORD}|{_INIT})(?:\s+{_INIT}){{0,3}}){_TAIL}",
    "place": r"(?i)(?!.*[\r\n]|.*\b(?:and)\b)\p{L}[\p{L}\p{M}'’.]*(?:[ \-][\p{L}\p{M}'’.]+){0,5}",
    "text": r"[^|;\r\n]+",
}
_AND = r"\s+(?:(?i)and|&)\s+"
_COMMA = rf"\s*,\s*(?!(?i){_SUFFIX}|\(ret)"
#: Candidate delimiters in order of preference between equal scores.
DELIMITERS = (
    ("newline", r"\s*[\r\n]+\s*"), ("pipe", r"\s*\|\s*"), ("semicolon", r"\s*;\s*"), ("slash", r"\s*/\s*"), ("spaced slash", r"\s+/\s+"),
    ("and", _AND), ("comma", _COMMA), ("comma and", rf"\s*,\s*(?i)(?:and|&)\s+|{_AND}|{_COMMA}"), ("none", r"(?!)"),
)
# A comma that ends one path and starts the next, as a path may hold commas itself
_PATH_COMMA = r"(?i)(?<=\.(?:jpe?g|png|webp|gif|svg|avif|bmp|tiff?|pdf))\s*,\s*"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")


def _bare(c: Column) -> Column:
    """Without outer spaces and one pair of enclosing quotes."""
    c = _trim(c)
    return _trim(F.when(c.rlike(r'^"[^"]*"$'), F.regexp_replace(c, r'^"|"$', "")).otherwise(c))


def _pieces(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), _bare), lambda x: x != "")


def candidates(value: Column, kind: str) -> Column:
    """Array of ``(no, pieces, fit)``; fit is the share of regular pieces."""
    body = _trim(value)
    body = F.when(body.rlike(r"(?s)^\[.*\]$"), _trim(F.regexp_replace(body, r"^\[|\]$", ""))).otherwise(body)
    body = F.regexp_replace(body, r"^(?:\s*[|;,]\s*)+|(?:\s*[|;,]\s*)+$", "")
    quoted = F.filter(F.transform(F.regexp_extract_all(body, F.lit(r'"([^"]*)"'), F.lit(1)), _trim), lambda x: x != "")
    regular = lambda p: (F.regexp_extract(p, f"^(?:{PIECE_TYPES[kind]})$", 0) != "").cast("double")
    share = lambda ps: F.when(F.size(ps) > 0, F.aggregate(ps, F.lit(0.0), lambda a, p: a + regular(p)) / F.size(ps)).otherwise(F.lit(0.0))
    split = []
    for no, (name, pattern) in enumerate(DELIMITERS):
        if kind == "path":
            if name in ("slash", "spaced slash", "and", "comma and"):
                continue
            pattern = _PATH_COMMA if name == "comma" else pattern
        split.append(F.struct(F.lit(no).alias("no"), _pieces(body, pattern).alias("pieces")))
    whole = F.array(F.struct(F.lit(-1).alias("no"), quoted.alias("pieces")))
    # nothing but quoted pieces and separators, with two pieces at least
    listed = F.regexp_replace(body, r'"[^"]*"', "").rlike(r"^[\s,;|/]*$") & (F.size(quoted) > 1)
    arr = F.when(listed, whole).otherwise(F.array(*split))
    return F.transform(arr, lambda x: F.struct(x["no"].alias("no"), x["pieces"].alias("pieces"), share(x["pieces"]).alias("fit")))


def split_packed(df: DataFrame, id_col: str, field: str, kind: str, source_col: str | None = None, singles: bool = False) -> DataFrame:
    """``row_id, item_pos, item`` of the packed ``field``; ``kind`` is one of PIECE_TYPES."""
    src = F.coalesce(F.col(source_col).cast("string"), F.lit("")) if source_col else F.lit("")
    rows = df.where(F.col(field).isNotNull() & (_trim(F.col(field)) != "")).select(F.col(id_col).alias("row_id"), src.alias("src"), candidates(F.col(field), kind).alias("cs"))
    rows = materialise(rows, "packed")
    opened = rows.select("src", F.explode("cs").alias("c")).where("c.no >= 0 AND size(c.pieces) > 1")
    stats = opened.groupBy("src", F.col("c.no").alias("no")).agg(
        F.avg((F.col("c.fit") == 1).cast("double")).alias("good"), F.stddev_pop(F.when(F.col("c.fit") == 1, F.size("c.pieces"))).alias("sd"), F.count("*").alias("n"))
    score = F.col("good") * F.log1p("n") / (1 + F.coalesce(F.col("sd"), F.lit(0.0)))
    per_source = stats.groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("no", score.alias("s")))).alias("prior"))  # one entry a delimiter
    counts = rows.groupBy("src").agg(F.count("*").alias("n"))
    per_source = materialise(counts.join(per_source, "src", "left"), "packedsrc")
    both = skewless_lookup(rows, per_source, ["src"], "n")
    best = F.array_max(F.transform("cs", lambda c: F.struct(
        F.round(c["fit"], 9).alias("fit"), F.round(F.coalesce(F.try_element_at(F.col("prior"), c["no"]), F.lit(0.0)), 9).alias("prior"), (-c["no"]).alias("order"), c["pieces"].alias("pieces"))))
    out = both.select("row_id", best["pieces"].alias("p")).where(F.size("p") >= (1 if singles else 2))
    return out.select("row_id", F.posexplode("p").alias("pos", "item")).select("row_id", (F.col("pos") + 1).cast("long").alias("item_pos"), "item")


PACKED_FIELDS = (
    ("san_diego", "instructor_names", "row_id", "person", "source_url"),
    ("marin", "instructor_image_paths", "listing_id", "path", "county"),
    ("marin", "city", "listing_id", "place", "county"),
)


def p5_found(spark, sf_dir: str) -> DataFrame:
    """``table_name, field_name, row_id, item_pos, item`` of every field with two or more values."""
    out = None
    for name, field, key, kind, source in PACKED_FIELDS:
        part = split_packed(table(spark, sf_dir, name).select(key, field, source), key, field, kind, source)
        part = part.select(F.lit(name).alias("table_name"), F.lit(field).alias("field_name"), F.col("row_id").cast("long").alias("row_id"), "item_pos", "item")
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {"p5_found": p5_found}
SQL: dict[str, str] = {}
