"""Text normalisers: Column in, Column out, all built-in expressions unless named ``*_udf``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space at either end, of any kind (SQL ``trim`` strips blanks only).
_ENDS = r"^\s+|\s+$"


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, _ENDS, "")


def blank_to_null(c: Column) -> Column:
    """Trimmed text; blank becomes null."""
    t = strip_ws(c)
    return F.when(t != "", t)


def is_missing(c: Column, words: tuple[str, ...] = ("", "null", "none", "nan")) -> Column:
    """Null, blank, or one of the words that stand for nothing, in any case."""
    return F.coalesce(F.lower(strip_ws(c)), F.lit("")).isin(*words)


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def name_key_ascii(c: Column) -> Column:
    """Lower case, only ASCII word characters and blanks kept, blanks collapsed."""
    return collapse_ws(F.regexp_replace(F.lower(strip_ws(c)), r"[^A-Za-z0-9_\s]", ""))


def name_key_unicode(c: Column) -> Column:
    """As above with the letters and digits of all scripts."""
    return collapse_ws(F.regexp_replace(F.lower(strip_ws(c)), r"[^\p{L}\p{N}_\s]", ""))


def listing_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def merge_key_soft(c: Column) -> Column:
    """Lower case; runs of full stops and commas become one blank."""
    return collapse_ws(F.regexp_replace(F.lower(strip_ws(c)), r"[.,]+", " "))


def merge_key_hard(c: Column) -> Column:
    """Lower case; every run outside a-z and 0-9 becomes one blank."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def _latin_letters() -> list[tuple[str, str]]:
    """Lower-case Latin-1 letters with a mark, and what their decomposition leaves: the letter and a blank."""
    import unicodedata

    parts = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0xE0, 0x100)]
    return [(c, d[0] + " ") for c, d in parts if len(d) == 2]


#: Replacements that stand for compatibility decomposition inside the engine, without a Python worker.
LATIN = _latin_letters()


def folded_key(c: Column) -> Column:
    """As ``nfkd_key_udf`` for texts in Latin-1, but inside generated code: lower case, a mark splits off its
    letter, everything but word characters becomes blanks, blanks collapse. Null becomes empty."""
    t = F.lower(F.coalesce(c, F.lit("")))
    for letter, plain in LATIN:
        t = F.replace(t, F.lit(letter), F.lit(plain))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^A-Za-z0-9_\s]", " "), r"\s+", " "))


@F.pandas_udf(T.StringType())
def nfkd_key_udf(s: pd.Series) -> pd.Series:
    """Lower case, compatibility-decomposed; everything but word characters becomes blanks."""
    import re
    import unicodedata

    clean = lambda t: " ".join(re.sub(r"[^A-Za-z0-9_\s]", " ", unicodedata.normalize("NFKD", t.lower())).split())
    return s.map(lambda t: None if t is None else clean(t))


def slugify(c: Column) -> Column:
    """Lower case; punctuation vanishes, blanks become hyphens, hyphens collapse."""
    t = F.regexp_replace(F.lower(strip_ws(c)), r"[^a-z0-9\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\s+", "-"), r"-+", "-"), r"^-|-$", "")


def county_slug(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """Lower case; blanks and underscores become hyphens, hyphens collapse; ``aliases`` replace whole slugs."""
    t = F.replace(F.lower(strip_ws(c)), F.lit("_"), F.lit("-"))
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\s+", "-"), r"-+", "-"), r"^-|-$", "")
    for old, new in (aliases or {}).items():
        s = F.when(s == old, F.lit(new)).otherwise(s)
    return s


def drop_last_slug_part(c: Column) -> Column:
    return F.regexp_replace(c, r"-[^-]*$", "")


def tokens(c: Column) -> Column:
    """Lower-case words of letters and apostrophes, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z']+)"), F.lit(1))


def sentences(c: Column) -> Column:
    """Sentences ended by a full stop, exclamation or question mark and white space."""
    return F.filter(F.split(strip_ws(c), r"(?<=[.!?])\s+"), lambda s: s != "")


def paragraph_count(c: Column) -> Column:
    """Groups separated by blank lines; a single group counts by its sentences: one up to three, else a third."""
    groups = F.size(F.filter(F.split(c, r"\n\s*\n"), lambda g: strip_ws(g) != ""))
    n = F.size(sentences(c))
    return F.when(groups > 1, groups).when(n <= 3, F.lit(1)).otherwise(F.ceil(n / 3).cast("int"))


def first_sentence(c: Column) -> Column:
    return F.coalesce(F.get(sentences(c), F.lit(0)), F.lit(""))


def opening_words(c: Column, n: int = 8) -> Column:
    """The first n words of the first sentence, lower-cased."""
    return F.array_join(F.slice(F.split(collapse_ws(F.lower(first_sentence(c))), " "), 1, n), " ")


def opening_key(c: Column, n: int = 6) -> Column:
    """As ``opening_words`` with phone numbers masked."""
    masked = F.regexp_replace(F.lower(first_sentence(c)), r"\(?\d{3}\)?[-. ]?\d{3}[-. ]?\d{4}", "{phone}")
    return F.array_join(F.slice(F.split(collapse_ws(masked), " "), 1, n), " ")


def join_nonblank(cols: list[Column], sep: str = ", ") -> Column:
    """The non-blank parts joined (``concat_ws`` would keep empty ones)."""
    return F.array_join(F.filter(F.array(*cols), lambda x: F.coalesce(strip_ws(x), F.lit("")) != ""), sep)


def list_cell(arr: Column, sep: str = "; ") -> Column:
    return F.array_join(F.filter(arr, lambda x: F.coalesce(strip_ws(x), F.lit("")) != ""), sep)


def rebase_paths(c: Column, base: str, sep: str = "|") -> Column:
    """Each path of a packed field put under ``base``, without leading slashes."""
    parts = F.transform(F.split(c, r"\|"), lambda p: F.regexp_replace(strip_ws(p), r"^/+", ""))
    return F.array_join(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(base), p)), sep)


def occurrences(c: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a phrase, ignoring case."""
    low = F.lower(c)
    return ((F.length(low) - F.length(F.replace(low, F.lit(phrase.lower()), F.lit("")))) / len(phrase)).cast("long")
