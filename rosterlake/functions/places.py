"""Cities out of city and address fields (``City, ST 12345`` and looser forms)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterlake.functions.text import collapse_ws, strip_ws

# Texts in a city field that name no city, words of venues, and states that may follow a city.
NO_CITY = ("online", "northern california", "several northern california counties", "ca locations")
VENUE = r"(?i)\b(?:gun\s+range|shooting\s+range|gun\s+club|armory|gun\s+world)\b"
STATES = ("CA", "NV", "AZ", "OR", "WA", "ID", "UT")


def clean_city_part(c: Column) -> Column:
    """One candidate with a state after it dropped; null for blanks, ``online``, two-letter codes, counties
    and venues."""
    t = strip_ws(c)
    low = F.lower(t)
    bad = (t == "") | (low == "online") | low.rlike("^[a-z]{2}$") | low.rlike(r"\sco\.?$") | low.rlike("county|counties") | t.rlike(VENUE)
    return F.when(~bad, F.regexp_replace(t, rf"\s+(?:{'|'.join(STATES)})$", ""))


def clean_city(c: Column, county: Column | None = None) -> Column:
    """The first usable part of a city field split at slashes and commas, or the first that contains the
    county's name or lies within it; null if none, or if the whole field names no city."""
    t = strip_ws(c)
    parts = F.filter(F.transform(F.split(t, "[/,]"), clean_city_part), lambda x: x.isNotNull())
    best = F.get(parts, F.lit(0))
    if county is not None:
        name = F.lower(F.replace(county, F.lit("-"), F.lit(" ")))
        best = F.coalesce(F.get(F.filter(parts, lambda p: F.contains(F.lower(p), name) | F.contains(name, F.lower(p))), F.lit(0)), best)
    whole = F.lower(t).isin(*NO_CITY) | F.lower(t).rlike("county|counties")
    return F.when(~whole, best)


def city_from_address(c: Column) -> Column:
    """The city before a state and ZIP, a state, or a ZIP; else the part after the last comma or dash."""
    t = collapse_ws(c)
    word = r"([A-Z][A-Za-z'.-]*(?: [A-Z][A-Za-z'.-]*){0,3})"
    tries = [
        rf"(?:,|;|\n) ?{word},? (?:CA|Calif\.|California),? \d{{5}}",
        rf"(?:,|;|\n) ?{word},? (?:CA|Calif\.|California)\b",
        rf"(?:,|;|\n) ?{word},? \d{{5}}(?:-\d{{4}})?$",
        rf"^{word},? (?:CA|Calif\.|California)\b",
        rf" - {word}$",
        rf", {word}$",
    ]
    hits = [F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in tries]
    return F.coalesce(*hits)


def is_city_only(c: Column) -> Column:
    """An address field that holds just ``City`` or ``City, ST [ZIP]``."""
    return collapse_ws(c).rlike(r"^[A-Z][A-Za-z'-]*(?: [A-Z][A-Za-z'-]*){0,3},? (?:CA|Calif\.|California)(?: \d{5})?$")
