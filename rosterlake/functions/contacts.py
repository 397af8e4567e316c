"""E-mails, phones, URLs and hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterlake.functions.text import strip_ws

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\(?[0-9]{3}\)?[-. ]?[0-9]{3}[-. ]?[0-9]{4}"


def emails(c: Column) -> Column:
    """All addresses, lower-cased, distinct in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(f"({EMAIL})"), F.lit(1)), F.lower))


def phones(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(f"({PHONE})"), F.lit(1)), lambda x: F.trim(x)))


def phone_digits(c: Column) -> Column:
    """Digits only; the leading 1 of eleven is dropped."""
    d = F.regexp_replace(c, r"[^0-9]", "")
    return F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)


def _dashed(d: Column) -> Column:
    return F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 4))


# A number of the North American plan (area and exchange begin with 2 to 9), an extension at the end.
NANP = r"(?:\+?1[-.\s]*)?\(?([2-9][0-9]{2})\)?[-.\s]*([2-9][0-9]{2})[-.\s]*([0-9]{4})\b"
EXTENSION = r"(?i)\s*[,;]?\s*(?:extension|ext\.?|x)\s*:?\s*([0-9]{1,8})\s*$"


def nanp(c: Column) -> Column:
    """All numbers of a field as NPA-NXX-XXXX joined by ``" / "``, repeats kept, an extension as ``ext. N``.

    Ladder: twenty digits without a break (two numbers, both kept); formatted numbers; else, of the digits,
    eleven with a leading 1, twenty or ten with valid area and exchange; else the field without outer white space."""
    text = strip_ws(c)
    ext = F.regexp_extract(text, EXTENSION, 1)
    body = strip_ws(F.regexp_replace(text, EXTENSION, ""))
    found = F.transform(F.regexp_extract_all(body, F.lit(f"({NANP})"), F.lit(1)), lambda p: _dashed(F.right(F.regexp_replace(p, "[^0-9]", ""), F.lit(10))))
    d = F.regexp_replace(body, "[^0-9]", "")
    d = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    one = r"[2-9][0-9]{2}[2-9][0-9]{6}"
    main = (
        F.when((F.size(found) > 0) & ~body.rlike(f"^{one}{one}$"), F.array_join(found, " / "))
        .when(d.rlike(f"^{one}{one}$"), F.concat(_dashed(F.substring(d, 1, 10)), F.lit(" / "), _dashed(F.substring(d, 11, 10))))
        .when(d.rlike(f"^{one}$"), _dashed(d))
    )
    return F.when(main.isNull(), text).when(ext != "", F.concat(main, F.lit(" ext. "), ext)).otherwise(main)


def phone_well_formed(c: Column) -> Column:
    """Every number of a normalised field is NPA-NXX-XXXX, an extension at the end allowed; blank is well formed."""
    core = F.regexp_replace(strip_ws(c), r"(?i)\s+ext\.\s*[0-9]{1,8}\s*$", "")
    return F.forall(F.filter(F.transform(F.split(core, " / "), strip_ws), lambda s: s != ""), lambda s: s.rlike(r"^[2-9][0-9]{2}-[0-9]{3}-[0-9]{4}$"))


def website(c: Column) -> Column:
    """Canonical URL: https, lower-case host, no slash at the end of the path; query and fragment stay."""
    t = strip_ws(c)
    bare = F.regexp_replace(t, r"^(?i)[a-z][a-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?#]*([^?#]*)", 1), r"/+$", "")
    rest = F.regexp_extract(bare, r"^[^?#]*(.*)$", 1)
    return F.when(t != "", F.concat(F.lit("https://"), host, path, rest))


def host(c: Column, strip_www: bool = True) -> Column:
    """Lower-case host without user, port and a leading ``www.``; null if there is none."""
    bare = F.regexp_replace(F.lower(strip_ws(c)), r"^[a-z][a-z0-9+.-]*://", "")
    h = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^([^/?#]*)", 1), r"^.*@", ""), r":[0-9]*$", "")
    h = F.regexp_replace(h, r"^www\.", "") if strip_www else h
    return F.when(h != "", h)


def index_url(c: Column) -> Column:
    """Form for index matching: lower case, no query or fragment, no final slash, ``www.`` forced."""
    t = F.regexp_replace(F.regexp_replace(F.lower(strip_ws(c)), r"[?#].*$", ""), r"/+$", "")
    return F.regexp_replace(t, r"^([a-z]+://)(?:www\.)?", "$1www.")


def url_problem(c: Column) -> Column:
    """Why a URL can't be used: missing, spaces, scheme, host; null if it can."""
    t = strip_ws(c)
    return (
        F.when(t.isNull() | (t == ""), "missing").when(t.rlike(r"\s"), "spaces").when(~F.lower(t).rlike(r"^https?://"), "scheme")
        .when(~F.lower(t).rlike(r"^https?://[^/?#\s]*[a-z0-9]"), "host")
    )


def host_suffixes(h: Column) -> Column:
    """A host and all its parent domains, for an equi-join with a list of domains."""
    parts = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def is_private_ipv4(c: Column) -> Column:
    """Loopback, link-local, private and unspecified IPv4 addresses; null for anything else."""
    p = F.transform(F.split(c, r"\."), lambda x: x.try_cast("int"))
    valid = (F.size(p) == 4) & F.forall(p, lambda x: F.coalesce((x >= 0) & (x <= 255), F.lit(False)))
    a, b = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    private = a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
    return F.when(valid, private)


def is_private_address(c: Column) -> Column:
    """As ``is_private_ipv4``, and for IPv6: loopback, unique local (fc, fd), link-local (fe80) and
    addresses that map a private IPv4 one; null for anything that is neither."""
    t = F.lower(strip_ws(c))
    mapped = F.regexp_extract(t, r"^::ffff:([0-9.]+)$", 1)
    six = t.rlike(r"^[0-9a-f:]*:[0-9a-f:]*$")
    return (
        F.when(mapped != "", is_private_ipv4(mapped)).when(t == "::1", F.lit(True))
        .when(six, t.rlike("^f[cd]") | t.startswith("fe80:")).otherwise(is_private_ipv4(t))
    )
