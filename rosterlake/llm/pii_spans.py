"""Candidate spans of personal information in a text, with the context a model judges them by."""

from __future__ import annotations

import re
from bisect import bisect_left, insort

from rosterlake.llm.address_parts import CITY_PREFIXES, DIRECTIONS, NAME_PREFIXES, STREET_TYPES, UNIT_WORDS
from rosterlake.llm.name_parts import NICKNAMES, TITLES, TRADE_WORDS, plain

LABELS = ("O", "email", "phone", "id_number", "address", "person_name")
#: Given names that are known beforehand; the corpus adds its own (``p10_pii.lexicon``).
GIVEN = frozenset(NICKNAMES) | frozenset(s for v in NICKNAMES.values() for s in v.split())
# Words of titles in English and Spanish.
TITLE_WORDS = set(TITLES) | {"instructor", "instructora", "sheriff", "sr", "sra", "srta"}

_AT = r"(?:\s?@\s?|\s?[\[({]\s?at\s?[\])}]\s?)"
_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?)"
EMAIL = re.compile(rf"(?<![A-Za-z0-9_%+\-])[A-Za-z0-9](?:[A-Za-z0-9_%+\-]|\.(?=[A-Za-z0-9]))*{_AT}[A-Za-z0-9\-]+(?:{_DOT}[A-Za-z0-9\-]+)+|(?<![a-z0-9._+\-])[a-z0-9][a-z0-9._+\-]*\sat\s[a-z0-9\-]+(?:\sdot\s[a-z0-9\-]+)+", re.I)
PHONE = re.compile(r"(?<![\w/.\-–$])(?<!\d\s)(?:\+?1[\s.\-–]?)?(?:\(\d{3}\)\s?|\d{3}[\s.\-–/])\d{3}[\s.\-–/]\d{4}(?![\w\-–/])|(?<![\w/.\-–$])(?:\+?1[\s.\-–]?)?(?:\(\d{3}\)\s?)?\d{7,10}(?![\w\-–/])|(?<![\w/.\-–$])\+1\d{10}(?!\w)")
ID = re.compile(r"(?<![\w/\-–$.])(?:\d{3}[\-. –]\d{2}[\-. –]\d{4}|\d{9}|[A-Z][ \-]?\d{7,8}|[A-Z]{2,4}[ \-]?(?:\d{2,4}-)?\d{4,6}(?:-\d{2,6})?|\d{4}-\d{4,6}|\d{2}/\d{6}|\d{6})(?![\w\-–/])")

_TYPES = "|".join(sorted({a for v in STREET_TYPES.values() for a in v}, key=len, reverse=True))
_DIR = r"(?:North|South|East|West|N|S|E|W)\b\.?"
_NAME = r"[^\W\d_][\w'’]+"
_UNIT = rf"(?:[,;]?\s*(?:\#\s?|\b(?:{'|'.join(UNIT_WORDS)})\b\.?\s?\#?\s?)(?:[A-Z]?\d+[A-Z]?|[A-Z])(?![\w]))"
_STATE = r"(?:California|Calif\b\.?|CA\b)"
_WRITTEN_OUT = set(STREET_TYPES) | {"north", "south", "east", "west", "california"}
_ORDINALS = "First|Second|Third|Fourth|Fifth|Sixth|Seventh|Eighth|Ninth|Tenth|Eleventh|Twelfth"
_STREET = (rf"(?:(?:State\s+(?:Route|Hwy\.?|Highway)|SR|Hwy\.?|Highway|Route)\s+\d{{1,3}}"
           rf"|(?:{_DIR}\s+)?(?:\d{{1,3}}(?:st|nd|rd|th)|{_ORDINALS})\s+(?:{_TYPES})\b\.?"
           rf"|(?:{_DIR}\s+)?(?:(?:Mt|Mount|Saint|St|Ft|Fort)\b\.?\s+)?{_NAME}(?:\s+{_NAME})?\s+(?:{_TYPES})\b\.?)(?:\s+{_DIR}(?!\w))?")
_CITY_HEAD = r"(?:(?:New|Port|Los|Rancho|Las|San|Santa|El|La|North|South|East|West|Mount|Fort|Saint|St\.?|Mt\.?|Ft\.?)\s+)?"
_CITY = rf"{_CITY_HEAD}(?P<stem>{_NAME})(?:\s+Springs|-by-the-Sea)?"
ADDRESS = re.compile(rf"(?<![\w#$/.\-,])(?:(?:\d{{1,2}},\d{{3}}|\d{{2,6}})\s+|\d[  ]+)(?P<street>{_STREET})(?P<unit>{_UNIT})?", re.I)
_CITY_AFTER = re.compile(rf"(?P<sep>[,;]?\s*(?:-\s)?){_CITY}(?:(?P<state>,?\s*{_STATE})(?P<zip>,?\s*\d{{5}}(?:-\d{{4}})?(?!\d))?|(?P<zip2>,?\s*\d{{5}}(?:-\d{{4}})?(?!\d)))?(?P<unit2>{_UNIT})?", re.I)
_STATE_AFTER = re.compile(rf",?\s*(?:{_STATE})(?:,?\s*\d{{5}}(?:-\d{{4}})?(?!\d))?|,?\s*9\d{{4}}(?:-\d{{4}})?(?!\d)", re.I)
_TOKEN = re.compile(r"[^\W\d_](?:[\w'’]|-(?=[^\W\d_]))*\.?|\d[\w.,/\-]*|[^\w\s]")
_STEM = re.compile(rf"(?:,|\n|\s)\s*{_CITY_HEAD}({_NAME})(?:\s+Springs|-by-the-Sea)?,?\s+{_STATE}", re.I)
_CAP = re.compile(r"(?<![\w])[^\W\d_a-zà-ÿ][\w'’\-]+")


_AHEAD = re.compile(r"(?=(?<![\w'’\-])([^\W\d_a-zà-ÿ][^\W\d_'’\-]+)(?: [^\W\d_a-zà-ÿ]\.?)? ([^\W\d_a-zà-ÿ][\w'’\-]+))")
_TITLED = re.compile(rf"(?<![\w'’\-])((?i:{'|'.join(sorted(TITLE_WORDS, key=len, reverse=True))}))\.? ([^\W\d_a-zà-ÿ][\w'’\-]+)")
#: Words that stand before capitalised words without being given names.
NOT_GIVEN = frozenset(TITLE_WORDS) | frozenset(DIRECTIONS) | frozenset(NAME_PREFIXES) | frozenset(CITY_PREFIXES)


def lexicon_counts(texts) -> dict[tuple[str, str, str], int]:
    """How many of the texts have each capitalised word (``cap``) and each city stem before a state (``stem``);
    how often a capitalised word occurs (``occ``), is followed by a certain other one (``pair``) and follows
    a certain title (``titled``)."""
    out: dict[tuple[str, str, str], int] = {}
    for t in texts:
        if not t:
            continue
        caps = [w.lower() for w in _CAP.findall(t)]
        for k in {("cap", w, "") for w in caps} | {("stem", w.lower(), "") for w in _STEM.findall(t)}:
            out[k] = out.get(k, 0) + 1
        for k in [("occ", w, "") for w in caps] + [("pair", w.lower(), f.lower()) for w, f in _AHEAD.findall(t)] + [("titled", w.lower(), f.lower()) for w, f in _TITLED.findall(t)]:
            out[k] = out.get(k, 0) + 1
    return out


class Lexicon:
    """What is known about words from all texts: city stems, given names, and words too common for a family name."""

    def __init__(self, stems: set[str], given: set[str], common: set[str]):
        self.stems, self.given, self.common = stems, given, common

    def is_given(self, word: str) -> bool:
        return plain(word) in GIVEN or word.lower() in self.given


def _initial(w: str) -> bool:
    return len(w.rstrip(".")) == 1 and w[0].isalpha() and w[0].isupper()


def names(text: str, taken: list[tuple[int, int]], lex: Lexicon) -> list[tuple[int, int, str]]:
    """Spans of names of people: (start, end, form)."""
    toks = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
    out, used = [], -1
    busy = iter(sorted(taken))
    cur = next(busy, None)
    n = len(toks)
    common, _given = lex.common, lex.is_given

    def family(i: int) -> bool:
        if i >= n:
            return False
        w = toks[i][0]
        bare = w.rstrip(".")
        return len(bare) > 2 and bare[0].isupper() and bare[0].isalpha() and bare.lower() not in common and plain(bare) not in TRADE_WORDS

    def near(i: int) -> bool:  # token i+1 follows token i on the same line
        return i + 1 < n and "\n" not in text[toks[i][2]:toks[i + 1][1]] and toks[i + 1][1] - toks[i][2] <= 2

    def close(i: int, start: int, form: str) -> int:
        end = toks[i][2]
        if text[end - 1] == "." and not _initial(toks[i][0]):
            end -= 1
        if text[start:end].endswith(("'s", "’s")):
            end -= 2
        out.append((start, end, form))
        return i

    for i in range(n):
        w, s, e = toks[i]
        while cur and cur[1] <= s:
            cur = next(busy, None)
        if i <= used or (cur and cur[0] <= s < cur[1]) or not w[0].isalpha() or not w[0].isupper():
            continue
        bare = w.rstrip(".")
        if len(bare) > 1 and _given(bare):
            j = i
            stop = w.endswith(".") and len(bare) > 3  # the sentence ends here
            while not stop and near(j) and _initial(toks[j + 1][0]) and j - i < 2:
                j += 1
            full = not stop and near(j) and family(j + 1) and not text[toks[j][2]:toks[j + 1][1]].strip()
            prev = i >= 2 and toks[i - 1][0] == "," and i - 2 > used and family(i - 2) and near(i - 2) and not (i >= 3 and _given(toks[i - 3][0].rstrip(".")))
            if full:
                used = close(j + 1, s, "given family")
            elif prev:
                used = close(j, toks[i - 2][1], "family, given")
        elif _initial(w) and w.endswith(".") or (_initial(w) and near(i) and family(i + 1) and i and toks[i - 1][0] not in (",",)):
            j = i
            while near(j) and _initial(toks[j + 1][0]) and toks[j + 1][0].endswith(".") and j - i < 2:
                j += 1
            if w.endswith(".") and near(j) and family(j + 1) and not (i and toks[i - 1][2] == s):
                used = close(j + 1, s, "initial family")
            elif w.endswith(".") and i >= 2 and toks[i - 1][0] == "," and i - 2 > used and family(i - 2):
                used = close(j, toks[i - 2][1], "family, initial")
        elif bare.lower() in TITLE_WORDS and near(i) and family(i + 1) and not _given(toks[i + 1][0].rstrip(".")):
            if near(i + 1) and toks[i + 2][0] == "," and i + 3 < n and (_given(toks[i + 3][0].rstrip(".")) or _initial(toks[i + 3][0])) and near(i + 2):
                j = i + 3
                while near(j) and _initial(toks[j + 1][0]):
                    j += 1
                used = close(j, toks[i + 1][1], "family, given")
            else:  # after a title an unknown given name and a family name, or a family name alone
                both = near(i + 1) and not toks[i + 1][0].endswith(".") and not text[toks[i + 1][2]:toks[i + 2][1]].strip() and family(i + 2)
                used = close(i + 2 if both else i + 1, toks[i + 1][1], "title family")
    return out


def addresses(text: str, lex: Lexicon) -> list[tuple[int, int]]:
    out, stems, common = [], lex.stems, lex.common
    for m in ADDRESS.finditer(text):
        if out and m.start() < out[-1][1]:
            continue
        street = m.group("street")
        if not street[0].isupper() and not street[0].isdigit() and not street.split()[0].rstrip(".").lower() in ("n", "s", "e", "w"):
            continue
        if any(w.isalpha() and w[0].islower() for w in street.split()[:-1]):
            continue
        end = m.end()
        c = _CITY_AFTER.match(text, end)
        if c:
            stem = c.group("stem").lower()
            known = stem in stems
            if c.group("zip") or c.group("state") and (known or stem not in common) or known or c.group("zip2") and stem not in common and c.group("stem")[0].isupper():
                tail = c.end()
                if not c.group("stem")[0].isupper() and not known:
                    tail = end
                end = tail
            elif z := _STATE_AFTER.match(text, end):
                end = z.end()
        elif z := _STATE_AFTER.match(text, end):
            end = z.end()
        # a full stop belongs to an abbreviation, not to a word written out
        last = re.search(r"(\w+)\.$", text[m.start():end])
        if last and last.group(1).lower() in _WRITTEN_OUT:
            end -= 1
        out.append((m.start(), end))
    return out


def candidates(text: str, lex: Lexicon) -> list[tuple[int, int, str]]:
    """Non-overlapping candidate spans (start, end, matcher), in order."""
    spans: list[tuple[int, int, str]] = []
    if "@" in text or "at" in text:
        spans += [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    taken = sorted((a, b) for a, b, _ in spans)

    def free(a: int, b: int) -> bool:  # the spans taken don't overlap, so only the neighbours count
        i = bisect_left(taken, (a, a))
        return (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b)

    for a, b in addresses(text, lex):
        if free(a, b):
            spans.append((a, b, "address"))
            insort(taken, (a, b))
    for m in PHONE.finditer(text):
        digits = re.sub(r"\D", "", m.group())
        if len(digits) in (10, 11) and free(*m.span()):
            spans.append((*m.span(), "phone"))
            insort(taken, m.span())
    for m in ID.finditer(text):
        if free(*m.span()):
            g = m.group()
            if re.match(r"(?:CA|SR|US)\b", g):
                continue
            d = re.sub(r"\D", "", g)
            kind = "ssn" if len(d) == 9 and g[0].isdigit() else "licence" if re.fullmatch(r"[A-Z][ \-]?\d{7}", g) else "permit8" if re.fullmatch(r"P\d{8}", g) else \
                "permit/" if "/" in g else "code " + re.match(r"[A-Z]*", g).group()
            spans.append((*m.span(), kind))
            insort(taken, m.span())
    spans += names(text, taken, lex)
    return sorted(spans)


_WORD = re.compile(r"[^\W\d_]+|[^\w\s]|\d+")


def context(text: str, a: int, b: int, width: int = 48) -> tuple[list[str], list[str]]:
    """The words before (nearest first) and after a span, lower-cased, numbers masked."""
    norm = lambda w: "9" if w[0].isdigit() else w.lower()
    left = [norm(w) for w in _WORD.findall(text[max(0, a - width):a])][::-1][:5]
    right = [norm(w) for w in _WORD.findall(text[b:b + width])][:3]
    return left, right


def link_key(text: str, a: int, b: int, kind: str) -> str:
    """What repeated or similar spans of one document share: digits, or the longest word."""
    s = text[a:b]
    if kind in ("given family", "family, given", "initial family", "title family", "family, initial"):
        return max(re.findall(r"[^\W\d_]+", plain(s)), key=len, default="")
    d = re.sub(r"\D", "", s)
    return d if len(d) > 5 else plain(s)
