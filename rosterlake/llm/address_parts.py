"""Postal addresses as parts, and their comparison by affine-gap token alignment."""

from __future__ import annotations

import re
from functools import lru_cache

# Abbreviation dictionaries of street types, directions, name prefixes and unit words.
STREET_TYPES = {
    "street": ("street", "st", "str"), "avenue": ("avenue", "ave", "av", "aven"), "boulevard": ("boulevard", "blvd", "bl", "boul"),
    "circle": ("circle", "cir", "circ"), "court": ("court", "ct", "crt"), "drive": ("drive", "dr", "drv"), "lane": ("lane", "ln"),
    "parkway": ("parkway", "pkwy", "pky", "pkway"), "place": ("place", "pl"), "road": ("road", "rd"),
    "terrace": ("terrace", "ter", "terr"), "way": ("way", "wy"), "trail": ("trail", "trl"), "square": ("square", "sq"),
    "loop": ("loop",), "alley": ("alley", "aly"), "plaza": ("plaza", "plz"),
}
DIRECTIONS = {
    "north": "n", "n": "n", "south": "s", "s": "s", "east": "e", "e": "e", "west": "w", "w": "w",
    "northeast": "ne", "ne": "ne", "northwest": "nw", "nw": "nw", "southeast": "se", "se": "se", "southwest": "sw", "sw": "sw",
}
NAME_PREFIXES = {"mt": "mount", "mount": "mount", "ft": "fort", "fort": "fort", "st": "saint", "saint": "saint"}
CITY_PREFIXES = {"mt": "mount", "ft": "fort", "st": "saint", "pt": "port", "prt": "port", "n": "north", "s": "south", "e": "east", "w": "west"}
UNIT_WORDS = ("ste", "suite", "unit", "apt", "apartment", "room", "rm", "bldg", "building", "floor", "fl", "no")
ORDINAL_WORDS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth",
                 "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth")
STATES = ("ca", "calif", "california")
COUNTRIES = r"\b(?:u\.?s\.?a\.?|united states(?: of america)?)(?=\W|$)"

_TYPE_OF = {a: k for k, v in STREET_TYPES.items() for a in v}
_ORDINAL = {w: str(i + 1) for i, w in enumerate(ORDINAL_WORDS)}
_UNIT = "|".join(UNIT_WORDS)
_ROUTE = re.compile(r"\b(?:state\s+(?:route|rte|hwy|highway|rt)|(?:county|us)\s+(?:road|rd|hwy|highway)|highway|hwy|route|rte|sr)\.?\s*#?\s*(\d{1,4}[a-z]?)\b")
_THOUSANDS = re.compile(r"(?<![\d,])(\d{1,2}),(\d{3})(?=\s+[a-z0-9])")
_UNIT_RE = re.compile(rf"(?:#\s*|\b(?:{_UNIT})\b\.?\s*#?\s*)([a-z]?\d+[a-z]?|[a-z])(?![a-z0-9])")
_VENUE = re.compile(r"\b(?:club|range|hall|center|centre|academy)\b")
_NUMBER = re.compile(r"(?:^|(?<=[\s;]))(\d{1,6})(?=\s+[a-z0-9])")


def osa(a: str, b: str, most: int = 3) -> int:
    """Edit distance with adjacent transpositions; anything above ``most`` is ``most + 1``.

    Only the band of ``most`` cells around the diagonal is computed, so long texts cost O(n)."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    # an edit brings in one new letter at most
    if abs(n - m) > most or len(set(a) - set(b)) > most:
        return most + 1
    far = most + 1
    p2: dict[int, int] = {}
    p1 = {j: j for j in range(min(m, most) + 1)}
    for i in range(1, n + 1):
        x, row = a[i - 1], {}
        lo, hi = max(0, i - most), min(m, i + most)
        if lo == 0:
            row[0] = i
        for j in range(max(1, lo), hi + 1):
            y = b[j - 1]
            v = min(p1.get(j, far) + 1, row.get(j - 1, far) + 1, p1.get(j - 1, far) + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, p2.get(j - 2, far) + 1)
            row[j] = v
        if min(row.values()) > most:
            return far
        p2, p1 = p1, row
    return min(p1.get(m, far), far)


@lru_cache(maxsize=100_000)
def street_type(token: str) -> str | None:
    t = _TYPE_OF.get(token)
    if t or len(token) < 5:
        return t
    near = [k for k in STREET_TYPES if abs(len(k) - len(token)) <= 1 and osa(k, token, 1) <= 1]
    return near[0] if len(near) == 1 else None


def city_key(text: str) -> str:
    """Canonical city: lower case, hyphens and full stops gone, prefixes written out."""
    toks = re.sub(r"[^\w]+", " ", text.lower()).split()
    if toks and toks[0] in CITY_PREFIXES and len(toks) > 1:
        toks[0] = CITY_PREFIXES[toks[0]]
    return " ".join(toks)


def parse(address: str | None, row_cities: tuple[str, ...] = ()) -> tuple | None:
    """``(number, direction, name, type, unit, city, zip5, soft)`` or None without house number and street.

    ``row_cities`` are city keys known from elsewhere; they tell where a name without a type ends.
    ``soft`` says that the city was taken from words after such a name and may belong to the name.
    Missing parts are empty strings. The name of a numbered street is its number, of a route ``hwy N``."""
    if not address:
        return None
    s = re.sub(r"\([^)]*\)", " ; ", address.lower().replace(" ", " "))
    s = re.sub(COUNTRIES, " ", s)
    s = _THOUSANDS.sub(r"\1\2", s)
    s = re.sub(r"[\r\n]+|\s-\s|@", " ; ", s)
    s = _ROUTE.sub(r"hwy\1", s)
    s = re.sub(r"\bno\b\.?\s+(?=[a-z]{2})", "n ", s)
    unit = ""
    if m := _UNIT_RE.search(s):
        unit = m.group(1)
        s = s[:m.start()] + " ; " + s[m.end():]
    s = re.sub(r"[,;|]+", " ; ", s).replace(".", " ")
    s = re.sub(r"\s+", " ", s).strip()
    zip5 = ""
    number, street_at, spare = "", -1, None
    for m in _NUMBER.finditer(s):
        before = s[:m.start()].rsplit(None, 1)[-1:] or [""]
        after = s[m.end():].split(None, 1)[0]
        if after.isdigit() or after == ";":
            continue
        if len(m.group(1)) == 5 and before[0] in STATES:
            spare = spare or m
            continue
        number, street_at = m.group(1), m.end()
        head = s[:m.start()]
        break
    if not number and spare:
        number, street_at, head = spare.group(1), spare.end(), s[:spare.start()]
    if not number:
        return None
    rest = s[street_at:].strip()
    for text in (rest, head):
        zs = re.findall(r"(?<![\w-])(\d{5})(?:-\d{4})?(?![\w-])", text)
        if zs:
            zip5 = zs[-1]
            break
    rest = re.sub(r"(?<![\w-])\d{5}(?:-\d{4})?(?![\w-])", " ; ", rest)
    head = re.sub(r"(?<![\w-])\d{5}(?:-\d{4})?(?![\w-])", " ; ", head)
    state = rf"\b(?:{'|'.join(STATES)})\b"
    rest, head = re.sub(state, " ; ", rest), re.sub(state, " ; ", head)
    segs = [x.strip() for x in rest.split(";") if x.strip()]
    if not segs:
        return None
    toks = segs[0].split()
    direction = ""
    if len(toks) > 1 and toks[0] in DIRECTIONS and street_type(toks[1]) is None or len(toks) > 2 and toks[0] in DIRECTIONS:
        direction = DIRECTIONS[toks.pop(0)]
    name: list[str] = []
    if len(toks) > 1 and toks[0] in NAME_PREFIXES and (street_type(toks[1]) is None or toks[0] not in _TYPE_OF):
        name.append(NAME_PREFIXES[toks.pop(0)])
    kind, tail, soft = "", [], False
    at = next((i for i, t in enumerate(toks) if i and street_type(t)), None)
    if at is None and toks and street_type(toks[0]) and name:
        at = 0
    if at is not None and at <= 3:
        name += toks[:at]
        kind, tail = street_type(toks[at]), toks[at + 1:]
    elif toks and (toks[0].startswith("hwy") or re.fullmatch(r"\d+(?:st|nd|rd|th)", toks[0])):
        name += toks[:1]
        tail = toks[1:]
    else:
        # no type: the name ends before a known city, at a direction, or with the segment if a city stands elsewhere
        cut = next((i for i, t in enumerate(toks) if i and t in DIRECTIONS), None)
        if cut is None:
            cut = next((i for i in range(max(1, len(toks) - 6), len(toks)) if city_key(" ".join(toks[i:])) in row_cities), None)
        if cut is None:
            cut = next((i for i in range(max(1, len(toks) - 6), len(toks)) if any(near_city(city_key(" ".join(toks[i:])), c) for c in row_cities)), None)
        if cut is None:
            elsewhere = len(segs) > 1 or any(x.strip() and not _VENUE.search(x) for x in head.split(";"))
            cut = len(toks) if elsewhere else 1
            soft = cut < len(toks)
        name += toks[:cut]
        tail = toks[cut:]
    if tail and tail[0] in DIRECTIONS and not direction:
        direction = DIRECTIONS[tail.pop(0)]
    if not name:
        return None
    if len(name) == 1 and (m := re.fullmatch(r"(\d+)(?:st|nd|rd|th)", name[0])):
        street = "#" + m.group(1)
    elif len(name) == 1 and name[0] in _ORDINAL:
        street = "#" + _ORDINAL[name[0]]
    else:
        street = "".join(name)
    cities = ([" ".join(tail)] if tail else []) + segs[1:]
    if not cities:
        cities = [x.strip() for x in head.split(";") if x.strip()][-1:]
    cities = [c for c in cities if not _VENUE.search(c)]
    city = city_key(cities[0]) if cities else ""
    if city.isdigit():
        city = ""
    return number.lstrip("0"), direction, street, kind, unit, city, zip5, soft


def near_words(a: str, b: str) -> bool:
    """Two spellings of one name: few edits for the length."""
    if a == b:
        return True
    if not a or not b or a[0] == "#" or b[0] == "#" or a.startswith("hwy") or b.startswith("hwy"):
        return False
    most = 1 if min(len(a), len(b)) < 6 else 2
    return osa(a, b, most) <= most


def near_city(a: str, b: str) -> bool:
    """Two spellings of one city: up to two edits, one in short names."""
    if a == b:
        return True
    x, y = a.replace(" ", ""), b.replace(" ", "")
    most = 1 if min(len(x), len(y)) < 6 else 2
    return osa(x, y, most) <= most


#: Marks a city that is no known spelling; only such a city may be near another.
UNKNOWN_CITY = "~"


GAP_OPEN, GAP_EXTEND, CLASH = 0.4, 0.1, 4.0
#: Alignments up to this cost denote one place: below a clash, above all gaps and typos that may come together.
MOST_COST = 3.0


def align(a: list[tuple[str, str]], b: list[tuple[str, str]], substitution) -> float:
    """Cost of the best global alignment of two token sequences with affine gaps. Leaving out a token is
    a gap only if the other sequence lacks its kind; otherwise it would hide a contradiction and costs CLASH."""
    inf = float("inf")
    n, m = len(a), len(b)
    in_a, in_b = {k for k, _ in a}, {k for k, _ in b}
    best = [[inf] * (m + 1) for _ in range(n + 1)]
    up = [[inf] * (m + 1) for _ in range(n + 1)]
    left = [[inf] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            if i:
                hidden = CLASH if a[i - 1][0] in in_b else 0.0
                up[i][j] = min(best[i - 1][j] + GAP_OPEN, up[i - 1][j] + GAP_EXTEND) + hidden
            if j:
                hidden = CLASH if b[j - 1][0] in in_a else 0.0
                left[i][j] = min(best[i][j - 1] + GAP_OPEN, left[i][j - 1] + GAP_EXTEND) + hidden
            if i and j:
                best[i][j] = min(best[i][j], best[i - 1][j - 1] + substitution(a[i - 1], b[j - 1]))
            best[i][j] = min(best[i][j], up[i][j], left[i][j])
    return best[n][m]


def substitution(x: tuple[str, str], y: tuple[str, str]) -> float:
    """0 for tokens equal or equal by the abbreviation dictionaries, 0.2 an edit in a name or an unknown
    city, CLASH for a token of the same kind that says something else, infinite across kinds."""
    if x[0] != y[0]:
        return float("inf")
    p, q = x[1], y[1]
    if p == q:
        return 0.0
    if x[0] == "type" and (street_type(p) or p) == (street_type(q) or q) or x[0] == "dir" and DIRECTIONS.get(p, p) == DIRECTIONS.get(q, q):
        return 0.0
    if x[0] == "name" and near_words(p, q):
        return 0.2 * osa(p, q)
    if x[0] == "city" and UNKNOWN_CITY in (p[:1], q[:1]) and near_city(p.lstrip(UNKNOWN_CITY), q.lstrip(UNKNOWN_CITY)):
        return 0.2
    return CLASH


PARTS = ("number", "dir", "name", "type", "unit", "city")


@lru_cache(maxsize=100_000)
def _align_cost(kinds_a: tuple, kinds_b: tuple, costs: tuple) -> float:
    """Alignment by which parts are given and what substituting each shared part costs."""
    of = dict(costs)
    sub = lambda x, y: of[x[0]] if x[0] == y[0] else float("inf")
    return align([(k, "") for k in kinds_a], [(k, "") for k in kinds_b], sub)


def same_place(a: tuple, b: tuple) -> bool:
    """Whether two parsed addresses (number, dir, name, type, unit, cities) denote one location: whether
    the alignment of their tokens costs no more than MOST_COST. ``cities`` holds one or more city keys,
    any of which may match."""
    costs = []
    for k, p, q in zip(PARTS, a, b):
        if p and q:
            costs.append((k, min(substitution((k, x), (k, y)) for x in p for y in q) if k == "city" else substitution((k, p), (k, q))))
    ka, kb = tuple(k for k, v in zip(PARTS, a) if v), tuple(k for k, v in zip(PARTS, b) if v)
    return _align_cost(ka, kb, tuple(costs)) <= MOST_COST
