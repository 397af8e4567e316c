"""Names of people and organisations as tokens, and their comparison by optimal assignment."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import combinations

from rosterlake.llm.address_parts import osa

INF = float("inf")
# The letter rows of the keyboard, each set off to the right by what it is shifted.
KEY_ROWS = (("qwertyuiop", 0.0), ("asdfghjkl", 0.25), ("zxcvbnm", 0.75))

# Common short forms of given names.
NICKNAMES = {
    "alexandra": "alex sandra lexi", "andrew": "andy drew", "anthony": "tony", "barbara": "barb barbie", "benjamin": "ben benny",
    "charles": "charlie chuck", "christine": "chris tina chrissy", "christopher": "chris topher", "cynthia": "cindy", "daniel": "dan danny",
    "deborah": "deb debbie", "edward": "ed eddie ted ned", "elizabeth": "liz beth betsy betty lisa", "francisco": "frank paco pancho",
    "frederick": "fred freddy", "gregory": "greg", "guadalupe": "lupe", "jacqueline": "jackie", "james": "jim jimmy jamie",
    "jeffrey": "jeff", "jennifer": "jen jenny", "jonathan": "jon", "john": "jack johnny", "jose": "pepe", "joseph": "joe joey",
    "judith": "judy", "katherine": "kate katie kathy kat", "kenneth": "ken kenny", "lawrence": "larry", "marcus": "marc mark",
    "margaret": "maggie meg peggy", "matthew": "matt", "michael": "mike mick mickey", "nicholas": "nick", "pamela": "pam",
    "patricia": "pat patty trish", "patrick": "pat", "ramon": "moncho", "raymond": "ray", "rebecca": "becky", "richard": "rich rick dick",
    "robert": "rob bob bobby", "ronald": "ron ronnie", "samuel": "sam sammy", "stephanie": "steph", "steven": "steve", "susan": "sue suzy",
    "theodore": "theo ted", "thomas": "tom tommy", "timothy": "tim", "victoria": "vicky vicki", "william": "will bill billy",
}
# Titles, suffixes and texts that name nobody.
TITLES = ("mr", "mrs", "ms", "miss", "dr", "sgt", "lt", "capt", "cpl", "det", "dep", "deputy", "ofc", "officer", "prof", "rev", "sergeant", "lieutenant", "captain", "coach")
SUFFIXES = ("jr", "sr", "ii", "iii", "iv")
NOBODY = ("", "tbd", "tba", "various", "staff", "n a", "na", "none", "unknown", "multiple", "private instructor", "private", "instructor", "instructors", "see website", "various instructors")
# Words of the trade that don't tell organisations apart, and legal forms.
TRADE_WORDS = ("academy", "arms", "carry", "ccw", "center", "centre", "class", "classes", "club", "consulting", "defense", "defence", "defensive", "firearm",
               "firearms", "group", "gun", "institute", "instruction", "instructor", "marksmanship", "personal", "pistol", "protection", "protective",
               "range", "safety", "school", "security", "self", "services", "service", "shooting", "sporting", "tactical", "tactics", "training", "concealed", "weapons")
LEGAL = ("llc", "inc", "co", "corp", "ltd", "lp", "company", "incorporated", "corporation", "limited")
# Short forms of words of the trade, and words that stand for each other.
SHORT_TRADE = {
    "acad": "academy", "acdmy": "academy", "aca": "academy", "cls": "class", "ctr": "center", "cntr": "center", "def": "defense", "frms": "firearms", "fa": "firearms",
    "grp": "group", "gp": "group", "inst": "institute", "instr": "instruction", "instrs": "instruction", "mrksmnshp": "marksmanship", "marks": "marksmanship",
    "marksman": "marksmanship", "pers": "personal", "pist": "pistol", "pstl": "pistol", "prot": "protection", "protect": "protection", "rng": "range", "sch": "school",
    "schl": "school", "sec": "security", "secur": "security", "sft": "safety", "sfty": "safety", "shoot": "shooting", "shtg": "shooting", "svc": "services",
    "svcs": "services", "tac": "tactical", "tact": "tactical", "train": "training", "trg": "training", "trng": "training", "sport": "sporting", "consult": "consulting",
    "cons": "consulting", "conslt": "consulting", "clb": "club", "cl": "class",
}
SAME_TRADE = {"centre": "center", "classes": "class", "defence": "defense", "defensive": "defense", "firearm": "firearms", "instructor": "instruction", "protective": "protection",
              "service": "services", "tactics": "tactical", "weapons": "ccw", "concealed": "ccw"}

_CANON: dict[str, set[str]] = {}
for _full, _shorts in NICKNAMES.items():
    _CANON.setdefault(_full, set()).add(_full)
    for _s in _shorts.split():
        _CANON.setdefault(_s, set()).add(_full)


def plain(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


_KEY_AT = {c: (r, i + shift) for r, (letters, shift) in enumerate(KEY_ROWS) for i, c in enumerate(letters)}


@lru_cache(maxsize=1_000)
def neighbour_keys(x: str, y: str) -> bool:
    """Whether two letters lie next to each other on the keyboard."""
    p, q = _KEY_AT.get(x), _KEY_AT.get(y)
    return bool(p and q) and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1.3


def letters(word: str) -> int:
    """The set of a word's letters as bits."""
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 63)
    return out


@lru_cache(maxsize=500_000)
def typo_cost(a: str, b: str, most: int = 2) -> int:
    """What it takes to mistype ``a`` as ``b``: 1 for a lost or added letter, two swapped letters or a
    neighbouring key, 2 for any other letter; ``most + 1`` above ``most``."""
    x, y = letters(a), letters(b)
    if (x & ~y).bit_count() > most or (y & ~x).bit_count() > most or osa(a, b, most) > most:
        return most + 1
    n, m = len(a), len(b)
    far = most + 1
    p2: list[int] = []
    p1 = list(range(m + 1))
    for i in range(1, n + 1):
        row = [i] + [far] * m
        for j in range(max(1, i - most), min(m, i + most) + 1):
            x, y = a[i - 1], b[j - 1]
            v = min(p1[j] + 1, row[j - 1] + 1, p1[j - 1] + (0 if x == y else 1 if neighbour_keys(x, y) else 2))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, p2[j - 2] + 1)
            row[j] = v
        p2, p1 = p1, row
    return min(p1[m], far)


def assignment(cost: list[list[float]]) -> tuple[float, list[int]]:
    """Optimal assignment of n rows to m >= n columns (Hungarian method, O(n m n)): the total and the
    column of each row. Impossible pairs cost a large finite number."""
    n = len(cost)
    m = len(cost[0]) if n else 0
    u, v, who, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        who[0], j0 = i, 0
        least, used = [INF] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = who[j0], INF, 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[who[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if who[j0] == 0:
                break
        while j0:
            who[j0], j0 = who[way[j0]], way[j0]
    col = [0] * n
    for j in range(1, m + 1):
        if who[j]:
            col[who[j] - 1] = j - 1
    return sum(cost[i][col[i]] for i in range(n)), col


def parse_person(text: str | None) -> tuple[str, tuple[str, ...]] | None:
    """``(family, given names)`` with the given names in order, each a word or an initial. None names nobody."""
    if not text:
        return None
    s = plain(text)
    s = re.sub(r"\(ret\.?\)|\s-\s+\w+\b", " ", s)
    s = re.sub(rf",?\s*\b(?:{'|'.join(SUFFIXES)})\b\.?", " ", s)
    s = re.sub(rf"^\s*(?:(?:{'|'.join(TITLES)})\b\.?\s+)+", "", s)
    inverted = re.match(r"^\s*([^\W\d_][\w'’\-]+)\s*,\s*(\S.*)$", s)
    if inverted:
        s = f"{inverted.group(2)} {inverted.group(1)}"
    s = re.sub(r"['’]", "", s)
    toks = re.findall(r"[^\W\d_]+", s)
    while len(toks) > 1 and toks[0] in TITLES:
        toks.pop(0)
    if " ".join(toks) in NOBODY or len(toks) < 2 or len(toks[-1]) < 2:
        return None
    return toks[-1], tuple(toks[:-1])


@lru_cache(maxsize=200_000)
def given_cost(a: str, b: str) -> float:
    """What it costs to call two given names one: 0 equal, 0.1 a short form, 0.4 an initial (of the name
    or of what it is short for), 1 or 2 a typo of either; infinite otherwise."""
    if a == b:
        return 0.0
    if len(a) == 1 or len(b) == 1:
        short, long = (a, b) if len(a) == 1 else (b, a)
        starts = {long[0]} | {c[0] for c in _CANON.get(long, ())}
        return 0.4 if len(long) > 1 and short in starts else INF
    ca, cb = _CANON.get(a), _CANON.get(b)
    if ca and cb:
        return 0.1 if ca & cb else INF
    most = 1 if min(len(a), len(b)) < 7 else 2
    c = typo_cost(a, b, most)
    if c <= most:
        return float(c)
    # a misspelt short form
    for known, other in ((ca, b), (cb, a)):
        if known and any(typo_cost(k, other, 1) <= 1 for k in known if len(k) > 3):
            return 1.1
    return INF


#: Cost of a given name that one of two mentions leaves out, and of a first name called by as a second one.
LEFT_OUT, MOVED, NO_PAIR = 0.1, 0.3, 1_000.0


@lru_cache(maxsize=200_000)
def givens_cost(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Optimal assignment of the given names of two mentions: an initial stands for a name, a name that
    only one mention has was left out; names left over on both sides contradict."""
    if a[0] == b[0] and (len(a) == 1 or len(b) == 1):
        return LEFT_OUT * (len(a) + len(b) - 2)
    if len(a) > len(b):
        a, b = b, a
    rows = []
    for i, x in enumerate(a):
        row = []
        for j, y in enumerate(b):
            c = given_cost(x, y)
            if (i == 0) != (j == 0):  # called by a second name: only a whole name tells
                c = INF if len(x) == 1 or len(y) == 1 else c + MOVED
            row.append(min(c, NO_PAIR))
        rows.append(row)
    total, _ = assignment(rows)
    return INF if total >= NO_PAIR else total + LEFT_OUT * (len(b) - len(a))


def person_cost(a: tuple[str, tuple[str, ...]], b: tuple[str, tuple[str, ...]]) -> float:
    """Optimal assignment of the tokens of two mentions, family names to each other and given names among
    each other; infinite where a part contradicts."""
    most = 1 if min(len(a[0]), len(b[0])) < 7 else 2
    d = typo_cost(a[0], b[0], most)
    return INF if d > most else d + givens_cost(a[1], b[1])


@lru_cache(maxsize=200_000)
def given_keys(name: str) -> tuple[str, ...]:
    """Keys that two given names of small cost share: deletion neighbourhoods and the names that a name,
    or a name one letter longer, is short for."""
    near = deletes(name, 1)
    return tuple(near | {f"c:{c}" for k in near for c in _CANON.get(k, ())})


#: Longer tokens are indexed by segments: their deletion neighbourhoods would grow with the square of the length.
LONGEST_DELETES = 32


def deletes(token: str, most: int) -> set[str]:
    """Keys that two tokens within ``most`` edits share: what is left after up to ``most`` deletions; for
    long tokens the segments of which one at least survives ``most`` edits, at every shift they allow."""
    out = {token}
    if len(token) > LONGEST_DELETES - most:
        parts = 2 * most + 1  # a transposition touches two neighbouring letters
        for n in range(len(token) - most, len(token) + most + 1):
            size = n // parts
            for k in range(parts):
                for at in range(max(0, k * size - most), min(len(token) - size, k * size + most) + 1):
                    out.add(f"{n}:{k}:{token[at:at + size]}")
        if len(token) > LONGEST_DELETES + most:
            return out
    for k in range(1, most + 1):
        out |= {"".join(c for i, c in enumerate(token) if i not in gone) for gone in combinations(range(len(token)), k)}
    return out


_TRADE_LETTERS = [(w, len(w), letters(w)) for w in TRADE_WORDS if len(w) >= 5]


@lru_cache(maxsize=200_000)
def trade_word(tok: str) -> str | None:
    """The word of the trade that a token is, is short for or misspells; None for any other token."""
    if tok in TRADE_WORDS:
        return SAME_TRADE.get(tok, tok)
    if tok in LEGAL:
        return ""
    if tok in SHORT_TRADE:
        return SHORT_TRADE[tok]
    n = len(tok)
    if n < 5:
        return None
    most, mine, best = 2 if n >= 8 else 1, letters(tok), None
    for w, k, theirs in _TRADE_LETTERS:
        if k > n and w.startswith(tok):  # a word broken off
            return SAME_TRADE.get(w, w)
        # an edit brings in one letter at most
        if abs(k - n) <= most and (mine & ~theirs).bit_count() <= most and (theirs & ~mine).bit_count() <= most:
            c = typo_cost(w, tok, most)
            if c <= most and (best is None or c < best[0]):
                best = (c, w)
    return SAME_TRADE.get(best[1], best[1]) if best else None


_AFTER = re.compile(r"\s-\s.*$|/.*$")
_FA = re.compile(r"\bf\.?\s?a\.")
_CCW = re.compile(r"\bc\.*\s?c\.*\s?w\b\.?|\bconcealed\s+carry(?:\s+weapons?)?\b")
_LETTERS = re.compile(r"\b([a-z])\.\s?([a-z])\.(?:\s?([a-z])\.)?")
_OWNS = re.compile(r"['’]s\b")
_WORDS = re.compile(r"[a-z0-9]+")
_JOINING = frozenset(("the", "by", "and", "of")) | frozenset(LEGAL)


def parse_org(text: str | None) -> tuple[tuple[str, ...], tuple[str, ...]] | None:
    """(telling tokens in order, words of the trade written out, sorted) of an organisation's name; None
    names nobody."""
    if not text:
        return None
    s = _CCW.sub("ccw ", _FA.sub("firearms ", _AFTER.sub(" ", plain(text))))
    s = _LETTERS.sub(lambda m: "".join(x or "" for x in m.groups()), s)
    toks = _WORDS.findall(_OWNS.sub("", s))
    if " ".join(toks) in NOBODY:
        return None
    kept = [t for t in toks if t not in _JOINING]
    words = [trade_word(t) for t in kept]
    telling = tuple(t for t, w in zip(kept, words) if w is None)
    if not telling:
        return (tuple(kept), ()) if kept else None
    return telling, tuple(sorted({w for w in words if w}))


def token_cost(x: str, y: str) -> float:
    """What it costs to call two telling tokens one word: an initial or a word broken off 0.5, a typo 1
    or 2 for the length, infinite otherwise."""
    if x == y:
        return 0.0
    short, long = (x, y) if len(x) < len(y) else (y, x)
    if long.startswith(short) and (len(short) == 1 or len(short) >= 4 and len(long) - len(short) > 2):
        return 0.5
    most = 0 if len(short) < 3 else 1 if len(short) < 6 else 2
    c = typo_cost(x, y, most)
    return float(c) if c <= most else INF


def org_cost(a: tuple[str, ...], b: tuple[str, ...], trade_a: tuple[str, ...], trade_b: tuple[str, ...]) -> float:
    """Optimal assignment of the tokens of two names in any order. Each telling token needs a partner,
    unless the names are near when glued together. Of the words of the trade one side may lack some;
    words left over on both sides contradict."""
    if set(trade_a) - set(trade_b) and set(trade_b) - set(trade_a):
        return INF
    x, y = "".join(a), "".join(b)
    most = 1 if min(len(x), len(y)) < 9 else 2
    glued = typo_cost(x, y, most)
    best = float(glued) if glued <= most else INF
    if len(a) == len(b) and best > 0:
        rows = [[min(token_cost(p, q), NO_PAIR) for q in b] for p in a]
        if max(map(min, rows)) <= most:
            best = min(best, assignment(rows)[0])
    return best if best <= most else INF
