"""JSON that may be fenced, padded or wrapped; HTML pages; image headers."""

from __future__ import annotations

import struct
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lenient_json(c: Column) -> Column:
    """A VARIANT from text: the whole text, else without a code fence, else from the first ``[`` or ``{``
    to its last counterpart; null if nothing parses."""
    t = F.trim(c)
    unfenced = F.trim(F.regexp_replace(F.regexp_replace(t, r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))
    arr, obj = F.regexp_extract(unfenced, r"(?s)(\[.*\])", 1), F.regexp_extract(unfenced, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(t), F.try_parse_json(unfenced), F.try_parse_json(arr), F.try_parse_json(obj))


def as_records(v: Column, key: str = "vendors") -> Column:
    """Array of VARIANT objects from an array, an object holding the array under ``key``, or one object."""
    arr = F.try_variant_get(v, "$", "array<variant>")
    inner = F.try_variant_get(v, f"$.{key}", "array<variant>")
    return F.coalesce(arr, inner, F.when(v.isNotNull(), F.array(v)))


def nested_uri(v: Column) -> Column:
    """The first of several places where link annotations keep their target."""
    return F.coalesce(*[F.try_variant_get(v, p, "string") for p in ("$.uri", "$.URI", "$.A.URI", "$.data.A.URI", "$.dest")])


_SKIP = {"script", "style", "nav", "header", "footer", "noscript"}


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.skip, self.rows, self.row, self.cell, self.links, self.images = [], 0, [], None, None, [], []
        self.href, self.stack = None, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        self.stack.append((tag, a))
        if tag in _SKIP:
            self.skip += 1
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th"):
            self.cell = []
        elif tag == "a" and a.get("href"):
            self.href = [a["href"], ""]
        elif tag == "img" and a.get("src"):
            around = " ".join(str(v) for _, at in self.stack[-4:] for k, v in at.items() if k in ("class", "id", "alt"))
            self.images.append((a["src"], a.get("alt") or "", around))
        if tag in ("img", "br", "hr", "input", "meta", "link"):
            self.stack.pop()

    def handle_endtag(self, tag):
        if self.stack and any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in ("td", "th") and self.cell is not None and self.row is not None:
            self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "tr" and self.row is not None:
            self.rows.append(self.row)
            self.row = None
        elif tag == "a" and self.href:
            self.links.append(tuple(self.href))
            self.href = None

    def handle_data(self, data):
        if self.skip:
            return
        self.text.append(data)
        if self.cell is not None:
            self.cell.append(data)
        if self.href:
            self.href[1] += data


def parse_page(html: str | None) -> _Page:
    page = _Page()
    if html:
        page.feed(html)
        page.close()
    return page


@F.pandas_udf(T.StringType())
def html_text_udf(s: pd.Series) -> pd.Series:
    """Visible text with white space collapsed; scripts, styles and page furniture left out."""
    return s.map(lambda t: None if t is None else " ".join(" ".join(parse_page(t).text).split()))


@F.pandas_udf(T.StringType())
def html_lines_udf(s: pd.Series) -> pd.Series:
    """Table rows as ``cell | cell`` lines if there are tables, else the visible text."""

    def lines(t):
        if t is None:
            return None
        p = parse_page(t)
        rows = [" | ".join(r) for r in p.rows if any(r)]
        return "\n".join(rows) if rows else " ".join(" ".join(p.text).split())

    return s.map(lines)


@F.pandas_udf(T.ArrayType(T.StringType()))
def page_links_udf(html: pd.Series, base: pd.Series, keywords: pd.Series) -> pd.Series:
    """Absolute links of the base's host whose address or text holds a keyword (split by ``|``), in order."""
    from urllib.parse import urljoin, urlparse

    def links(t, b, k):
        words = [w for w in (k or "").lower().split("|") if w]
        out = []
        for href, text in parse_page(t).links:
            url = urljoin(b or "", href).split("#")[0]
            if urlparse(url).netloc.lower() == urlparse(b or "").netloc.lower() and any(w in (url + " " + text).lower() for w in words) and url not in out:
                out.append(url)
        return out

    return pd.Series([links(*x) for x in zip(html, base, keywords)])


#: How many images a page keeps per class, in the order the classes are tried.
IMAGE_LIMITS = (("logo", 1), ("instructor", 3), ("training", 3))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("src", T.StringType()), T.StructField("kind", T.StringType())])))
def page_images_udf(html: pd.Series) -> pd.Series:
    """Images by keyword of attributes and surroundings; a full class passes an image on to the next."""
    words = {"logo": ("logo", "brand"), "instructor": ("instructor", "team", "staff", "portrait", "headshot"), "training": ("training", "class", "range", "course")}

    def classify(t):
        left, out = dict(IMAGE_LIMITS), []
        for src, alt, around in parse_page(t).images:
            where = f"{src} {alt} {around}".lower()
            if skip_image(src):
                continue
            kind = next((k for k, _ in IMAGE_LIMITS if left[k] and any(w in where for w in words[k])), None)
            if kind:
                left[kind] -= 1
                out.append({"src": src, "kind": kind})
        return out

    return s_map(html, classify)


def s_map(s: pd.Series, f) -> pd.Series:
    return pd.Series([f(x) for x in s])


def skip_image(src: str) -> bool:
    """Inline data, vector and animated images, spacers and icons."""
    low = (src or "").lower()
    return low.startswith("data:") or low.split("?")[0].endswith((".svg", ".gif")) or any(w in low for w in ("spacer", "pixel", "favicon", "sprite", "placeholder"))


def skip_image_col(c: Column) -> Column:
    low = F.lower(c)
    return low.startswith("data:") | low.rlike(r"^[^?]*\.(?:svg|gif)(?:\?|$)") | low.rlike("spacer|pixel|favicon|sprite|placeholder")


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def image_size_udf(data: pd.Series) -> pd.DataFrame:
    """Width and height from the first bytes of a PNG, JPEG or WebP file; nulls if unknown."""

    def size(b):
        if b is None:
            return None, None
        b = bytes(b)
        if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 24:
            return struct.unpack(">II", b[16:24])
        if b[:4] == b"RIFF" and b[8:12] == b"WEBP" and len(b) >= 30:
            if b[12:16] == b"VP8X":
                return 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little")
            if b[12:16] == b"VP8 ":
                w, h = struct.unpack("<HH", b[26:30])
                return w & 0x3FFF, h & 0x3FFF
            if b[12:16] == b"VP8L":
                n = int.from_bytes(b[21:25], "little")
                return 1 + (n & 0x3FFF), 1 + (n >> 14 & 0x3FFF)
        if b[:2] == b"\xff\xd8":
            i = 2
            while i + 9 < len(b):
                if b[i] != 0xFF:
                    i += 1
                elif b[i + 1] in range(0xC0, 0xD0) and b[i + 1] not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", b[i + 5:i + 9])
                    return w, h
                else:
                    i += 2 + int.from_bytes(b[i + 2:i + 4], "big")
        return None, None

    return pd.DataFrame([size(x) for x in data], columns=["width", "height"]).astype("Int32")
