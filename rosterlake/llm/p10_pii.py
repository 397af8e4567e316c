"""Problem 10: personal information in free text, found by a skip-chain conditional random field.

Variables are candidate spans (broad matchers for codes, numbers, addresses and names); all other text
is outside by construction. A chain edge joins neighbouring candidates, a skip edge joins each
candidate to the nearest earlier one of the document with the same digits or the same longest name
word, and loopy message passing over both makes the labels of a document consistent.

Unary, chain and skip factors are trained piecewise (each normalised by itself) on a bounded sample
of texts (SAMPLE_DOCS, a documented parameter) labelled by the words around each candidate; candidates
that no rule labels take part unlabelled. The lexicon (given names, frequent capitalised words, city
stems) is counted over all texts: a given name is a word that mostly stands before another capitalised
word, before many different ones, and before such as mostly follow few. Labels other than ``O`` give the spans; a check keeps a label only on a
candidate whose form allows it.

Null and empty texts have no spans. Positions are code points of the whole text, never a prefix."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.p8_tokens import spread
from rosterlake.llm.pii_spans import GIVEN, LABELS, NOT_GIVEN, Lexicon, candidates, context, lexicon_counts, link_key
from rosterlake.session import materialise, table

#: Texts of the training sample (those with the least id hashes).
SAMPLE_DOCS = 3_000
#: Capitalised words in more than this share of the texts are family names only if given names precede them.
COMMON_SHARE = 0.003
#: City stems and given names in a smaller share of the texts are left out, which bounds both lists: a word
#: above a share s of the texts is one of at most (words per text) / s.
LEAST_SHARE = 1 / 200_000
#: A city stem stands before a state in at least this share of the texts that have it.
STEM_RATE = 0.05
#: A follower that takes one word before it in at least this share of its occurrences is its own.
OWN_SHARE = 0.1
SLOTS = 1 << 15
_L = len(LABELS)
_NAME_FORMS = ("given family", "family, given", "initial family", "title family", "family, initial")
_ALLOWED = {"email": ("email",), "address": ("address",), "phone": ("phone",), **{k: ("person_name",) for k in _NAME_FORMS}}
# Words that tell what a number or code is.
_ID_WORDS = {"ssn", "social", "security", "seguro", "licence", "license", "licencia", "permit", "permiso", "cdl", "dl", "driver"}
_OTHER_WORDS = {"invoice", "file", "code", "course", "serial", "section", "sección", "replaces", "revision", "factura", "código", "curso", "case", "order", "ref", "paid", "fee"}


def _slot(*parts: str) -> int:
    return zlib.crc32("\x1f".join(parts).encode()) % SLOTS


def features(text: str, a: int, b: int, kind: str) -> list[int]:
    left, right = context(text, a, b)
    out = [_slot("k", kind)]
    out += [_slot("l", kind, str(i), w) for i, w in enumerate(left[:3])]
    out += [_slot("lb", kind, w) for w in left]
    out += [_slot("lx", w) for w in left[:3]]
    out += [_slot("r", kind, str(i), w) for i, w in enumerate(right[:2])]
    out.append(_slot("ll", kind, *left[:2]))
    return out


def weak_label(text: str, a: int, b: int, kind: str) -> int:
    """The label that the words around a candidate give, or -1."""
    left, right = context(text, a, b)
    near = set(left)
    if kind in ("email", "address"):
        return LABELS.index(kind)
    if kind == "phone":
        return 0 if near & (_OTHER_WORDS - {"fee", "paid"}) and not near & {"call", "phone", "tel", "fax"} else LABELS.index("phone")
    if kind in _NAME_FORMS:
        if right[:1] and right[0] in ("academy", "training", "school", "club", "range", "county", "street"):
            return 0
        return LABELS.index("person_name")
    # the nearest telling word decides
    for w in left:
        if w in _ID_WORDS:
            return LABELS.index("id_number")
        if w in _OTHER_WORDS:
            return 0
    return LABELS.index("id_number") if kind == "ssn" and "9" not in near else -1


class Units:
    """Candidates of a batch of texts as arrays: features, chain and skip edges."""

    def __init__(self, texts: list, lex: Lexicon):
        self.doc, self.start, self.end, self.kind, feats, self.weak = [], [], [], [], [], []
        chain, skip = [], []
        for d, t in enumerate(texts):
            if not t:
                continue
            last_end, seen = None, {}
            for a, b, kind in candidates(t, lex):
                i = len(self.doc)
                self.doc.append(d), self.start.append(a), self.end.append(b), self.kind.append(kind)
                feats.append(features(t, a, b, kind))
                self.weak.append(weak_label(t, a, b, kind))
                if last_end is not None and a - last_end < 80:
                    chain.append(i - 1)
                key = link_key(t, a, b, kind)
                if key:
                    if key in seen:
                        skip.append((seen[key], i))
                    seen[key] = i
                last_end = b
        self.n = len(self.doc)
        self.sizes = np.fromiter(map(len, feats), np.int64, self.n)
        self.flat = np.fromiter((x for f in feats for x in f), np.int64, int(self.sizes.sum()))
        c = np.asarray(chain, np.int64)
        self.chain = np.stack([c, c + 1], 1) if len(c) else np.zeros((0, 2), np.int64)
        self.skip = np.asarray(skip, np.int64).reshape(-1, 2)

    def unary(self, weights: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros((0, _L))
        return np.add.reduceat(weights[self.flat], np.append(0, np.cumsum(self.sizes)[:-1]), axis=0)


def train(units: Units, epochs: int = 40, rate: float = 0.5, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piecewise training: softmax weights of the unary factor by gradient steps with per-slot scaling,
    log-odds of neighbouring labels over independence for the chain and the skip factor."""
    weights = np.zeros((SLOTS, _L))
    y = np.asarray(units.weak, np.int64)
    owner = np.repeat(np.arange(units.n), units.sizes)
    keep = y[owner] >= 0
    rows, cols = owner[keep], units.flat[keep]
    scale = np.full(SLOTS, 1e-8)
    target = np.zeros((units.n, _L))
    target[y >= 0, y[y >= 0]] = 1
    for _ in range(epochs):
        z = units.unary(weights)
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        g = (target - p)
        g[y < 0] = 0
        grad = np.zeros((SLOTS, _L))
        for k in range(_L):
            grad[:, k] = np.bincount(cols, g[rows, k], SLOTS)
        grad -= ridge * weights
        scale += (grad * grad).sum(1)
        weights += rate * grad / np.sqrt(scale)[:, None]

    def pairs(edges: np.ndarray) -> np.ndarray:
        joint = np.full((_L, _L), 0.5)
        if len(edges):
            a, b = y[edges[:, 0]], y[edges[:, 1]]
            ok = (a >= 0) & (b >= 0)
            np.add.at(joint, (a[ok], b[ok]), 1)
        joint /= joint.sum()
        return np.clip(np.log(joint) - np.log(joint.sum(1, keepdims=True)) - np.log(joint.sum(0, keepdims=True)), -2, 2)

    return weights.astype(np.float32), pairs(units.chain), pairs(units.skip)


def infer(units: Units, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int = 5, damping: float = 0.3) -> np.ndarray:
    """Labels by loopy sum-product over chain and skip edges of all texts of a batch at once."""
    z = units.unary(weights).astype(float)
    if not units.n:
        return np.zeros(0, np.int64)
    edges = np.concatenate([units.chain, units.skip])
    table_ = np.concatenate([np.broadcast_to(chain, (len(units.chain), _L, _L)), np.broadcast_to(skip, (len(units.skip), _L, _L))]) * 0.5
    fwd = np.zeros((len(edges), _L))  # messages to the later node
    bwd = np.zeros((len(edges), _L))

    def belief() -> np.ndarray:
        out = z.copy()
        if len(edges):
            np.add.at(out, edges[:, 1], fwd)
            np.add.at(out, edges[:, 0], bwd)
        return out

    for _ in range(rounds if len(edges) else 0):
        b = belief()
        src, dst = b[edges[:, 0]] - bwd, b[edges[:, 1]] - fwd
        new_f = np.logaddexp.reduce(src[:, :, None] + table_, axis=1)
        new_b = np.logaddexp.reduce(dst[:, None, :] + table_, axis=2)
        new_f -= new_f.max(1, keepdims=True)
        new_b -= new_b.max(1, keepdims=True)
        fwd, bwd = damping * fwd + (1 - damping) * new_f, damping * bwd + (1 - damping) * new_b
    return belief().argmax(1)


def lexicon(docs: DataFrame, text_col: str) -> Lexicon:
    """City stems, given names and common words, counted over all texts; all three are bounded by shares.
    Rates are taken as (k + 1) / (n + 2), so few occurrences prove little."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c = lexicon_counts(t for t in pdf["t"] if isinstance(t, str))
            yield pd.DataFrame([(*k, n) for k, n in c.items()] + [("docs", "", "", len(pdf))], columns=["k", "w", "f", "n"])

    counts = materialise(docs.select(F.col(text_col).alias("t")).mapInPandas(run, "k string, w string, f string, n bigint").groupBy("k", "w", "f").agg(F.sum("n").alias("n")), "p10l")
    of = lambda kind, name: counts.where(F.col("k") == kind).select("w", F.col("n").alias(name))
    total = counts.where("k = 'docs'").agg(F.sum("n")).first()[0] or 0
    df, occ = of("cap", "df"), of("occ", "occ")
    pairs = counts.where("k = 'pair'").select("w", "f", "n")
    # followers that are a word's own, of all its followers
    told = pairs.join(occ.select(F.col("w").alias("f"), F.col("occ").alias("of")), "f").groupBy("w").agg(
        F.sum("n").alias("n"), F.count("*").alias("kinds"), F.sum(F.when(F.col("n") >= OWN_SHARE * F.col("of"), F.col("n")).otherwise(0)).alias("own"))
    rate = lambda a, b: (F.col(a) + 1) / (F.col(b) + 2)
    given = told.join(occ, "w").join(df, "w").where(F.col("df") >= LEAST_SHARE * total).where((rate("n", "occ") >= 0.6) & (rate("kinds", "n") >= 0.6) & (rate("own", "n") >= 0.7))
    given = {r.w for r in given.select("w").collect()} - NOT_GIVEN
    stems = {r.w for r in of("stem", "n").where(F.col("n") >= LEAST_SHARE * total).join(df, "w").where(rate("n", "df") >= STEM_RATE).select("w").collect()}
    common = df.where(F.col("df") > COMMON_SHARE * total)
    # a frequent word that mostly follows given names or titles is a family name
    named = pairs.where(F.col("w").isin(*sorted(given | GIVEN))).unionByName(counts.where("k = 'titled'").select("w", "f", "n")).groupBy(F.col("f").alias("w")).agg(F.sum("n").alias("n")).join(occ, "w").where(rate("n", "occ") >= 0.5)
    return Lexicon(stems, given, {r.w for r in common.join(named.select("w"), "w", "left_anti").select("w").collect()} - stems)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start_pos, end_pos, pii_type`` of every span in every text."""
    docs = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    lex = lexicon(docs, "t")
    sample = docs.where("t IS NOT NULL AND t <> ''").withColumn("h", F.xxhash64("i")).orderBy("h", "i").limit(SAMPLE_DOCS).select("t")
    model = train(Units([r.t for r in sample.collect()], lex))
    shared = docs.sparkSession.sparkContext.broadcast((lex, model))
    kind = docs.schema["i"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex, (weights, chain, skip) = shared.value
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at:at + 256]
                units = Units([t if isinstance(t, str) else None for t in part["t"]], lex)
                label = infer(units, weights, chain, skip)
                ids = part["i"].to_numpy()
                rows = [(ids[d], a, b, LABELS[y]) for d, a, b, k, y in zip(units.doc, units.start, units.end, units.kind, label)
                        if y and LABELS[y] in _ALLOWED.get(k, ("id_number",))]
                yield pd.DataFrame(rows, columns=[id_col, "start_pos", "end_pos", "pii_type"])

    return docs.mapInPandas(run, f"{id_col} {kind}, start_pos bigint, end_pos bigint, pii_type string")


def redact(text: str | None, spans: list) -> str | None:
    """The text with each span replaced by a placeholder of its type."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join(out) + text[at:]


def p10_found(spark, sf_dir: str) -> DataFrame:
    """``doc_id, start_pos, end_pos, pii_type``; positions in code points, the end exclusive."""
    return find_pii(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p10_redacted(spark, sf_dir: str) -> DataFrame:
    """``doc_id, text`` with typed placeholders; a text without personal information is unchanged."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = materialise(find_pii(spread(docs)), "p10s").groupBy("doc_id").agg(F.collect_list(F.struct("start_pos", "end_pos", "pii_type")).alias("s"))

    @F.pandas_udf("string")
    def apply(t: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([redact(x, [] if y is None else [(r["start_pos"], r["end_pos"], r["pii_type"]) for r in y]) for x, y in zip(t, s)])

    return docs.join(spans, "doc_id", "left").select("doc_id", apply("text", "s").alias("text"))


QUERIES = {"p10_found": p10_found, "p10_redacted": p10_redacted}
SQL: dict[str, str] = {}
