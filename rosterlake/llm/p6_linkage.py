"""Problem 6: records of two sources without a common key, matched by graph embeddings.

Graph: distinct profiles (name, phones, site) of both sources are record nodes; telling name tokens,
their glued form (as written and sorted), its first and last letters, phone numbers and sites are
attribute and token nodes. A random walk leaves a record by an attribute chosen with probability in
inverse proportion to its degree, goes to one of the attribute's records and on to that record's name,
phone or site; each record's skip-gram vector is trained with negative sampling on the nodes its
walks visit, weighted by inverse degree where they are common. Output vectors are fixed random signs
derived from a node's hash and are not trained, so every record trains on its own and no table of
vectors is shared or shuffled; the result is close to a random projection of the visit counts.

Blocking: several tables of random hyperplanes over both sources (equi-join on table and bits); a
sketch of further planes discards most chance meetings. Records that agree exactly in an attribute (the
glued name, a phone, a site) meet by a look-up of one record per value, whatever their vectors.

Candidates are reranked by the exact cosine and by exact comparison of names (optimal assignment),
phones and sites. The cosine is calibrated together with these agreements: a mixture of matches and
others (Fellegi and Sunter's model) is fitted by expectation maximisation to the counts of all
agreement patterns; how many names share a phone or site is part of its pattern. The posterior of a
pair is its confidence; a listing gets the most probable target if that is more likely than not.

Every record walks, is indexed and is matched; each walk draws its own records. Rows without a telling name match nothing; blank or
null place ids are no target. A listing gets at most one place id."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.common import skewless_lookup
from rosterlake.llm.name_parts import INF, org_cost, parse_org, token_cost
from rosterlake.session import drop_work, materialise, table

DIM = 64
WALKS = 2
#: Of a window of three nodes.
FAR_WEIGHT = 1 / 3
#: Records of an attribute that one task holds at most, about.
BLOCK = 100_000
#: Low bits of a context's hash that hold twice the binary logarithm of its attribute's degree.
DEGREE_BITS = 6
#: Contexts of a larger share of the records weigh by their inverse degree.
COMMON_SHARE = 1 / 64
TABLES, BITS = 16, 16
SKETCH_MOST = 18
#: Levels of the fields that the mixture compares.
LEVELS = {"name": 5, "trade": 3, "phone": 9, "site": 9, "cos": 11}

_PHONE = re.compile(r"(?<!\d)(?:\+?1[\s.\-]*)?\(?(\d{3})\)?[\s.\-]*(\d{3})[\s.\-]*(\d{4})(?!\d)")


def phone_keys(text: str | None) -> tuple[str, ...]:
    """The ten digits of every phone number in a text."""
    if not isinstance(text, str):
        return ()
    return tuple(sorted({"".join(m) for m in _PHONE.findall(re.sub(r"(?i)\bext\S*\s*\d+|x\s*\d+", " ", text))}))


def site_key(text: str | None) -> str:
    if not isinstance(text, str):
        return ""
    s = re.sub(r"^(?:[a-z]+://)?(?:www\.)?", "", text.strip().lower())
    s = re.sub(r"[?#].*$", "", s).rstrip("/")
    host, _, path = s.partition("/")
    if "." not in host:
        return ""
    # a path with a number names a page of a portal; other paths are pages of the business's own site
    return f"{host}/{path}" if re.search(r"/?\d{3,}$", path) else host


def own_name(text: str | None) -> tuple[tuple[str, ...], tuple[str, ...]] | None:
    """Telling words and words of the trade; of several names joined by a slash or comma the one with
    most words of the trade (another is that of a venue), the first on a tie."""
    if not isinstance(text, str):
        return None
    text = text.replace("_", " ")
    best = None
    for part in text.split("/"):
        org = parse_org(part)
        if org and (best is None or len(org[1]) > len(best[1])):
            best = org
    return best


def profiles(df: DataFrame, id_col: str) -> DataFrame:
    """``id, name, trade, phone, site`` of the rows with a telling name (lists joined by blanks)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, v, p, u in zip(pdf["id"], pdf["v"], pdf["p"], pdf["u"]):
                org = own_name(v)
                if org:
                    rows.append((i, " ".join(org[0]), " ".join(org[1]), " ".join(phone_keys(p)), site_key(u)))
            yield pd.DataFrame(rows, columns=["id", "name", "trade", "phone", "site"])

    src = df.where(F.col("vendor_name").isNotNull()).select(F.col(id_col).alias("id"), F.col("vendor_name").alias("v"), F.col("phone").alias("p"), F.col("website_url").alias("u"))
    return src.mapInPandas(run, "id bigint, name string, trade string, phone string, site string")


GLUED = "replace(name, ' ', '')"
SORTED = "array_join(sort_array(split(name, ' ')), '')"
PHONES = "filter(split(phone, ' '), x -> x <> '')"


def attributes(nodes: DataFrame) -> DataFrame:
    """``rec, attrs`` of record nodes: 64-bit hashes of kind and value, and ``own``, those of them that tell
    a record best (glued name, phones, site)."""
    sites = "filter(array(concat('s:', site)), x -> length(x) > 2)"
    best = f"concat(array(concat('g:', {GLUED})), transform({PHONES}, x -> concat('p:', x)), {sites})"
    kinds = f"""concat({best}, transform(split(name, ' '), t -> concat('t:', t)), array(concat('g:', {SORTED}), concat('a:', substring({GLUED}, 1, 6)), concat('z:', right({GLUED}, 9))),
        transform({sites}, x -> concat('g:', regexp_replace(regexp_extract(site, '^[^./]+', 0), '-|ccw$|training$|academy$', ''))))"""
    return nodes.select("rec", F.expr(f"transform(array_distinct({kinds}), x -> xxhash64(x))").alias("attrs"), F.expr(f"transform({best}, x -> xxhash64(x))").alias("own"))


def walk_contexts(nodes: DataFrame) -> DataFrame:
    """The nodes with ``ctx``: hashes of the attribute nodes that each record's walks visit (its own
    included), with degrees in the low bits (0: not known).

    A walk leaves by one of the record's attributes (the race in ``WALKS`` clocks), goes to a record that it draws
    for itself among all others of that attribute (``step_through``) and on to one of that record's name, phone or
    site, one of two that the record has drawn for this attribute."""
    edges = attributes(nodes).select("rec", "own", F.explode("attrs").alias("attr"))
    # nodes of degree 1 lead nowhere and are no context (the usual minimum count of skip-gram)
    known = edges.groupBy("attr").agg(F.count("*").alias("n"))
    hot = materialise(known.where(F.col("n") > BLOCK), "p6a")  # few: an attribute of so many records
    met = step_through(edges, hot)
    met = materialise(met, "p6e", "lz4")
    atts = met.groupBy("rec").agg(F.collect_list("near").alias("near"), *[F.min_by(f"far{i}", f"c{i}").alias(f"far{i}") for i in range(WALKS)])  # a row's few attributes
    drop_work(hot)
    ctx = F.concat("near", F.array(*[f"far{i}" for i in range(WALKS)]))
    out = materialise(nodes.join(atts.select("rec", ctx.alias("ctx")), "rec", "left").withColumn("ctx", F.coalesce("ctx", F.array().cast("array<bigint>"))), "p6c")
    drop_work(met)
    return out


def step_through(edges: DataFrame, hot: DataFrame) -> DataFrame:
    """``rec, near, far0, c0, ...`` of every edge ``rec, own, attr`` whose attribute other records have too: the
    attribute with its degree, and for each walk the context it reaches through it (of the ``own`` of a record drawn
    uniformly among the attribute's others) and its clock.

    The records of an attribute meet in one task, in blocks of about BLOCK by their hash where it is ``hot`` (a walk
    then draws within its record's block, which is a random part of the attribute), so no task has to
    hold an attribute of any size."""
    # a walk goes on from the record it meets by a draw of its own: two draws of that record, of which it takes one
    draws = [F.expr(f"own[pmod(xxhash64(rec, attr, {i}), size(own))]").alias(f"to{i}") for i in range(WALKS)]
    flat = edges.select("rec", "attr", *draws).join(F.broadcast(hot), "attr", "left")
    flat = flat.withColumn("block", F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("rec", F.lit(5)), F.ceil(F.col("n") / BLOCK))).cast("int"))
    clear = np.int64(-1 << DEGREE_BITS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from rosterlake.llm.p4_neardup import _mix

        parts = list(batches)  # a task's share of the edges: flat numbers
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True)
        del parts
        # the order within an attribute is that of the records' hashes, the same in every run
        pdf = pdf.iloc[np.lexsort((pdf["rec"], pdf["block"], pdf["attr"]))]
        rec, attr, block = (pdf[c].to_numpy() for c in ("rec", "attr", "block"))
        start = np.flatnonzero(np.append(True, (attr[1:] != attr[:-1]) | (block[1:] != block[:-1])))
        size = np.diff(np.append(start, len(attr)))
        first, n = np.repeat(start, size), np.repeat(size, size)
        degree = np.where(pdf["n"].isna(), n, pdf["n"]).astype(np.int64)
        some = degree > 1
        out = {"rec": rec, "near": attr & clear | np.minimum(np.round(2 * np.log2(degree)), (1 << DEGREE_BITS) - 1).astype(np.int64)}
        with np.errstate(over="ignore"):
            seed = _mix(rec.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ _mix(attr.view(np.uint64)))
            for i in range(WALKS):
                r = _mix(seed + np.uint64(2 * i + 1))
                here = np.arange(len(attr)) - first
                # one of the n - 1 others, each alike
                there = first + (here + 1 + (r % np.maximum(n - 1, 1).astype(np.uint64)).astype(np.int64)) % n
                to = np.where(_mix(r) & np.uint64(1), pdf["to0"].to_numpy()[there], pdf[f"to{WALKS - 1}"].to_numpy()[there])
                out[f"far{i}"] = to & clear
                # walk i leaves by the attribute that wins a race of exponential clocks, slower for a larger degree: inverse-degree choice
                out[f"c{i}"] = (-np.log(((_mix(r + np.uint64(1)) >> np.uint64(11)).astype(float) + 1) / (2.0**53 + 2)) * degree).astype(np.float32)
        yield pd.DataFrame(out)[some]

    walks = ", ".join(f"far{i} bigint, c{i} float" for i in range(WALKS))
    return flat.repartition("attr", "block").mapInPandas(run, f"rec bigint, near bigint, {walks}")


def _signs(ids: np.ndarray) -> np.ndarray:
    """Fixed output vectors: DIM random signs of each 64-bit id, unit length."""
    from rosterlake.llm.p4_neardup import _mix

    x = ids.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        words = np.stack([_mix(x + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k + 1)) for k in range(DIM // 64)], axis=1)
    bits = np.unpackbits(words.view(np.uint8), axis=1)
    return (bits.astype(np.float32) * 2 - 1) / np.float32(np.sqrt(DIM))


def skip_gram(owner: np.ndarray, ids: np.ndarray, n: int, steps: int = 2, rate: float = 0.6, negatives: int = 48, weight: np.ndarray | None = None) -> np.ndarray:
    """Unit vectors of n records from (owner, context id) pairs, by gradient ascent on the skip-gram
    objective with negative sampling against fixed output vectors. Repeated contexts are counted once
    with their number, times the ``weight`` of the context, as weight. Records without contexts get a
    zero vector."""
    order = np.lexsort((ids, owner))
    owner, ids = owner[order], ids[order]
    weight = np.ones(len(ids), np.float32) if weight is None else weight[order]
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, np.int64)
    times = (np.add.reduceat(weight, first) if len(ids) else weight).astype(np.float32)[:, None]
    owner, ids = owner[first], ids[first]
    u = _signs(ids)
    counts = np.maximum(np.bincount(owner, times[:, 0], minlength=n), 1e-9).astype(np.float32)[:, None]
    starts = np.searchsorted(owner, np.arange(n))
    some = np.bincount(owner, minlength=n) > 0
    neg = _signs(np.random.default_rng(11).integers(-2**63, 2**63 - 1, size=negatives, dtype=np.int64))
    total = lambda x: np.where(some[:, None], np.add.reduceat(x, np.minimum(starts, len(x) - 1), axis=0), 0) if len(x) else np.zeros((n, DIM), np.float32)
    v = total(times * u) / counts
    v *= 4 / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    for _ in range(steps):
        pull = 1 / (1 + np.exp(np.einsum("ij,ij->i", v[owner], u)))
        push = 1 / (1 + np.exp(-(v @ neg.T)))
        v = v + rate * 4 * (total(pull[:, None] * times * u) / counts - (push @ neg) / negatives)
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def embed(contexts: DataFrame, records: int) -> DataFrame:
    """The records with ``vec`` (signed bytes), ``keys`` (one per table), ``sk`` (sketch) instead of their
    contexts; materialised. A record without contexts has a zero vector and no keys."""
    common = float(np.log2(max(records * COMMON_SHARE, 1)))
    planes = np.random.default_rng(3).standard_normal((DIM, TABLES * BITS + 64)).astype(np.float32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 4000):
                part = pdf.iloc[at:at + 4000]
                sizes = np.fromiter(map(len, part["ctx"]), np.int64, len(part))
                ids = np.concatenate([np.zeros(0, np.int64), *part["ctx"]]).astype(np.int64)
                low = ids & ((1 << DEGREE_BITS) - 1)
                weight = np.exp2(-np.maximum(low / 2 - common, 0)).astype(np.float32)
                # the window shrinks at random in skip-gram, so a node three steps away counts by FAR_WEIGHT
                weight[low == 0] = FAR_WEIGHT
                # an attribute is one node, near or far
                v = skip_gram(np.repeat(np.arange(len(part)), sizes), ids ^ low, len(part), weight=weight)
                side = v @ planes > 0
                bits = side[:, :TABLES * BITS].reshape(len(part), TABLES, BITS)
                keys = bits @ (1 << np.arange(BITS, dtype=np.int64)) + (np.arange(TABLES, dtype=np.int64) << BITS)
                sk = np.packbits(side[:, TABLES * BITS:], axis=1).view(np.int64)[:, 0]
                vec = np.clip(np.round(v * 300), -127, 127).astype(np.int8)
                keys = [k if n else k[:0] for k, n in zip(keys.astype(np.int32), sizes)]
                yield part.drop(columns="ctx").assign(vec=[x.tobytes() for x in vec], keys=keys, sk=sk)

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in contexts.schema if f.name != "ctx")
    return materialise(contexts.mapInPandas(run, f"{kept}, vec binary, keys array<int>, sk bigint"), "p6v")


def agreement(a: str, b: str, shares: str) -> int:
    """0 if a side lacks the field, 1 for a clash, else 2 plus the binary logarithm of how many profiles of
    different names share the agreed value. ``b`` and ``shares`` are parallel lists joined by blanks."""
    if not a or not b:
        return 0
    mine = set(a.split(" "))
    hits = [int(n) for v, n in zip(b.split(" "), shares.split(" ")) if v in mine]
    return min(1 + min(hits).bit_length(), LEVELS["phone"] - 1) if hits else 1


@lru_cache(maxsize=100_000)
def name_level(a: str, b: str) -> int:
    """0 equal, 1 or 2 by cost of the assignment, 3 if a telling word is shared, 4 otherwise."""
    if a == b:
        return 0
    x, y = tuple(a.split(" ")), tuple(b.split(" "))
    c = org_cost(x, y, (), ())
    if c < INF:
        return 0 if c == 0 else 1 if c <= 1 else 2
    return 3 if any(len(p) > 3 and len(q) > 3 and token_cost(p, q) <= 1 for p in x for q in y) else 4


def rerank(pairs: DataFrame) -> DataFrame:
    """Exact cosine and agreement levels of candidates: ``l, r, cosine, name, trade, phone, site, cos``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.frombuffer(b"".join(pdf["lv"]), np.int8).reshape(len(pdf), DIM).astype(np.float32)
            y = np.frombuffer(b"".join(pdf["rv"]), np.int8).reshape(len(pdf), DIM).astype(np.float32)
            cos = (x * y).sum(1) / np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1), 1e-9)
            trade = []
            for t, u in zip(pdf["lt"], pdf["rt"]):
                t, u = set(t.split()), set(u.split())
                trade.append(0 if not t or not u else 1 if t <= u or u <= t else 2)
            yield pd.DataFrame({
                "l": pdf["l"], "r": pdf["r"], "cosine": cos.astype(float), "name": [name_level(a, b) for a, b in zip(pdf["ln"], pdf["rn"])], "trade": trade,
                "phone": [agreement(*z) for z in zip(pdf["lp"], pdf["rp"], pdf["rps"])], "site": [agreement(*z) for z in zip(pdf["lu"], pdf["ru"], pdf["rus"])],
                "cos": np.clip(np.floor(cos * 10), 0, 10).astype(int)})

    return pairs.mapInPandas(run, "l bigint, r bigint, cosine double, name int, trade int, phone int, site int, cos int")


def fit_mixture(patterns: pd.DataFrame, rounds: int = 200) -> tuple[float, dict[str, np.ndarray]]:
    """Weights of evidence ``(prior log-odds, log-odds by level of each field)`` from the counts ``n`` of
    agreement patterns. Expectation maximisation of a mixture of matches and others; it starts from
    pairs of equal names, or near names that a phone or site supports."""
    fields = list(LEVELS)
    if not len(patterns):
        return -1.0, {f: np.zeros(k) for f, k in LEVELS.items()}
    n = patterns["n"].to_numpy(float)
    level = {f: patterns[f].to_numpy(int) for f in fields}
    support = (level["phone"] > 1).astype(int) + (level["site"] > 1)
    p = np.where((level["name"] == 0) | (level["name"] <= 2) & (support > 0) | (support > 1), 0.95, 0.05)
    for _ in range(rounds):
        weights, prior = {}, (n * p).sum() / n.sum()
        for f in fields:
            # an even prior keeps levels that nobody has neutral
            m = np.bincount(level[f], n * p, LEVELS[f]) + 0.5
            u = np.bincount(level[f], n * (1 - p), LEVELS[f]) + 0.5
            weights[f] = np.log(m / m.sum()) - np.log(u / u.sum())
        base = float(np.log(max(prior, 1e-9)) - np.log(max(1 - prior, 1e-9)))
        z = base + sum(weights[f][level[f]] for f in fields)
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        moved = np.abs(new - p).max()
        p = new
        if moved < 1e-6:
            break
    return base, weights


def lookups(nodes: DataFrame) -> DataFrame:
    """``l, r``: every left record with a right record that stands for its exact values: its glued name
    (alone and with its trade, a phone or its site) and, where only one target has it, its phone or site.
    One record per value, so a value of many records costs no product of its two sides."""
    names = lambda kind, more: F.concat(F.lit(kind), F.expr(SORTED), F.lit("|"), more)
    keys = F.concat(
        F.array(F.concat(F.lit("g"), F.expr(GLUED)), F.concat(F.lit("g"), F.expr(SORTED)), names("t", F.col("trade"))),
        F.transform(F.expr(PHONES), lambda x: names("n", x)), F.transform(F.expr(PHONES), lambda x: F.concat(F.lit("p"), x)),
        F.when(F.col("site") != "", F.array(names("n", F.col("site")), F.concat(F.lit("s"), "site"))).otherwise(F.array().cast("array<string>")))
    keys = F.array_distinct(keys)
    flat = nodes.select("rec", "is_l", "is_r", "t_least", "t_most", F.explode(keys).alias("k")).select("rec", "is_l", "is_r", "t_least", "t_most", F.substring("k", 1, 1).alias("kind"), F.xxhash64("k").alias("key"))
    stands = flat.where("is_r = 1").groupBy("key", "kind").agg(F.max("rec").alias("r"), F.min("t_least").alias("least"), F.max("t_most").alias("most"))
    stands = stands.where("kind NOT IN ('p', 's') OR least = most").select("key", "r")
    # ``stands`` is unique in its key: a hot key of the left side is split by the adaptive skew join
    return flat.where("is_l = 1").select(F.col("rec").alias("l"), "key").join(stands, "key").select("l", "r")


def link_places(left: DataFrame, right: DataFrame, left_id: str, right_id: str, target: str) -> DataFrame:
    """``<left_id>, <target>, confidence``: the matched target of rows of ``left``."""
    key = ["name", "trade", "phone", "site"]
    # a profile's number is the hash of its parts, so that walks are the same in every run
    rec = F.xxhash64(*key).alias("rec")
    lp = materialise(profiles(left, left_id).select("id", rec, *key), "p6l")
    rp = profiles(right.where(F.trim(target) != ""), right_id).join(right.select(F.col(right_id).alias("id"), F.trim(target).alias("target")), "id")
    rp = materialise(rp.select(rec, *key, "target"), "p6r")
    none = F.lit(None).cast("bigint")
    nodes = lp.select("rec", *key, F.lit(1).alias("is_l"), none.alias("t")).unionByName(rp.select("rec", *key, F.lit(0).alias("is_l"), F.xxhash64("target").alias("t")))
    nodes = nodes.groupBy("rec", *key).agg(F.max("is_l").alias("is_l"), F.max(1 - F.col("is_l")).alias("is_r"), F.sum("is_l").alias("n"), F.min("t").alias("t_least"), F.max("t").alias("t_most"))
    nodes = materialise(nodes, "p6n")
    contexts = walk_contexts(nodes.select("rec", *key, "is_l", "is_r"))
    vectors = embed(contexts, nodes.count())
    drop_work(contexts)
    flat = lambda flag, name: vectors.where(f"{flag} = 1").select(F.explode("keys").alias("key"), F.col("rec").alias(name), F.col("sk").alias(f"{name}s"))
    met = flat("is_l", "l").join(flat("is_r", "r"), "key").where(f"bit_count(ls ^ rs) <= {SKETCH_MOST}").select("l", "r")
    targets = materialise(rp.select(F.col("rec").alias("r"), "target").distinct(), "p6t")
    met = materialise(met.unionByName(lookups(nodes)).distinct(), "p6m")
    # how many profiles share each phone and site of the right records (one if all have one name)
    values = nodes.select("rec", "is_r", F.expr(f"xxhash64({GLUED})").alias("g"), F.expr(f"explode(concat(transform({PHONES}, x -> concat('p', x)), filter(array(concat('s', site)), x -> x <> 's')))").alias("v"))
    shares = values.groupBy("v").agg(F.when(F.min("g") == F.max("g"), 1).otherwise(F.count("*")).alias("k"), F.max("is_r").alias("is_r"), F.sum("is_r").alias("n")).where("is_r = 1").select("v", "k", "n")
    shared = skewless_lookup(values.where("is_r = 1").select("rec", "v"), materialise(shares, "p6h"), ["v"], "n").groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("v", "k"))).alias("vs"))  # a record's few values
    part = lambda kind, what: F.expr(f"array_join(transform(filter(vs, x -> x.v LIKE '{kind}%'), x -> {what}), ' ')")
    linfo = vectors.where("is_l = 1").select(F.col("rec").alias("l"), F.col("name").alias("ln"), F.col("trade").alias("lt"), F.col("phone").alias("lp"), F.col("site").alias("lu"), F.col("vec").alias("lv"))
    rinfo = vectors.where("is_r = 1").join(shared, "rec", "left").select(
        F.col("rec").alias("r"), F.col("name").alias("rn"), F.col("trade").alias("rt"), F.col("vec").alias("rv"), *[F.coalesce(part(k, w), F.lit("")).alias(c) for k, w, c in (
            ("p", "substring(x.v, 2)", "rp"), ("p", "string(x.k)", "rps"), ("s", "substring(x.v, 2)", "ru"), ("s", "string(x.k)", "rus"))])
    scored = materialise(rerank(met.join(linfo, "l").join(rinfo, "r")), "p6s")
    drop_work(vectors)
    fields = list(LEVELS)
    base, weights = fit_mixture(scored.groupBy(*fields).agg(F.count("*").alias("n")).toPandas())  # as many rows as there are patterns, a fixed number
    odds = F.lit(base)
    for f in fields:
        odds = odds + F.element_at(F.array(*[F.lit(float(w)) for w in weights[f]]), F.col(f) + 1)
    good = scored.withColumn("odds", odds).where("odds > 0").withColumn("confidence", F.round(1 / (1 + F.exp(-F.least("odds", F.lit(30.0)))), 9))
    best = good.join(targets, "r").groupBy("l").agg(F.max(F.struct(F.round("odds", 6).alias("odds"), F.round("cosine", 6).alias("cosine"), "confidence", "target")).alias("b"))
    best = best.select(F.col("l").alias("rec"), "b.confidence", "b.target").join(nodes.select("rec", "n"), "rec")
    out = skewless_lookup(lp.select("id", "rec"), materialise(best, "p6b"), ["rec"], "n")
    return out.select(F.col("id").alias(left_id), F.col("target").alias(target), "confidence")


def _linked(spark, sf_dir: str) -> DataFrame:
    cols = ["vendor_name", "website_url", "phone"]
    return link_places(table(spark, sf_dir, "marin").select("listing_id", *cols), table(spark, sf_dir, "vendors_placeid_smoke_out").select("row_id", *cols, "google_place_id"),
                       "listing_id", "row_id", "google_place_id")


def p6_found(spark, sf_dir: str) -> DataFrame:
    """``listing_id, google_place_id`` of every listing whose business has a place id."""
    return _linked(spark, sf_dir).select("listing_id", "google_place_id")


def p6_matches(spark, sf_dir: str) -> DataFrame:
    """The matches with their calibrated confidence."""
    return _linked(spark, sf_dir)


QUERIES = {"p6_found": p6_found, "p6_matches": p6_matches}
SQL: dict[str, str] = {}
