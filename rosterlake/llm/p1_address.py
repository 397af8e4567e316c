"""Problem 1: address records that denote the same location.

Addresses are parsed into parts with abbreviation dictionaries. ZIP codes are given the city most
often written with them (at most 100,000 five-digit codes, so that table is bounded), which fills
missing cities and mends misspelt ones. Streets (house number and name) are blocked by MinHash banding
over shingles that combine the house number with the name token and its character q-grams, so only
equal house numbers meet; near names are verified, and the address variants of equal or near
streets are compared by affine-gap alignment of their parts.

Two near names of one house number are one street with a typo if the addresses name the same city, or
if the rarer name is as rare as a typo would be (counted in house numbers: ``STREET_TYPOS`` of the
more frequent one, plus one); otherwise a name that more house numbers carry is a street of its own. The city of a ZIP is the one that most addresses
with it write, the more frequent city on a tie.

Only addresses of one street and one city meet; those without a city, or with a city that is no known
spelling, meet all of their street.

Rows without address, house number or street take no part. A missing part matches any; the relation
is not transitive, so the result is pairs. Where an address names neither city nor ZIP the row's
city column (which may pack several) tells; if that is null too, the city counts as missing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.address_parts import UNKNOWN_CITY, city_key, near_city, near_words, parse, same_place
from rosterlake.llm.common import pairs_within, rare_enough, skewless_lookup
from rosterlake.session import materialise, table

BANDS = 16
#: Share of a street name's house numbers that bear one certain typo, at most. It is larger than that of
#: names of people, since near names here share the house number, and usually the city, as well.
STREET_TYPOS = 1 / 20

_SEP = re.compile(r"\s*(?:[,;/|&\r\n\"]|\band\b)+\s*", re.I)


def row_city_keys(text: str | None) -> tuple[str, ...]:
    """The city keys of a city column, which may pack several."""
    if text is None or text != text:
        return ()
    keys = (city_key(x) for x in _SEP.split(text))
    return tuple(sorted({k for k in keys if k}))


def parsed(df: DataFrame, id_col: str, address: str, city: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, a, c in zip(pdf["id"], pdf["a"], pdf["c"]):
                keys = row_city_keys(c)
                if (p := parse(a, keys)) is not None:
                    rows.append((i, *p, list(keys)))
            yield pd.DataFrame(rows, columns=["id", "num", "dir", "name", "kind", "unit", "city", "zip", "soft", "rc"])

    src = df.where(F.col(address).rlike(r"\d")).select(F.col(id_col).alias("id"), F.col(address).alias("a"), F.col(city).alias("c"))
    return src.mapInPandas(run, "id bigint, num string, dir string, name string, kind string, unit string, city string, zip string, soft boolean, rc array<string>")


def settle(rows: DataFrame) -> DataFrame:
    """Fill and mend cities by ZIP; the result has ``cities``, an array of city keys (empty: unknown)."""
    pairs = rows.where("city <> '' AND zip <> '' AND NOT soft").groupBy("zip", "city").agg(F.count("*").alias("n"))
    often = pairs.groupBy("city").agg(F.sum("n").alias("all"))
    best = pairs.join(often, "city").groupBy("zip").agg(F.max(F.struct("n", "all", "city")).alias("b"))
    of_zip = dict(best.select("zip", "b.city").collect())  # at most 100,000 codes
    of_zip = {z: c for z, c in of_zip.items() if c}
    shared = rows.sparkSession.sparkContext.broadcast(of_zip)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zips = shared.value
        settled = set(zips.values())
        for pdf in batches:
            names, cities = [], []
            for name, city, z, soft, rc in zip(pdf["name"], pdf["city"], pdf["zip"], pdf["soft"], pdf["rc"]):
                known = zips.get(z, "") if z else ""
                hints = [known] if known else list(rc)
                if soft and hints:
                    toks = city.split()
                    hit = next(((c, i) for c in hints for i in range(len(toks)) if near_city(" ".join(toks[i:]), c)), None)
                    if hit:
                        name, city = name + "".join(toks[:hit[1]]), hit[0]
                    else:  # the words belong to the name
                        name, city = name + "".join(toks), ""
                if known and (not city or city not in settled and near_city(city, known)):
                    city = known
                if not city and z and not known:
                    city = "zip " + z
                if city and city not in settled:
                    city = next((c for c in rc if c in settled and near_city(city, c)), UNKNOWN_CITY + city)
                cities.append([city] if city else [c if c in settled else UNKNOWN_CITY + c for c in rc])
                names.append(name)
            yield pdf[["id", "num", "dir", "kind", "unit"]].assign(name=names, cities=cities)

    return rows.mapInPandas(run, "id bigint, num string, dir string, kind string, unit string, name string, cities array<string>")


def _grams(num: str, name: str, q: int = 3) -> set[str]:
    s = f"^{name}$"
    return {f"{num}|{s[i:i + q]}" for i in range(len(s) - q + 1)} | {f"{num}|{name}|"}


def street_links(streets: DataFrame, bands: int = BANDS) -> DataFrame:
    """Pairs ``a < b`` of near streets of one house number, and whether one is as ``rare`` as a typo of the
    other; ``streets`` has ``sid, num, name, known``."""
    seeds = np.random.default_rng(7).integers(1, 2**63, size=bands, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            keys = []
            for num, name in zip(pdf["num"], pdf["name"]):
                h = np.fromiter((xxhash.xxh64_intdigest(g) for g in _grams(num, name)), np.uint64)
                with np.errstate(over="ignore"):
                    x = h[:, None] * seeds[None, :]
                    x ^= x >> np.uint64(29)
                    x *= np.uint64(0xBF58476D1CE4E5B9)
                    low = (x ^ (x >> np.uint64(32))).min(0)
                    # one minimum a band, tagged by the band
                    keys.append((low * np.uint64(bands) + np.arange(bands, dtype=np.uint64)).view(np.int64))
            yield pdf.assign(keys=keys)

    # routes and numbered streets have no spelling variants: only named streets are blocked
    named = streets.where("NOT name LIKE '#%' AND NOT name LIKE 'hwy%'")
    flat = materialise(named.mapInPandas(run, "sid bigint, num string, name string, known bigint, keys array<bigint>")
                       .select("sid", "name", "known", F.explode("keys").alias("key")), "p1k")
    # keys of one street meet nobody, which most are: they leave before the join
    shared = flat.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    flat = flat.join(shared, "key", "left_semi")
    flat = flat.select("key", "sid", "name", "known")
    left, right = flat.toDF("key", "a", "na", "ka"), flat.toDF("key", "b", "nb", "kb")
    pairs = left.join(right, "key").where("a < b AND abs(length(na) - length(nb)) <= 2").select("a", "b", "na", "nb", "ka", "kb").distinct()
    pairs = pairs.where("levenshtein(na, nb, 4) >= 0").withColumn("rare", F.expr(rare_enough("ka", "kb", STREET_TYPOS)))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [near_words(x, y) for x, y in zip(pdf["na"], pdf["nb"])]
            yield pdf.loc[ok, ["a", "b", "rare"]]

    return pairs.mapInPandas(near, "a bigint, b bigint, rare boolean")


def same_location(df: DataFrame, id_col: str, address: str, city: str) -> tuple[DataFrame, DataFrame]:
    """(membership ``id, node``, links ``a, b`` between nodes): a node is one parsed address."""
    parts = ["num", "dir", "name", "kind", "unit", "cities"]
    rows = materialise(settle(materialise(parsed(df, id_col, address, city), "p1r")), "p1s")
    nodes = materialise(rows.groupBy(*parts).agg(F.min("id").alias("node"), F.count("*").alias("n")), "p1n")
    member = materialise(skewless_lookup(rows, nodes, parts, "n").select("id", "node"), "p1m")
    streets = nodes.groupBy("num", "name").agg(F.min("node").alias("sid"))
    known = streets.groupBy("name").agg(F.count("*").alias("known"))
    streets = materialise(streets.join(known, "name").select("sid", "num", "name", "known"), "p1t")
    links = materialise(street_links(streets), "p1l")
    placed = materialise(nodes.join(streets.select("num", "name", "sid"), ["num", "name"]).select("sid", "node", *parts), "p1p")
    # a street meets itself and its near ones; both directions, so that either side may lack the city
    own = streets.select(F.col("sid").alias("a"), F.col("sid").alias("b"), F.lit(True).alias("rare"))
    both = materialise(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "rare")).unionByName(own), "p1b")
    cols = ["node", *parts]
    left = placed.select(F.col("sid").alias("a"), *[F.col(c).alias(f"l_{c}") for c in cols])
    right = placed.select(F.col("sid").alias("b"), *[F.col(c).alias(f"r_{c}") for c in cols])
    open_ = lambda s: f"size({s}_cities) = 0 OR exists({s}_cities, c -> c LIKE '{UNKNOWN_CITY}%')"
    known = left.join(both, "a").where(f"NOT ({open_('l')})").withColumn("city", F.explode("l_cities"))
    met = known.join(right.where(f"NOT ({open_('r')})").withColumn("city", F.explode("r_cities")), ["b", "city"]).drop("city").where("l_node < r_node")
    wild = left.where(open_("l")).join(both.where("rare"), "a").join(right, "b").where(f"l_node < r_node OR l_node > r_node AND NOT ({open_('r')})")
    fits = " AND ".join(f"(l_{c} = r_{c} OR l_{c} = '' OR r_{c} = '')" for c in ("dir", "kind", "unit"))
    cand = met.unionByName(wild.select(met.columns)).where(fits)

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            l = list(zip(*[pdf[f"l_{c}"] for c in parts[:-1]], map(tuple, pdf["l_cities"])))  # noqa: E741
            r = list(zip(*[pdf[f"r_{c}"] for c in parts[:-1]], map(tuple, pdf["r_cities"])))
            ok = [same_place(x, y) for x, y in zip(l, r)]
            l, r = pdf["l_node"][ok], pdf["r_node"][ok]  # noqa: E741
            yield pd.DataFrame({"a": np.minimum(l, r), "b": np.maximum(l, r)})

    # nodes that share several cities meet more than once
    return member, cand.drop("a", "b").mapInPandas(aligned, "a bigint, b bigint").distinct()


def pairs_of(member: DataFrame, links: DataFrame) -> DataFrame:
    """Row pairs ``(a, b)``, a < b: all rows of one node and of linked nodes."""
    inner = pairs_within(member, "id", "node").toDF("a", "b")
    l, r = member.toDF("ra", "a"), member.toDF("rb", "b")  # noqa: E741
    x = links.join(l, "a").join(r, "b")
    return inner.unionByName(x.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")))


def p1_found(spark, sf_dir: str) -> DataFrame:
    """``listing_a, listing_b`` (a < b): listings whose addresses denote one location."""
    member, links = same_location(table(spark, sf_dir, "marin").select("listing_id", "address", "city"), "listing_id", "address", "city")
    return pairs_of(member, materialise(links, "p1x")).toDF("listing_a", "listing_b")


QUERIES = {"p1_found": p1_found}
SQL: dict[str, str] = {}
