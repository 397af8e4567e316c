"""Problem 3: variant spellings of people and organisations, linked to the entity they name.

Packed instructor fields are split by the core's delimiter inference. Distinct names are parsed once.
A symmetric-delete index over tokens (family names of people; the telling words of an organisation,
glued in written and in sorted order, since lists glue and reorder them) finds all tokens within two
edits by an equi-join; given names meet by their own deletion keys and by what they are short for. The
tokens of candidate names are aligned by optimal assignment, where nicknames, initials, abbreviations
and typos match at a cost; a letter mistyped as one that is not its neighbour on the keyboard costs
twice. Accepted links are closed by connected components.

Two near spellings are a name and its typo only if the rarer one is as rare as a typo would be
(``common.TYPO_SHARE`` of the more frequent one, plus one); repeats of one spelling within one organisation
count once. Two edits, or a typo in each of two names, are enough only within one organisation.

A first name given as an initial joins the person of exactly that family whom it fits, if there is one
person or one among those that the same organisation names; within an organisation the family may be
misspelt as well. Initials that fit nobody in full are one person within one organisation only.
Organisations of equal telling words are one organisation; near ones are, unless both have a word of
the trade that the other lacks. A telling word given as an initial joins the only organisation it fits.

Nulls, blanks and placeholders name nobody. Relatives (same family, other first name) stay apart; a
suffix such as Jr. does not tell persons apart, since lists drop and add it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.common import components, pairs_within, rare_enough, skewless_lookup
from rosterlake.llm.name_parts import INF, deletes, given_keys, org_cost, osa, parse_org, parse_person, person_cost
from rosterlake.operators.packed import split_packed
from rosterlake.session import drop_work, materialise, table

def _most(token: str) -> int:
    return 2 if len(token) >= 7 else 1 if len(token) >= 4 else 0


def near_tokens(tokens: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of tokens (column ``tok``, unique) within the edits their length allows.

    Only keys that two tokens share reach the join; every pair is verified."""

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                rows = [(xxhash.xxh64_intdigest(k) - 2**63, t) for t in pdf["tok"].iloc[at:at + 2000] for k in deletes(t, _most(t))]
                yield pd.DataFrame(rows, columns=["key", "tok"])

    cores = tokens.sparkSession.sparkContext.defaultParallelism
    flat = materialise(tokens.select("tok").repartition(2 * cores).mapInPandas(index, "key bigint, tok string"), "p3k")
    shared = flat.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    flat = flat.join(shared, "key", "left_semi").select("key", "tok")
    pairs = flat.toDF("key", "a").join(flat.toDF("key", "b"), "key").where("a < b AND abs(length(a) - length(b)) <= 2").select("a", "b").distinct()

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [osa(x, y, 2) <= min(_most(x), _most(y)) for x, y in zip(pdf["a"], pdf["b"])]
            yield pdf[pd.Series(ok, index=pdf.index, dtype=bool)]

    return pairs.mapInPandas(check, "a string, b string")


def organisations(df: DataFrame, id_col: str, name: str) -> DataFrame:
    """``row_id, org`` for every row whose name tells an organisation; materialised."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            toks = [parse_org(v) for v in pdf["v"]]
            keep = pd.Series([t is not None for t in toks], index=pdf.index, dtype=bool)
            good = [t for t in toks if t]
            yield pd.DataFrame({"row_id": pdf["row_id"][keep], "raw": pdf["v"][keep].str.lower(), "parts": [list(t) for t, _ in good], "trade": [list(w) for _, w in good]})

    glued = F.array_join("parts", "").alias("tok")
    rows = df.where(F.col(name).isNotNull()).select(F.col(id_col).alias("row_id"), F.col(name).alias("v"))
    rows = materialise(rows.mapInPandas(parse, "row_id bigint, raw string, parts array<string>, trade array<string>"), "p3o")
    # a form is one spelling of the telling words with one set of words of the trade
    forms = rows.groupBy("parts", "trade").agg(F.count("*").alias("n"), F.countDistinct("raw").alias("nd"), F.min("row_id").alias("node")).withColumn("tok", glued)
    forms = materialise(forms, "p3f")
    spelt = materialise(forms.groupBy("tok").agg(F.sum("nd").alias("df"), F.min("node").alias("root")), "p3t")
    # each form is indexed by its words as written and in sorted order
    index = materialise(forms.select("node", F.explode(F.array_distinct(F.array("tok", F.array_join(F.sort_array("parts"), "")))).alias("tok")), "p3y")
    near = materialise(near_tokens(index.select("tok").distinct()), "p3w")
    met = near.join(index.toDF("na", "a"), "a").join(index.toDF("nb", "b"), "b").select(F.least("na", "nb").alias("na"), F.greatest("na", "nb").alias("nb"))
    # equal sorted words: each form meets the least of them
    least = index.groupBy("tok").agg(F.min("node").alias("na"))
    met = met.unionByName(index.join(least, "tok").select("na", F.col("node").alias("nb"))).where("na <> nb").distinct()
    weight = forms.join(spelt.select("tok", "df"), "tok").select("node", "tok", "parts", "trade", "df")
    side = lambda x: weight.toDF(f"n{x}", f"tok{x}", f"p{x}", f"t{x}", f"d{x}")
    cand = met.join(side("a"), "na").join(side("b"), "nb").where("toka <> tokb").where(rare_enough("da", "db"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [org_cost(tuple(x), tuple(y), tuple(t), tuple(u)) < INF for x, y, t, u in zip(pdf["pa"], pdf["pb"], pdf["ta"], pdf["tb"])]
            yield pdf.loc[pd.Series(ok, index=pdf.index, dtype=bool), ["na", "nb"]]

    same = forms.join(spelt.select("tok", "root"), "tok").select(F.col("node").alias("na"), F.col("root").alias("nb"))
    links = cand.mapInPandas(check, "na bigint, nb bigint").unionByName(same.where("na <> nb"))
    roots = components(materialise(links, "p3l"), "na", "nb")
    named = materialise(forms.join(roots.withColumnRenamed("id", "node"), "node", "left").select("parts", "trade", "n", F.coalesce("root", "node").alias("org")), "p3r")
    named = abbreviated(named)
    out = materialise(skewless_lookup(rows, named, ["parts", "trade"], "n").select("row_id", "org"), "p3x")
    drop_work(rows, forms, spelt, index, near)
    return out


def abbreviated(named: DataFrame) -> DataFrame:
    """Forms with a telling word given as an initial join the only organisation whose words they fit: the
    same longest word and the same first letters. Organisations are counted per key, never paired."""
    key = F.struct(F.expr("array_max(transform(parts, x -> struct(length(x) AS l, x AS w))).w").alias("word"), F.sort_array(F.transform("parts", lambda x: F.substring(x, 1, 1))).alias("firsts"))
    short = F.exists("parts", lambda x: F.length(x) == 1) & (F.size("parts") > 1)
    full = named.where(~short).groupBy(key.alias("key")).agg(F.min("org").alias("only"), F.max("org").alias("last")).where("only = last").select("key", "only")
    hit = named.where(short).withColumn("key", key).join(full, "key", "left").select("parts", "trade", "n", F.coalesce("only", "org").alias("org"))
    return materialise(named.where(~short).unionByName(hit), "p3ab")


def people(df: DataFrame, id_col: str, packed: str, source: str, orgs: DataFrame) -> DataFrame:
    """``row_id, person`` for every person a row names; ``orgs`` are rows and their organisations."""
    items = split_packed(df, id_col, packed, "person", source, singles=True)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, p[0], " ".join(p[1])) for i, v in zip(pdf["row_id"], pdf["item"]) if (p := parse_person(v))]
            yield pd.DataFrame(rows, columns=["row_id", "fam", "given"])

    rows = items.mapInPandas(parse, "row_id bigint, fam string, given string").distinct()
    # the organisation is the context of a mention; without one each row is its own
    rows = materialise(rows.join(orgs, "row_id", "left").withColumn("org", F.coalesce("org", -1 - F.col("row_id"))), "p3p")
    key = ["fam", "given"]
    forms = rows.groupBy(*key).agg(F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()).withColumn("first", F.substring_index("given", " ", 1))
    forms = materialise(forms, "p3q")
    member = materialise(skewless_lookup(rows.select("row_id", "org", *key), forms, key, "n").select("row_id", "org", "node"), "p3m")
    where = materialise(member.select("node", "org").distinct(), "p3h")
    near = materialise(near_tokens(forms.select(F.col("fam").alias("tok")).distinct()), "p3g")
    spell = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    full = forms.where("length(first) > 1").select("node", "fam", "given", "first")
    # how often a family name and first name are spelt so, repeats within an organisation left out
    often = full.join(where, "node").groupBy("fam", "first").agg(F.countDistinct("org").alias("df"))
    full = materialise(full.join(often, ["fam", "first"]), "p3u")

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(node, fam, k) for node, fam, given in zip(pdf["node"], pdf["fam"], pdf["given"]) for k in {k for g in given.split(" ") if len(g) > 1 for k in given_keys(g)}]
            yield pd.DataFrame(rows, columns=["node", "fam", "gk"])

    keys = materialise(full.select("node", "fam", "given").mapInPandas(keyed, "node bigint, fam string, gk string"), "p3v")
    # equal or near family, and a key of a given name in common; keys that nobody shares leave first
    moved = keys.join(spell, F.col("fam") == F.col("a")).select("node", F.col("b").alias("fam"), "gk").join(keys.select("fam", "gk").distinct(), ["fam", "gk"], "left_semi").select("node", "fam", "gk")
    met = moved.toDF("a", "fam", "gk").join(keys.toDF("b", "fam", "gk"), ["fam", "gk"]).where("a < b").select("a", "b")
    several = keys.groupBy("fam", "gk").agg(F.count("*").alias("k")).where("k > 1").select("fam", "gk")
    own = keys.join(several, ["fam", "gk"], "left_semi").select("node", "fam", "gk")
    met = met.unionByName(own.toDF("a", "fam", "gk").join(own.toDF("b", "fam", "gk"), ["fam", "gk"]).where("a < b").select("a", "b")).distinct()
    side = lambda x: full.select(F.col("node").alias(x), F.col("fam").alias(f"f{x}"), F.col("given").alias(f"g{x}"), F.col("df").alias(f"d{x}"))
    cand = met.join(side("a"), "a").join(side("b"), "b").withColumn("rare", F.expr(f"fa = fb OR {rare_enough('da', 'db')}"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cost = pd.Series([person_cost((x, tuple(g.split(" "))), (y, tuple(h.split(" ")))) for x, g, y, h in zip(pdf["fa"], pdf["ga"], pdf["fb"], pdf["gb"])], index=pdf.index, dtype=float)
            ok = cost < INF
            # one typo is enough evidence anywhere, more only within an organisation
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "alone": (cost < 2) & pdf["rare"]})[ok]

    fits = materialise(cand.mapInPandas(check, "a bigint, b bigint, alone boolean"), "p3c")
    doubt = fits.where("NOT alone").select("a", "b")
    together = doubt.join(where.toDF("a", "org"), "a").join(where.toDF("b", "org"), ["b", "org"], "left_semi").select("a", "b").distinct()
    roots = components(materialise(fits.where("alone").select("a", "b").unionByName(together), "p3d"))
    person = full.join(roots.withColumnRenamed("id", "node"), "node", "left").select("node", "fam", "given", F.coalesce("root", "node").alias("person"))
    person = materialise(person, "p3e")
    placed = materialise(person.join(where, "node").select("org", "fam", "given", "person").distinct(), "p3s")
    out = member.join(person.select("node", "person"), "node").select("row_id", "person").unionByName(initials(forms, member, person, placed, spell))
    return out.distinct()


def initials(forms: DataFrame, member: DataFrame, person: DataFrame, placed: DataFrame, spell: DataFrame) -> DataFrame:
    """``row_id, person`` of the mentions whose first name is an initial.

    ``person``: full forms and their person; ``placed``: the full forms that each organisation names."""
    short = forms.where("length(first) = 1").select("node", "fam", F.col("given").alias("ini"), "first")

    def letters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from rosterlake.llm.name_parts import _CANON

        for pdf in batches:
            cols = [c for c in pdf.columns]
            rows = [(*r, x) for r in pdf.itertuples(index=False) for g in [r[cols.index("given")].split(" ")[0]] for x in {g[0]} | {c[0] for c in _CANON.get(g, ())}]
            yield pd.DataFrame(rows, columns=[*cols, "first"])

    def fitting(pairs: DataFrame, keep: str) -> DataFrame:
        """The rows of ``pairs`` (with ini, given) whose given names agree."""
        def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from rosterlake.llm.name_parts import givens_cost

            for pdf in batches:
                ok = [givens_cost(tuple(x.split(" ")), tuple(y.split(" "))) < INF for x, y in zip(pdf["ini"], pdf["given"])]
                yield pdf.loc[pd.Series(ok, index=pdf.index, dtype=bool)].drop(columns=["ini", "given"])

        return pairs.mapInPandas(check, keep)

    # persons of the family in full: by family and letter, one row per person and set of given names
    whole = person.select("fam", "given", "person").distinct().mapInPandas(letters, "fam string, given string, person bigint, first string")
    opts = fitting(short.join(whole, ["fam", "first"]).select("node", "person", "ini", "given"), "node bigint, person bigint").distinct()
    opts = materialise(opts, "p3i")
    n_opts = opts.groupBy("node").agg(F.min("person").alias("person"), F.max("person").alias("last"))
    single = n_opts.where("person = last").select("node", "person")
    sure = member.join(single, "node").select("row_id", "node", "person")
    # several or none: those that the same organisation names, the family perhaps misspelt
    open_ = materialise(member.join(single, "node", "left_anti").join(short, "node"), "p3j")
    here = placed.mapInPandas(letters, "org bigint, fam string, given string, person bigint, first string")
    look = open_.unionByName(open_.drop("fam").join(open_.select("node", "fam").distinct().join(spell, F.col("fam") == F.col("a")).select("node", F.col("b").alias("fam")), "node").select(*open_.columns))
    near = fitting(look.join(here, ["org", "fam", "first"]).select("row_id", "node", "person", "ini", "given"), "row_id bigint, node bigint, person bigint")
    near = near.groupBy("row_id", "node").agg(F.min("person").alias("person"), F.max("person").alias("last")).where("person = last").select("row_id", "node", "person")
    near = materialise(near, "p3b")
    # fits nobody in full: one person by organisation, family and initials
    lone = open_.join(near, ["row_id", "node"], "left_anti").join(opts.select("node").distinct(), "node", "left_anti")
    lone = lone.select("row_id", "node", (-1 - F.abs(F.xxhash64("org", "fam", "ini"))).alias("person"))
    return sure.unionByName(near).unionByName(lone).select("row_id", "person")


def entities(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Organisations ``row_id, org`` and persons ``row_id, person`` of the lists."""
    src = table(spark, sf_dir, "san_diego").select("row_id", "vendor_name", "instructor_names", "source_url")
    orgs = organisations(src, "row_id", "vendor_name")
    return orgs, materialise(people(src, "row_id", "instructor_names", "source_url", orgs), "p3z")


def p3_found(spark, sf_dir: str) -> DataFrame:
    """``row_a, row_b, field_name``: rows that name the same organisation or a same person."""
    orgs, persons = entities(spark, sf_dir)
    a = pairs_within(orgs, "row_id", "org").distinct().withColumn("field_name", F.lit("vendor_name"))
    b = pairs_within(persons, "row_id", "person").distinct().withColumn("field_name", F.lit("instructor_names"))
    return a.unionByName(b)


def p3_entities(spark, sf_dir: str) -> DataFrame:
    """Membership instead of pairs: ``row_id, field_name, first_row`` with the least row that names the
    entity and ``rows``, the number of rows that do; grows with the rows, not with their pairs."""
    orgs, persons = entities(spark, sf_dir)
    both = orgs.toDF("row_id", "e").withColumn("field_name", F.lit("vendor_name")).unionByName(persons.toDF("row_id", "e").withColumn("field_name", F.lit("instructor_names")))
    size = materialise(both.groupBy("field_name", "e").agg(F.min("row_id").alias("first_row"), F.count("*").alias("rows"), F.count("*").alias("n")), "p3aa")
    return skewless_lookup(both, size, ["field_name", "e"], "n").select("row_id", "field_name", "first_row", "rows")


QUERIES = {"p3_found": p3_found, "p3_entities": p3_entities}
SQL: dict[str, str] = {}
