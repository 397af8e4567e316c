"""Text uniqueness: n-grams, TF-IDF, centroid, nearest neighbours, opening clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rosterlake.functions.text import opening_key, sentences, strip_ws, tokens
from rosterlake.operators import closeness
from rosterlake.session import drop_work, materialise

#: Texts of one pass of the nearest-neighbour search (broadcast), and of one product of matrices.
PASS, TILE = 8_000, 1_000


def top_ngrams(df: DataFrame, text: str, sizes: tuple[int, ...], k: int) -> DataFrame:
    """The k most frequent n-grams of each size, ties in alphabetical order. Null texts have none.

    Equal texts are counted first and carry their number. The n-grams are counted as 64-bit hashes of the
    hashes of their words; only those as frequent as the k-th of their size are spelt out and ranked."""
    texts = df.where(F.col(text).isNotNull()).groupBy(text).agg(F.count("*").alias("copies"))
    texts = materialise(texts.select(tokens(F.col(text)).alias("t"), "copies"), "ngt")
    h = F.transform("t", lambda x: F.xxhash64(x))
    ahead = F.arrays_zip(*[F.slice("h", i + 1, F.greatest(F.size("h") - i, F.lit(0))).alias(f"h{i}") for i in range(max(sizes))])
    rows = texts.select("t", "copies", h.alias("h")).select("t", "copies", F.posexplode(ahead).alias("at", "x"))
    parts = [f"x.h{i}" for i in range(max(sizes))]
    keyed = F.array_compact(F.array(*[F.when(F.col(parts[n - 1]).isNotNull(), F.struct(F.lit(n).alias("n"), F.xxhash64(*parts[:n]).alias("key"))) for n in sizes]))
    counted = materialise(rows.select("copies", F.explode(keyed).alias("g")).groupBy("g.n", "g.key").agg(F.sum("copies").alias("cnt")), "ngc")
    ranked = counted.withColumn("rnk", F.row_number().over(W.partitionBy("n").orderBy(F.desc("cnt")))).where(F.col("rnk") <= k)
    least = ranked.groupBy("n").agg(F.min("cnt").alias("least"))  # a row per size
    kept = materialise(counted.join(F.broadcast(least), "n").where("cnt >= least").select("n", "key", "cnt"), "ngk")
    spelt = rows.select("t", "at", F.explode(keyed).alias("g")).select("t", "at", "g.n", "g.key").join(kept, ["n", "key"])
    spelt = spelt.select("n", "key", "cnt", F.array_join(F.slice("t", F.col("at") + 1, F.col("n")), " ").alias("gram")).groupBy("n", "key").agg(F.min("gram").alias("gram"), F.min("cnt").alias("cnt"))
    return spelt.select("n", "gram", "cnt", F.row_number().over(W.partitionBy("n").orderBy(F.desc("cnt"), "gram")).alias("rnk")).where(F.col("rnk") <= k)


def term_counts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id, term, tf, total``: occurrences of each term and words of its text; one row is one text, so
    the runs of its sorted words are counted in place, without a shuffle."""
    words = df.select(F.col(id_col).alias("id"), F.array_sort(tokens(F.col(text))).alias("t")).where(F.size("t") > 0)
    starts = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
    runs = words.select("id", "t", F.size("t").alias("total"), starts.alias("s"))
    counted = F.transform("s", lambda x, i: F.struct(F.get("t", x).alias("term"), (F.coalesce(F.get("s", i + 1), F.col("total")) - x).alias("tf")))
    return runs.select("id", "total", F.explode(counted).alias("x")).select("id", "x.term", "x.tf", "total")


def tfidf(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id, term, w``: the term's share of its text times ln((N + 1) / (df + 1)) + 1. N counts every
    text that isn't null, those without words too; a term in every text keeps its share as weight."""
    tc = term_counts(df, id_col, text)
    n = df.where(F.col(text).isNotNull()).agg(F.count("*").alias("n_docs"))
    dfs = tc.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1
    return tc.join(dfs, "term").crossJoin(F.broadcast(n)).select("id", "term", (F.col("tf") / F.col("total") * idf).alias("w"))  # n is one row


def centroid(weights: DataFrame, docs: DataFrame) -> DataFrame:
    """Sum of the vectors over the number of texts ``docs``, those without words too."""
    n = docs.agg(F.count("*").alias("n"))
    return weights.groupBy("term").agg(F.sum("w").alias("s")).crossJoin(F.broadcast(n)).select("term", (F.col("s") / F.col("n")).alias("w"))  # n is one row


class _Vectors:
    """Texts as flat arrays: owner, term hash, unit weight; ``n`` terms of each."""

    def __init__(self, pdf: pd.DataFrame):
        self.ids, self.n = pdf["id"].to_numpy(), np.fromiter(map(len, pdf["terms"]), np.int64, len(pdf))
        self.owner, self.starts = np.repeat(np.arange(len(pdf)), self.n), np.append(0, np.cumsum(self.n))
        self.terms, w = np.concatenate(pdf["terms"].to_numpy()), np.concatenate(pdf["ws"].to_numpy())
        norm = np.sqrt(np.bincount(self.owner, w * w, minlength=len(pdf)))
        self.unit = w / norm[self.owner]

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.terms[self.starts[i]:self.starts[i + 1]], self.unit[self.starts[i]:self.starts[i + 1]]

    def dense(self, cols: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(cols, self.terms), len(cols) - 1)
        some = cols[at] == self.terms
        m = np.zeros((len(self.ids), len(cols)), np.float32)
        m[self.owner[some], at[some]] = self.unit[some]
        return m


def _improve(q: _Vectors, best: np.ndarray, c: _Vectors) -> None:
    """Raise ``best`` to the nearest of ``c``: products over the terms both sides have; a row's winner is
    computed again in double precision."""
    cols = np.intersect1d(q.terms, c.terms)
    if not len(cols):
        return
    x, y = q.dense(cols), c.dense(cols)
    sim = x @ y.T
    common = (x > 0).astype(np.float32) @ (y > 0).astype(np.float32).T
    np.maximum(sim, common / (q.n[:, None] + c.n[None, :] - common), out=sim, casting="same_kind")
    sim[q.ids[:, None] == c.ids[None, :]] = -1
    top = sim.argmax(1)
    for i in np.flatnonzero(sim[np.arange(len(top)), top] > best - 1e-6):
        (ta, wa), (tb, wb) = q.row(i), c.row(top[i])
        both, ia, ib = np.intersect1d(ta, tb, return_indices=True)
        if q.ids[i] != c.ids[top[i]]:
            best[i] = max(best[i], float(wa[ia] @ wb[ib]), len(both) / (len(ta) + len(tb) - len(both)))


def nearest(weights: DataFrame, queries: DataFrame, enough: float = 2.0) -> DataFrame:
    """For each query id the largest max(Jaccard of terms, cosine of weights) to any other text, 0 without
    words. Exact: every query meets every distinct text. From ``enough`` on the search of a query
    stops, so its value is then a similarity of at least that. ``queries`` has ``id``.

    Texts of equal words are one row; the others pass by PASS at a time as a broadcast. Terms are
    64-bit hashes; weights are positive."""
    docs = weights.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("term").alias("t"), "w"))).alias("a"))  # a text's terms
    docs = materialise(docs.select("id", F.col("a.t").alias("terms"), F.col("a.w").alias("ws")).withColumn("bag", F.xxhash64("terms", "ws")), "nd")
    bags = materialise(docs.groupBy("bag").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "nb")
    corpus = materialise(docs.join(bags.select("id"), "id", "left_semi").select("id", "terms", "ws"), "nc")
    asked = queries.join(docs.select("id", "bag"), "id").join(bags.select("bag", F.col("id").alias("rep"), "copies"), "bag")
    asked = materialise(asked.select("id", "rep", "copies"), "nq")
    passes = max(1, -(-bags.count() // PASS))
    todo = corpus.join(asked.where("copies = 1").select("id").distinct(), "id", "left_semi")
    state = materialise(todo.repartition(4 * todo.sparkSession.sparkContext.defaultParallelism).withColumn("best", F.lit(0.0)), "ns")
    for k in range(passes):
        part = corpus.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == k).toPandas()  # about PASS rows
        tiles = state.sparkSession.sparkContext.broadcast([part.iloc[i:i + TILE] for i in range(0, len(part), TILE)])
        del part

        def run(batches: Iterator[pd.DataFrame], tiles=tiles) -> Iterator[pd.DataFrame]:
            against = None
            for pdf in batches:
                against = against or [_Vectors(t) for t in tiles.value]
                best = pdf["best"].to_numpy(copy=True)
                for c in against:
                    left = np.flatnonzero(best < enough)
                    for i in range(0, len(left), TILE):
                        rows = left[i:i + TILE]
                        found = best[rows]
                        _improve(_Vectors(pdf.iloc[rows]), found, c)
                        best[rows] = found
                yield pdf.assign(best=best)

        later = materialise(state.mapInPandas(run, state.schema), "ns")
        drop_work(state)
        tiles.destroy()
        del tiles, run
        state = later
    found = asked.join(state.select(F.col("id").alias("rep"), "best"), "rep", "left").select("id", F.when(F.col("copies") > 1, 1.0).otherwise(F.col("best")).alias("similarity"))
    return queries.select("id").join(found, "id", "left").select("id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def clusters_by_frequency(df: DataFrame, key: str) -> DataFrame:
    """One row per key: size and a number by descending size, then key. The ranking window runs over the
    distinct keys; map-side counts shrink them first."""
    n = df.groupBy(key).agg(F.count("*").alias("size"))
    return n.withColumn("cluster_id", F.row_number().over(W.orderBy(F.desc("size"), key)) - 1)


def centroid_distance(weights: DataFrame, docs: DataFrame) -> DataFrame:
    """``id, distance``: 1 less the cosine of each text with words to the centroid."""
    mean = materialise(centroid(weights, docs), "tc")
    norm = mean.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    of = weights.join(mean.withColumnRenamed("w", "m"), "term").groupBy("id").agg(F.sum(F.col("w") * F.col("m")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("own"))
    return of.crossJoin(F.broadcast(norm)).select("id", (1 - F.col("dot") / (F.col("own") * F.col("length"))).alias("distance"))  # norm is one row


def uniqueness_score(size: Column, distance: Column, similarity: Column, modal: Column) -> Column:
    """1 (common) to 5 (unique) from the opening cluster's size, the distance to the centroid, the
    nearest similarity and whether the sentence count is within one of the most common one."""
    return (
        F.when((size <= 2) & (distance >= 0.35) & (similarity < 0.45), 5).when((size <= 5) & (distance >= 0.25) & (similarity < 0.55), 4)
        .when((size <= 15) & (similarity < 0.65), 3).when((size <= 40) | (similarity >= 0.72) | modal, 2).otherwise(1)
    )


#: The similarities at which a score changes.
CUTS = (0.45, 0.55, 0.65, 0.72)


def _cuts(size: Column, distance: Column, modal: Column) -> Column:
    """The cuts of ``uniqueness_score`` that decide a text, as bits by their place in CUTS."""
    small = F.when((size <= 2) & (distance >= 0.35), 1).otherwise(0) + F.when((size <= 5) & (distance >= 0.25), 2).otherwise(0)
    return F.when(size <= 15, small + 4).when((size > 40) & ~modal, 8).otherwise(0)


def uniqueness(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id, score`` of every text that isn't blank. Texts of equal words are one; of those that have no equal
    only the cuts of the score that depend on the nearest similarity are searched for."""
    m = df.where(strip_ws(F.col(text)) != "").select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    words, bag = closeness.bag_of("text")
    k = m.select("id", opening_key(F.col("text")).alias("opening"), F.greatest(F.size(sentences(F.col("text"))), F.lit(1)).alias("n_s"), bag.alias("bag"), (F.size(words) == 0).alias("wordless"))
    k = materialise(k, "tk")
    bags = materialise(k.where(~F.col("wordless")).groupBy("bag").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "tb")
    given = m.join(bags, "id").select("id", "bag", "copies", words.alias("t"))
    texts, idfs = closeness.vectors(given, k.count())
    sizes = k.groupBy("opening").agg(F.count("*").alias("size"))
    one = k.groupBy("n_s").agg(F.count("*").alias("k"), F.sum(F.col("wordless").cast("int")).alias("e")).agg(F.max(F.struct("k", (-F.col("n_s")).alias("neg"))).alias("b"), F.sum("e").alias("empties"))
    j = k.join(sizes, "opening").crossJoin(F.broadcast(one.select((-F.col("b.neg")).alias("mode"), "empties")))  # one row
    j = j.select("id", "bag", "size", "wordless", "empties", (F.abs(F.col("n_s") - F.col("mode")) <= 1).alias("modal"))
    j = j.join(texts.select("bag", F.col("id").alias("rep"), "copies", "distance"), "bag", "left")
    j = materialise(j.withColumn("distance", F.coalesce("distance", F.lit(1.0))), "tu")
    queries = j.where("copies = 1").select("id", _cuts(F.col("size"), F.col("distance"), F.col("modal")).alias("mask")).where("mask > 0")
    near = closeness.reached(texts, idfs, queries, CUTS)
    # two texts without words are equal
    sim = F.when(F.col("wordless"), F.when(F.col("empties") > 1, 1.0).otherwise(0.0)).when(F.col("copies") > 1, 1.0).otherwise(F.coalesce("similarity", F.lit(0.0)))
    return j.join(near, "id", "left").select("id", uniqueness_score(F.col("size"), F.col("distance"), sim, F.col("modal")).alias("score"))
