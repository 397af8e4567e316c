"""Problem 4: near-duplicate texts by SuperMinHash, banding, verification and union-find.

Texts with the same set of words collapse first (map-side aggregated), so a text that a third of all
rows hold is one node. SuperMinHash gives every word a random permutation of the signature's slots
and a rank per step; slots take the least step + rank, steps stop early once every slot of a text is
filled below the next step. Bands of the signature block candidates, a bit sketch of the signature
discards most false ones (a pair at the threshold is lost with probability below 2e-4), the word sets
of the rest are compared exactly and accepted pairs are closed by connected components.

Buckets of more than ``STAR`` nodes don't emit all pairs: each node is compared with the bucket's least
node, and after components are known the remaining pairs of different components are compared,
so no candidate is dropped.

Null texts and texts of fewer than ``min_words`` words take no part. One text never links to itself."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.common import components, skewless_lookup
from rosterlake.session import drop_work, materialise, table

THRESHOLD = 0.7
MIN_WORDS = 30
BANDS, ROWS = 64, 8
#: Bits of the sketch and the least number of equal bits of a candidate; at similarity 0.7 the mean
#: of equal bits is 108.8 with a standard deviation of 4.04.
SKETCH_BITS, SKETCH_LEAST = 128, 94
STAR = 48
PASSES = 2
#: Words are 48-bit hashes: two words of one pair of texts collide with a probability below 1e-10.
WORD_BITS = 2**48 - 1
#: Binary logarithm of the bits of ``may_hold``: 8 MB.
MAP_BITS = 26

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def signatures(words: np.ndarray, sizes: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures (len(sizes) x m float64) of sets given as concatenated 64-bit hashes.

    Vectorised over all sets of a batch: step j moves every word's permutation by one swap and offers
    the value j + rank to the slot it reaches; a set leaves once all its slots hold values below j + 1."""
    n = len(sizes)
    distinct, back = np.unique(words.astype(np.uint64), return_inverse=True)
    perm = np.broadcast_to(np.arange(m, dtype=np.int16), (len(distinct), m)).copy()
    sig = np.full(n * m, np.inf)
    owner = np.repeat(np.arange(n), sizes)
    live_doc = np.ones(n, bool)
    rows = np.arange(len(distinct))
    used = np.unique(back)
    for j in range(m):
        with np.errstate(over="ignore"):
            h = _mix(distinct[used] + np.uint64(2 * j + 1) * np.uint64(0x9E3779B97F4A7C15))
            g = _mix(distinct[used] ^ np.uint64(j + 1) * np.uint64(0xD1B54A32D192ED03))
        k = j + ((h >> np.uint64(11)).astype(np.float64) * 2.0**-53 * (m - j)).astype(np.int64)
        r = rows[used]
        a, b = perm[r, j].copy(), perm[r, k].copy()
        perm[r, j], perm[r, k] = b, a
        value = np.empty(len(distinct))
        value[used] = j + (g >> np.uint64(11)).astype(np.float64) * 2.0**-53
        slot = owner * m + perm[back, j]
        np.minimum.at(sig, slot, value[back])
        if j % 8 == 7 or j == m - 1:
            full = sig.reshape(n, m).max(1) < j + 1
            live_doc &= ~full
            if not live_doc.any():
                break
            keep = live_doc[owner]
            if not keep.all():
                owner, back = owner[keep], back[keep]
                used = np.unique(back)
    return sig.reshape(n, m)


def words_of(col: str) -> Column:
    """Runs of letters and digits of the lower-cased text, in order, repeats kept."""
    return F.expr(rf"regexp_extract_all(lower({col}), '[\\p{{L}}\\p{{N}}]+', 0)")


def word_sets(df: DataFrame, id_col: str, text_col: str, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(membership ``id, node``; nodes ``node, ws`` with the sorted hashes of distinct words).

    A node is the least id of the rows with the same word set, which two 64-bit hashes identify. Rows of equal
    text are first counted by two hashes of the text alone, so that only one row of each text (besides a
    few that ``may_hold`` lets through) is split and its words written, however often a text is repeated."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    texts = materialise(rows.select("id", F.xxhash64("text").alias("t1"), F.expr("xxhash64(text, 7)").alias("t2")), "p4t")
    first = materialise(texts.groupBy("t1", "t2").agg(F.min("id").alias("id"), F.count("*").alias("n")), "p4f")
    # generated rather than projected, or the filter would move below and split every text twice
    toks = may_hold(rows, first, "id").select("id", F.explode(F.array(words_of("text"))).alias("w")).where(F.size("w") >= min_words)
    sets = toks.select("id", F.sort_array(F.array_distinct(F.transform("w", lambda x: F.xxhash64(x).bitwiseAND(F.lit(WORD_BITS))))).alias("ws"))
    sets = materialise(sets.select("id", "ws", F.xxhash64("ws").alias("k1"), F.expr("xxhash64(ws, 7)").alias("k2")), "p4w")
    least = materialise(sets.groupBy("k1", "k2").agg(F.min("id").alias("node"), F.count("*").alias("n")), "p4l")
    of = skewless_lookup(sets.select("id", "k1", "k2"), least, ["k1", "k2"], "n").select("id", "node")
    node_of = materialise(first.join(of, "id").select("t1", "t2", "node", "n"), "p4o")
    nodes = materialise(sets.join(least.select(F.col("node").alias("id")), "id", "left_semi").select(F.col("id").alias("node"), "ws"), "p4n")
    drop_work(sets, least, first)
    member = materialise(skewless_lookup(texts, node_of, ["t1", "t2"], "n").select("id", "node"), "p4m")
    drop_work(texts, node_of)
    return member, nodes


def may_hold(rows: DataFrame, some: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be among those of ``some``: all that are and others that share a bit of a
    bitmap of fixed size, which is broadcast. Many keys fill it and it lets everything through."""
    at = F.pmod(F.xxhash64(key), F.lit(1 << MAP_BITS))
    bits = some.select(F.shiftright(at, 15).cast("int").alias("bucket"), at.bitwiseAND(F.lit(32767)).alias("bit"))
    bits = bits.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))  # 4 KB each
    told = rows.withColumn("bucket", F.shiftright(at, 15).cast("int")).withColumn("bit", at.bitwiseAND(F.lit(32767)).cast("int"))
    byte = F.expr("cast(conv(hex(substring(bitmap, bit div 8 + 1, 1)), 16, 10) AS int)")
    return told.join(F.broadcast(bits), "bucket").where(F.getbit(byte, F.col("bit") % 8) == 1).select(*rows.columns)


def band_rows(nodes: DataFrame, bands: int, rows: int) -> DataFrame:
    """``node, keys, s0, s1, n``: one key per band, the sketch bits and the set size; materialised."""
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # lists go in and out as flat arrays with offsets, without an object per row
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                part = whole.slice(at, 1000)
                ws = part.column("ws")
                sizes = ws.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                sig = signatures(ws.flatten().to_numpy(zero_copy_only=False).view(np.uint64), sizes, m)
                raw = _mix(sig.view(np.uint64) + np.arange(m, dtype=np.uint64))
                # one bit of each of the slots of the first SKETCH_BITS
                bits = np.packbits((raw[:, :SKETCH_BITS] & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
                keys = np.zeros((len(sizes), bands), np.uint64)
                with np.errstate(over="ignore"):
                    for r in range(rows):
                        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + raw[:, r::rows])
                    # the band and 40 bits of hash; a false meeting is verified away
                    keys = keys >> np.uint64(24) | np.arange(bands, dtype=np.uint64) << np.uint64(40)
                offsets = pa.array(np.arange(0, (len(sizes) + 1) * bands, bands, dtype=np.int32))
                listed = pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("node"), listed, pa.array(np.ascontiguousarray(bits[:, 0])), pa.array(np.ascontiguousarray(bits[:, 1])), pa.array(sizes)], names=["node", "keys", "s0", "s1", "n"])

    kind = nodes.schema["node"].dataType.simpleString()
    return materialise(nodes.mapInArrow(run, f"node {kind}, keys array<bigint>, s0 bigint, s1 bigint, n bigint"), "p4s")


def bucket_pairs(keyed: DataFrame) -> DataFrame:
    """Candidates ``a < b`` and, with ``b`` null, one row ``key, a`` per node of each large bucket.

    One shuffle: rows sorted by key (the order of a bucket's nodes doesn't matter) stream through each task, which holds one bucket's first STAR
    nodes at most, so a bucket of any size passes in bounded memory."""
    flat = keyed.select(F.explode("keys").alias("key"), "node").repartition("key").sortWithinPartitions("key")  # one long: a radix sort

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry_key, carry = None, np.empty(0, np.int64)  # first nodes of the bucket that goes on
        carried = 0
        for pdf in batches:
            key, node = pdf["key"].to_numpy(), pdf["node"].to_numpy()
            if carry_key is not None and key[0] == carry_key:
                # of a long bucket only its first node matters to later ones
                key = np.concatenate([np.full(len(carry), carry_key), key])
                node = np.concatenate([carry, node])
                seen = carried
            else:
                seen = 0
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(starts, len(key)))
            a, b, k = [], [], []
            first_new = len(carry) if seen else 0
            two = (sizes == 2)
            if seen:
                two[0] = False
            at = starts[two]
            a.append(node[at]), b.append(node[at + 1]), k.append(key[at])
            # all buckets of one size at once
            whole = (sizes > 2) & (sizes <= STAR)
            whole[0] = False
            for n in np.unique(sizes[whole]).tolist():
                at = starts[whole & (sizes == n)]
                x, y = np.triu_indices(n, 1)
                a.append(node[at[:, None] + x].ravel()), b.append(node[at[:, None] + y].ravel()), k.append(np.repeat(key[at], len(x)))
            rest = (sizes > STAR) | (np.arange(len(sizes)) == 0) & (sizes > 1)
            for s, n in zip(starts[rest].tolist(), sizes[rest].tolist()):
                if n == 2 and not (seen and s == 0):
                    continue
                group = node[s:s + n]
                done = first_new if s == 0 else 0  # pairs among carried nodes are out already
                total = seen + n - done if s == 0 else n
                x, y = np.triu_indices(min(n, STAR), 1)
                fresh = y >= done
                a.append(group[x[fresh]]), b.append(group[y[fresh]]), k.append(np.full(int(fresh.sum()), key[s]))
                if total > STAR:
                    late = np.arange(max(min(n, STAR), done), n)
                    a.append(np.full(len(late), group[0])), b.append(group[late]), k.append(np.full(len(late), key[s]))
                    # the members themselves, for the pass across components
                    mem = group[done:] if seen > STAR and s == 0 else group
                    a.append(mem), b.append(np.full(len(mem), -1)), k.append(np.full(len(mem), key[s]))
            last, n_last = starts[-1], sizes[-1]
            carried = (seen + n_last - first_new) if (last == 0 and seen) else n_last
            carry_key, carry = key[-1], node[last:last + min(n_last, STAR)]
            a, b = np.concatenate(a), np.concatenate(b)
            swap = (b != -1) & (a > b)
            yield pd.DataFrame({"key": np.concatenate(k), "a": np.where(swap, b, a), "b": np.where(swap, a, b)})

    kind = keyed.schema["node"].dataType.simpleString()
    return flat.mapInPandas(run, f"key bigint, a {kind}, b {kind}")


def verify(pairs: DataFrame, sketch: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose word sets are similar enough, by sketch and then exactly."""
    s = sketch
    p = pairs.join(s.toDF("a", "a0", "a1", "na"), "a").join(s.toDF("b", "b0", "b1", "nb"), "b")
    equal = F.lit(SKETCH_BITS) - F.expr("bit_count(a0 ^ b0) + bit_count(a1 ^ b1)")
    p = p.where((equal >= SKETCH_LEAST) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9)).select("a", "b")
    p = p.join(nodes.toDF("a", "wa"), "a").join(nodes.toDF("b", "wb"), "b")
    both = F.size(F.array_intersect("wa", "wb"))
    return p.where(both >= threshold * (F.size("wa") + F.size("wb") - both) - 1e-9).select("a", "b")


def near_groups(df: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``id, root`` of every row that has a partner: root is the least id of its group."""
    member, nodes = word_sets(df, id_col, text_col, min_words)
    keyed = band_rows(nodes, bands, rows)
    # bands in passes, so that the shuffle files of one pass are gone before the next
    each = bands // PASSES
    found = [materialise(bucket_pairs(keyed.select("node", F.slice("keys", i * each + 1, each if i < PASSES - 1 else bands).alias("keys"))), "p4b") for i in range(PASSES)]
    found = reduce(DataFrame.unionByName, found)
    sketch = materialise(keyed.select("node", "s0", "s1", "n"), "p4k")
    drop_work(keyed)
    hot = found.where("b = -1").select("key", F.col("a").alias("node"))
    links = materialise(verify(found.where("b <> -1").select("a", "b").distinct(), sketch, nodes, threshold), "p4v")
    roots = materialise(components(links), "p4c")
    if not hot.isEmpty():
        # pairs of one large bucket that are not yet of one component
        tagged = materialise(hot.join(roots.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node")), "p4h")
        mixed = tagged.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
        tagged = tagged.join(mixed, "key", "left_semi")
        left, right = tagged.select("key", "node", "root").toDF("key", "a", "ra"), tagged.select("key", "node", "root").toDF("key", "b", "rb")
        across = left.join(right, "key").where("ra < rb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = materialise(links.unionByName(verify(across, sketch, nodes, threshold)), "p4v")
        roots = materialise(components(links), "p4c")
    drop_work(links)
    full = member.join(roots.withColumnRenamed("id", "node"), "node", "left").select("id", F.coalesce("root", "node").alias("root"))
    return full


def p4_found(spark, sf_dir: str) -> DataFrame:
    """``first_id, other_id``: each listing after the first of its group of near-duplicate descriptions."""
    groups = near_groups(table(spark, sf_dir, "marin").select("listing_id", "vendor_description"), "listing_id", "vendor_description")
    return groups.where("id <> root").select(F.col("root").alias("first_id"), F.col("id").alias("other_id"))


QUERIES = {"p4_found": p4_found}
SQL: dict[str, str] = {}
