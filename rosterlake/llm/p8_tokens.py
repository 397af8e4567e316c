"""Problem 8: token ids of every text by speculation and verification.

Texts are split by the tokenizer's pattern; each distinct word of a task is encoded once. Greedy
longest match over the vocabulary proposes tokens. A sequence of tokens is the byte-pair encoding of
its bytes exactly if each two neighbours are the encoding of their own concatenation, so a vectorised
check of all adjacent pairs (one lookup per distinct pair) verifies the proposals of a whole batch at
once, and only the words with a failing pair undergo exact merging.

Map-only: no shuffle, no state beyond a bounded cache of words per task. Null and empty texts give
an empty list of ids. Long words (runs without a split point) merge in O(n log n)."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.session import table

DEFAULT_DIR = "/opt/tokenizers"
DEFAULT_FILE = "byte_bpe_50k.tiktoken"
# Fixed value: the public split pattern of the byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept per Python worker; beyond it the cache starts anew, which changes no result.
CACHE_WORDS = 200_000
#: Words longer than this many bytes are not cached.
CACHE_BYTES = 64


class SpeculativeEncoder:
    """Encoder of one rank file; build once per Python worker."""

    def __init__(self, path: str, pattern: str = SPLIT):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.split = regex.compile(pattern)
        self.words: dict[str, np.ndarray] = {}
        self.pairs: dict[int, bool] = {}
        self.speculated = self.merged = 0

    def merge(self, word: bytes) -> list[int]:
        """Exact byte-pair merging, lowest rank first and leftmost on ties, with a heap over a linked list."""
        ranks = self.ranks
        if word in ranks and len(word) == 1:
            return [ranks[word]]
        parts: list[bytes | None] = [word[i:i + 1] for i in range(len(word))]
        n = len(parts)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, size = heapq.heappop(heap)
            left = parts[i]
            j = nxt[i]
            if left is None or j >= n or len(left) + len(parts[j]) != size or ranks.get(left + parts[j]) != r:
                continue
            parts[i] = left + parts[j]
            parts[j] = None
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if (q := ranks.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (q, i, len(parts[i]) + len(parts[k])))
            if (h := prv[i]) >= 0 and (q := ranks.get(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (q, h, len(parts[h]) + len(parts[i])))
        return [ranks[p] for p in parts if p is not None]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, i, n, ranks = [], 0, len(word), self.ranks
        while i < n:
            for size in range(min(self.longest, n - i), 0, -1):
                r = ranks.get(word[i:i + size])
                if r is not None:
                    out.append(r)
                    i += size
                    break
        return out

    def learn(self, words: list[str]) -> dict[str, np.ndarray]:
        """Encode distinct words: propose, check all adjacent pairs at once, merge the failing ones."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        # a run of one character can't profit from greedy matching; all words go through the same check
        seqs = [self.propose(w) for w in raw]
        sizes = np.fromiter(map(len, seqs), np.int64, len(seqs))
        flat = np.fromiter((t for s in seqs for t in s), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        if len(flat) > 1:
            keys = flat[:-1] << 32 | flat[1:]
            inner = np.ones(len(keys), bool)
            inner[ends[:-1] - 1] = False  # the pair across two words is none
            distinct, back = np.unique(keys[inner], return_inverse=True)
            good = np.fromiter(map(self.compatible, distinct.tolist()), bool, len(distinct))
            ok_pair = np.ones(len(keys), bool)
            ok_pair[inner] = good[back]
            bad = np.add.reduceat(np.append(~ok_pair, False), np.append(0, ends[:-1])) > 0
        else:
            bad = np.zeros(len(seqs), bool)
        self.speculated += len(seqs)
        self.merged += int(bad.sum())
        return {w: np.asarray(self.merge(raw[i]) if bad[i] else seqs[i], np.int32) for i, w in enumerate(words)}

    def compatible(self, key: int) -> bool:
        """Whether the two tokens are the exact encoding of their concatenation."""
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > 4 * CACHE_WORDS:
                self.pairs.clear()
            a, b = key >> 32, key & 0xFFFFFFFF
            ok = self.pairs[key] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return ok

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        pieces = [self.split.findall(t) if t else [] for t in texts]
        distinct = set().union(*pieces) if pieces else set()
        known = self.words
        new = [w for w in distinct if w not in known]
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = list(distinct)
        fresh = self.learn(new) if new else {}
        known.update((w, v) for w, v in fresh.items() if len(w) <= CACHE_BYTES)
        empty = np.empty(0, np.int32)
        get = lambda w: fresh[w] if w in fresh else known[w]
        return [np.concatenate([get(w) for w in p]) if p else empty for p in pieces]


_encoders: dict[str, SpeculativeEncoder] = {}


def encoder(path: str) -> SpeculativeEncoder:
    if path not in _encoders:
        _encoders[path] = SpeculativeEncoder(path)
    return _encoders[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_dir: str = DEFAULT_DIR, file: str = DEFAULT_FILE, lengths: bool = False) -> DataFrame:
    """``id_col, ids`` (or ``id_col, n_tokens`` with ``lengths``) of every row of ``docs``."""
    path = f"{tokenizer_dir}/{file}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at:at + 512]
                ids = enc.encode_batch([None if t is None or t != t else t for t in part["t"]])
                out = {id_col: part["i"].to_numpy()}
                out |= {"n_tokens": np.fromiter(map(len, ids), np.int64, len(ids))} if lengths else {"ids": ids}
                yield pd.DataFrame(out)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInPandas(run, f"{id_col} {kind}, " + ("n_tokens bigint" if lengths else "ids array<int>"))


def spread(docs: DataFrame, partitions_per_core: int = 2) -> DataFrame:
    """Split the rows over the cores if the files make fewer tasks than there are cores."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores * partitions_per_core)


def p8_ids(spark, sf_dir: str) -> DataFrame:
    """``doc_id, ids`` by byte_bpe_50k, no special tokens; null and empty texts give an empty list."""
    return encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {"p8_ids": p8_ids}
SQL: dict[str, str] = {}
