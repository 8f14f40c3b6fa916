"""Benchmark decontamination by greedy string tiling.

Words are `\\w+` of the lower-cased text.  Documents and test items that share a seed of `least`
words are compared: running Karp-Rabin finds the longest matches of unmarked words, they are marked
as tiles, longest first, and the search length falls until no match of `least` words is left
(Wise, "String Similarity via Greedy String Tiling and Running Karp-Rabin Matching", 1993).  A
document is contaminated if its tiles cover `threshold` of an item's words, in whatever order the
passages stand.

The benchmark goes to the tasks in blocks of at most `block_words` words, one pass of the same scan
for each, so its size is bounded by a parameter and every item meets every document.

Null and empty texts match nothing, and so do items of fewer than `least` words; repeated rows and
ids are judged each on its own text; an empty benchmark leaves every document clean; an empty table
gives an empty result; other columns pass through untouched (an older `hits` is replaced).
"""

from __future__ import annotations

import re
from bisect import insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import steps

_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(max(n - 1, 0), base, np.uint64))))[:n]


class KarpRabin:
    """Hashes of all windows of any length of one sequence, from prefix sums modulo 2**64."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((ids + 1).astype(np.uint64) * _powers(_BASE, self.n), dtype=np.uint64)))
        self.back = _powers(_INVERSE, self.n)

    def windows(self, length: int) -> np.ndarray:
        n = self.n - length + 1
        return (self.sums[length:] - self.sums[:n]) * self.back[:n] if n > 0 else np.empty(0, np.uint64)


def _free(marked: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows without a marked word."""
    sums = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(sums[length:] == sums[: len(sums) - length])


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item start, text start, length) of two id sequences; ids below 0 match nothing."""
    found: list[tuple[int, int, int]] = []
    in_item, in_text = item < 0, text < 0
    item_hash, text_hash = KarpRabin(item), KarpRabin(text)
    size = min(len(item), len(text))
    while size >= least:
        queue: list[tuple[int, int, int]] = []  # (-length, item start, text start)
        starts = _free(in_text, size)
        hashes = text_hash.windows(size)[starts]
        order = np.argsort(hashes, kind="stable")
        hashes, starts = hashes[order], starts[order]
        asked = _free(in_item, size)
        wanted = item_hash.windows(size)[asked]
        lo, hi = np.searchsorted(hashes, wanted, "left"), np.searchsorted(hashes, wanted, "right")
        for k in np.flatnonzero(hi > lo):
            p = int(asked[k])
            for t in starts[lo[k] : hi[k]].tolist():
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and not in_item[p + n] and not in_text[t + n]:
                    n += 1
                if n >= size:
                    insort(queue, (-n, p, t))
        longest = -queue[0][0] if queue else 0
        if longest > 2 * size:
            size = longest
            continue
        while queue:
            n, p, t = queue.pop(0)
            n = -n
            taken = in_item[p : p + n] | in_text[t : t + n]
            if taken.any():
                n = int(np.argmax(taken))
                if n >= size:
                    insort(queue, (-n, p, t))
                continue
            found.append((p, t, n))
            in_item[p : p + n] = in_text[t : t + n] = True
        size = size // 2 if size > 2 * least else least if size > least else 0
    return found


class Benchmark:
    """A block of test items with the index of their seeds."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.least = least
        self.vocabulary: dict[str, int] = {}
        self.ids: list[int] = []
        self.words: list[np.ndarray] = []
        for item_id, text in items:
            words = _WORD.findall((text or "").lower())
            if len(words) >= least:
                self.ids.append(item_id)
                self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64))
        hashes = [KarpRabin(w).windows(least) for w in self.words]
        self.seed = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.of = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]) if hashes else np.empty(0, np.int64)
        self.at = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, np.int64)
        order = np.argsort(self.seed, kind="stable")
        self.seed, self.of, self.at = self.seed[order], self.of[order], self.at[order]
        self.powers = _powers(_BASE, least)

    def coverage(self, text: str | None, threshold: float) -> list[tuple[int, float]]:
        """(item, covered share) of the items covered by `threshold` at least."""
        words = _WORD.findall(text.lower()) if text else []
        n = len(words) - self.least + 1
        if n <= 0 or not len(self.seed):
            return []
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        starts = _free(ids < 0, self.least)
        if not len(starts):
            return []
        grams = sum((ids[starts + j] + 1).astype(np.uint64) * self.powers[j] for j in range(self.least))
        near = np.searchsorted(self.seed, grams)
        hit = self.seed[np.minimum(near, len(self.seed) - 1)] == grams
        if not hit.any():
            return []
        seeds: dict[int, set[int]] = defaultdict(set)
        for g in np.unique(grams[hit]):
            for k in range(np.searchsorted(self.seed, g, "left"), np.searchsorted(self.seed, g, "right")):
                seeds[int(self.of[k])].add(int(self.at[k]))
        out = []
        for item, places in seeds.items():
            words_of = self.words[item]
            reach = len({p + j for p in places for j in range(self.least)}) / len(words_of)
            if reach >= threshold:  # no tiling covers more
                covered = sum(t[2] for t in tiles(words_of, ids, self.least)) / len(words_of)
                if covered >= threshold:
                    out.append((self.ids[item], covered))
        return out


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """The items, a block of about `block_words` words at a time."""
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    total = rows.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
    n = max(1, -(-total // block_words))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for k in range(n):
        yield [(r.item_id, r.text) for r in dealt.where(F.col("block") == k).collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.6, block_words: int = 2_000_000) -> DataFrame:
    """`docs` with `hits`: the items that a document holds, and the share of their words."""
    spark, docs = docs.sparkSession, docs.drop("hits")
    hits = T.ArrayType(T.StructType([T.StructField("item_id", benchmark.schema["item_id"].dataType), T.StructField("coverage", T.DoubleType())]))
    out = docs.withColumn("hits", F.array().cast(hits))
    schema = T.StructType([*docs.schema.fields, T.StructField("hits", hits)])
    for items in _blocks(benchmark, block_words):
        block = spark.sparkContext.broadcast(Benchmark(items, least))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for b in steps(batches):
                texts = b.column("text").to_pylist()
                before = b.column("hits").to_pylist()
                now = [[*old, *({"item_id": i, "coverage": c} for i, c in block.value.coverage(t, threshold))] for old, t in zip(before, texts)]
                at = b.schema.get_field_index("hits")
                yield b.set_column(at, "hits", pa.array(now, b.schema.field(at).type))

        out = out.mapInArrow(run, schema)
    return out
