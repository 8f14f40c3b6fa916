"""Removal of passages that an earlier document has, by seed and extend.

A window is `window` consecutive words.  Its anchor is the least hash of its `gram`-word grams, so
equal windows have equal anchors (winnowing), and neighbouring windows mostly share one.

1. Seed: documents are joined on their anchors; anchors of one document only drop out.  The least
   document with an anchor need not hold the whole window, so the windows around shared anchors
   choose by a 64-bit hash the least document that has them, and a place in it.  A document thus
   meets one partner a window, never all documents with the anchor.  Windows of one pair on one
   diagonal and in one block of the partner are one seed.
2. Extend: the partner's block (`_BLOCK` words and as many as a window needs beyond) goes to the
   document, and both are compared word by word along the diagonal, to both sides of the seed.
   Runs of `window` or more equal words are matches; equal hashes of different words give none.
3. Matches of neighbouring blocks join to one.  A match ends where the words differ, or at a block
   from which on all windows have another (smaller) partner.  Words in matches are removed; joined
   over all partners they are the maximal repeats.

Each grouping is combined before its shuffle, and each join is an equi-join that Spark can split
where a key is hot; no step pairs the documents of a group, so a passage costs a row a document and
block.  A document's seeds and blocks are bounded by its own windows.

Null and empty texts have no words; texts under `window` words keep all; equal windows inside one
document, or in rows of the same id, remove nothing from each other; rows with a null id keep all;
an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, encode_words, materialise, steps

#: Window starts in a block of the partner.
_BLOCK = 32
#: Seeds that are compared in one vectorised step.
_SEEDS = 1 << 14

_POWER = 0x9E3779B97F4A7C15
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _mixed(x: np.ndarray) -> np.ndarray:
    for m in _MIX:
        x = (x ^ (x >> np.uint64(33))) * m
    return x ^ (x >> np.uint64(33))


def _word_hashes(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's bytes: its lanes of eight bytes, mixed by their place, and its length."""
    distinct = distinct.cast(pa.large_binary())
    bounds = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
    size = np.diff(bounds)
    if not len(size):
        return np.empty(0, np.uint64)
    data = np.frombuffer(distinct.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    lanes = -(-size // 8)
    first = np.cumsum(lanes) - lanes
    filled = np.zeros(int(lanes.sum()) * 8, np.uint8)
    filled[np.arange(len(data)) + np.repeat(first * 8 - (bounds[:-1] - bounds[0]), size)] = data
    place = np.arange(len(filled) // 8) - np.repeat(first, lanes)
    mixed = _mixed(filled.view(np.uint64) ^ _mixed((place.astype(np.uint64) + np.uint64(1)) * np.uint64(_POWER)))
    return _mixed(np.add.reduceat(mixed, first) + size.astype(np.uint64) * np.uint64(_POWER))


def _gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words."""
    k = len(words) - n + 1
    if k <= 0:
        return np.empty(0, np.uint64)
    return _mixed(sum(words[j : j + k] * np.uint64(pow(_POWER, j, 1 << 64)) for j in range(n)))


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    done = 1
    while done < n:
        step = min(done, n - done)
        x, done = np.minimum(x[:-step], x[step:]), done + step
    return x


class Windows:
    """Windows of a batch of texts: their anchors, places and rows."""

    def __init__(self, text: pa.Array, window: int, gram: int):
        distinct, index, self.offsets = encode_words(text)
        self.words = words = _word_hashes(distinct)[index]
        self.window = window
        n = np.diff(self.offsets)
        k = max(0, len(words) - window + 1)
        self.start = np.zeros(len(words), bool)  # of words that start a window of one text
        row = np.repeat(np.arange(len(n)), n)
        left = self.offsets[1:][row] - np.arange(len(words))
        self.start[left >= window] = True
        at = np.flatnonzero(self.start[:k])
        self.row, self.at = row[at], at
        if len(at):
            self.anchor = _sliding_min(_gram_hashes(words, gram), window - gram + 1)[at].view(np.int64)
        else:
            self.anchor = np.empty(0, np.int64)
        # the first window of every run of one row with one anchor
        self.first = np.ones(len(at), bool)
        self.first[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.row[1:] != self.row[:-1])

    def around(self, seeds: np.ndarray) -> np.ndarray:
        """The windows whose anchor is among `seeds`."""
        return np.flatnonzero(np.isin(self.anchor[self.first], seeds)[np.cumsum(self.first) - 1])

    def content(self, which: np.ndarray) -> np.ndarray:
        """Hashes of all words of windows."""
        return _gram_hashes(self.words, self.window)[self.at[which]].view(np.int64)


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"))


def _anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            w = Windows(b.column("text"), window, gram)
            if len(w.anchor):
                yield pa.RecordBatch.from_arrays([pa.array(w.anchor[w.first]), b.column("doc_id").take(pa.array(w.row[w.first]))], ["anchor", "doc_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _docs(docs).where("doc_id is not null").mapInArrow(run, f"anchor bigint, doc_id {kind}")


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Keys of two documents at least, with the least one."""
    return rows.groupBy(key).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select(key, "least")


def seeds(docs: DataFrame, window: int = 13, gram: int = 5) -> DataFrame:
    """(doc_id, source, block, shift): a row a document, least document with some of its windows,
    block of that one's words and diagonal (place in doc_id less place in source)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    anchors = materialise(_anchors(docs, window, gram), "anchors")
    seeded = anchors.join(_shared(anchors, "anchor"), "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("seeds"))
    seeded = materialise(seeded, "seeds")
    discard(anchors)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            w = Windows(b.column("text"), window, gram)
            # an anchor that is shared is a seed of every document that has it
            near = w.around(pc.list_flatten(b.column("seeds")).to_numpy())
            if len(near):
                row = w.row[near]
                columns = [pa.array(w.content(near)), b.column("doc_id").take(pa.array(row)), pa.array((w.at[near] - w.offsets[row]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["content", "doc_id", "at"])

    near = _docs(docs).join(seeded, "doc_id").select("doc_id", "text", "seeds")
    near = near.mapInArrow(around, f"content bigint, doc_id {kind}, at int")
    near = materialise(near, "windows")
    least = near.groupBy("content").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("most"), F.min_by("at", "doc_id").alias("place"))
    met = near.join(least.where("source < most").drop("most"), "content").where("doc_id > source")
    pairs = met.selectExpr("doc_id", "source", f"CAST(place div {_BLOCK} AS INT) AS block", "at - place AS shift").distinct()
    pairs = materialise(pairs, "pairs")
    discard(seeded, near)
    return pairs


def _blocks(docs: DataFrame, pairs: DataFrame, window: int) -> DataFrame:
    """(source, block, words): the words of the blocks in which pairs have a seed."""
    width = _BLOCK + window - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            out = [], [], []
            for i, (text, blocks) in enumerate(zip(b.column("text"), b.column("blocks").to_pylist())):
                words = (text.as_py() or "").encode().split()
                for k in blocks:
                    part = words[k * _BLOCK : k * _BLOCK + width]
                    if len(part) >= window:
                        for column, value in zip(out, (i, k, b" ".join(part).decode())):
                            column.append(value)
            row, block, words = out
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(block, pa.int32()), pa.array(words, pa.string())], ["source", "block", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = pairs.groupBy(F.col("source").alias("doc_id")).agg(F.collect_set("block").alias("blocks"))
    found = _docs(docs).join(wanted, "doc_id").select("doc_id", "text", "blocks")
    # rows of one id may have the same block
    return found.mapInArrow(cut, f"source {kind}, block int, words string").distinct()


def extend(texts: pa.Array, owner: np.ndarray, source: np.ndarray, block: np.ndarray, shift: np.ndarray, words: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds compared word by word with their texts, along their diagonals.

    Seed k is of text `owner[k]`.  Returns the matches, rows of (owner, source, start, end, start in
    source) by owner, and the texts' lengths in words.
    """
    order = np.lexsort((block, shift, source, owner))
    owner, source, block, shift = (x[order].astype(np.int64) for x in (owner, source, block, shift))
    _, index, offsets = encode_words(pa.concat_arrays([texts, words.take(pa.array(order))]))
    n = len(texts)
    size = np.diff(offsets)
    step = np.arange(_BLOCK + window - 1)
    begin = block * _BLOCK + shift
    full = np.empty((len(owner), _BLOCK), bool)
    for low in range(0, len(owner), _SEEDS):  # memory is bounded by a slice of seeds
        part = slice(low, low + _SEEDS)
        at = begin[part, None] + step
        inside = (step < size[n:][part, None]) & (at >= 0) & (at < size[:n][owner[part]][:, None])
        row, k = np.nonzero(inside)
        equal = np.zeros(inside.shape, bool)
        equal[row, k] = index[offsets[:n][owner[part]][row] + at[row, k]] == index[offsets[n:-1][part][row] + k]
        full[part] = equal[:, :_BLOCK]
        for j in range(1, window):
            full[part] &= equal[:, j : j + _BLOCK]
    if not full.any():
        return np.empty((0, 5), np.int64), size[:n]
    # blocks of several rows of the source's id count as one
    keys = np.stack([owner, source, shift, block])
    new = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0))))
    seed, k = np.nonzero(np.logical_or.reduceat(full, new, axis=0))
    seed = new[seed]
    start = begin[seed] + k
    same = (start[1:] == start[:-1] + 1) & (keys[:3, seed[1:]] == keys[:3, seed[:-1]]).all(axis=0)
    first = np.flatnonzero(np.concatenate(([True], ~same)))
    last = np.append(first[1:], len(start)) - 1
    of, start, end = seed[first], start[first], start[last] + window
    return np.stack([owner[of], source[of], start, end, start - shift[of]], axis=1), size[:n]


def remove_repeats(docs: DataFrame, window: int = 13, gram: int = 5) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans, matches) for every row of `docs` (doc_id, text).

    kept: the kept words joined by one space; spans: the maximal repeats taken out, as (start, end)
    in words, end exclusive; matches: the matches behind them, with the other document (source) and
    the place of their first word there.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    pairs = seeds(docs, window, gram)
    blocks = materialise(_blocks(docs, pairs, window), "blocks")
    parts = pairs.join(blocks, ["source", "block"]).groupBy("doc_id").agg(F.collect_list(F.struct("source", "block", "shift", "words")).alias("parts"))
    parts = materialise(parts, "parts")
    discard(pairs, blocks)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            texts, ids, lists = b.column("text"), b.column("doc_id"), b.column("parts")
            hit = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            out: list = [None] * b.num_rows
            source_type = ids.type
            if len(hit):
                held = lists.take(pa.array(hit))
                owner = pc.list_parent_indices(held).to_numpy()
                flat = pc.list_flatten(held)
                source, block, shift, words = (pc.struct_field(flat, c) for c in ("source", "block", "shift", "words"))
                named = source.dictionary_encode()
                mine = texts.take(pa.array(hit))
                found, size = extend(mine, owner, named.indices.to_numpy(), block.to_numpy(), shift.to_numpy(), words, window)
                of = np.searchsorted(found[:, 0], np.arange(len(hit) + 1))
                names = named.dictionary.to_pylist()
                for k, i in enumerate(hit.tolist()):
                    matches, n = found[of[k] : of[k + 1]], int(size[k])
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, matches[:, 2], 1)
                    np.add.at(edge, matches[:, 3], -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    turns = np.flatnonzero(np.diff(np.concatenate(([0], covered, [0])).astype(np.int8)))
                    own = (mine[k].as_py() or "").encode().split()
                    spans = [{"start": s, "end": e} for s, e in turns.reshape(-1, 2).tolist()]
                    listed = [{"start": s, "end": e, "source": names[x], "source_start": p} for _, x, s, e, p in matches.tolist()]
                    out[i] = (n, int(covered.sum()), b" ".join([x for x, gone in zip(own, covered.tolist()) if not gone]).decode(), spans, listed)
            for i, done in enumerate(out):
                if done is None:
                    own = (texts[i].as_py() or "").encode().split()
                    out[i] = (len(own), 0, b" ".join(own).decode(), [], [])
            n, gone, kept, spans, matches = zip(*out)
            span = [("start", pa.int64()), ("end", pa.int64())]
            types = pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct(span)), pa.list_(pa.struct([*span, ("source", source_type), ("source_start", pa.int64())]))
            columns = [pa.array(c, t) for c, t in zip((n, gone, kept, spans, matches), types)]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "n_words", "n_removed", "kept", "spans", "matches"])

    rows = _docs(docs).join(parts, "doc_id", "left").select("doc_id", "text", "parts")
    span = "start:bigint,end:bigint"
    return rows.mapInArrow(cut, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string, spans array<struct<{span}>>, matches array<struct<{span},source:{kind},source_start:bigint>>")
