"""Best-fit-decreasing packing of tokenised documents into windows.

Documents longer than a window are first cut into full windows.  The rest, longest first, go to the
open window with the least room that still holds them, found by a segment tree over the remaining
capacities.  Pieces are dealt in turn, so equal rows spread, into groups of about `group_size`, each
packed in a task of its own; a group leaves a few windows with room, so the padding does not depend
on the input's size.  The ids go with their pieces, and a sequence is padded to the window, but for
one whose length is a power of two, which is left as it is.

A null text is empty and has its end id only; repeated rows and repeated ids are documents of their
own; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ranges, steps
from .tokens import ENCODE_BYTES, encoder, vocabulary_size


class OpenWindows:
    """The open windows by remaining capacity, with a segment tree to find the tightest that fits."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.some = [False] * (2 * self.leaves)
        self.held: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, window: int) -> None:
        self.held[capacity].append(window)
        at = capacity + self.leaves
        while at and not self.some[at]:
            self.some[at] = True
            at >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """The tightest capacity of at least `length` and a window that has it, now closed."""
        some, at = self.some, length + self.leaves
        if not some[at]:
            while at > 1 and (at & 1 or not some[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if some[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        window = self.held[capacity].pop()
        if not self.held[capacity]:
            some[at] = False
            at >>= 1
            while at and not (some[2 * at] or some[2 * at + 1]):
                some[at] = False
                at >>= 1
        return capacity, window


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece, for lengths in descending order."""
    windows, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened, count = OpenWindows(window), 0
    for i, n in enumerate(lengths.tolist()):
        found = opened.take(n)
        if found is None:
            capacity, at = window, count
            count += 1
        else:
            capacity, at = found
        windows[i], offsets[i] = at, window - capacity
        if capacity > n:
            opened.put(capacity - n, at)
    return windows, offsets


def pieces(docs: DataFrame, path: str, end_id: int, window: int = 1024) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): full windows and the rest of each document.

    ids: little-endian unsigned numbers of 16 bits, or of 32 for a larger vocabulary.
    """
    dtype = _id_type(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, end_id)
        for b in steps(batches, most=ENCODE_BYTES):
            ids, upto = encode(b.column("text"))
            total = np.diff(upto)
            n = -(-total // window)
            row = np.repeat(np.arange(len(n)), n)
            start = ranges(np.zeros(len(n), np.int64), n) * window
            length = np.minimum(total[row] - start, window)
            cut = np.append(upto[row] + start, upto[-1]) * dtype.itemsize
            held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(cut), pa.py_buffer(ids.astype(dtype))])
            columns = [b.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(total[row]), held.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, ids binary"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _id_type(path: str) -> np.dtype:
    return np.dtype("<u2" if vocabulary_size(path) <= 1 << 16 else "<u4")


#: Sequences that are filled, passed on and read at once.
AT_ONCE = 256
#: What a sequence holds of each of its pieces.
_PARTS = {"doc_ids": "doc_id", "starts": "start", "lengths": "length", "doc_tokens": "doc_tokens"}


def group_sequences(group: int, batches: Iterator[pa.RecordBatch], id_bytes: int, window: int, pad_id: int) -> Iterator[pa.RecordBatch]:
    """The sequences of one group's pieces, as of `pack`; `AT_ONCE` of them have their padded ids at once."""
    rows = pa.Table.from_batches(list(batches)).combine_chunks()
    length = rows["length"].to_numpy()
    order = np.argsort(-length, kind="stable")
    at, offset = best_fit_decreasing(length[order], window)
    order = order[np.lexsort((offset, at))]
    length = length[order]
    at = np.sort(at)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    upto = np.concatenate(([0], np.cumsum(length)))
    ends = np.append(first, len(at))
    filled = np.diff(upto[ends])
    whole = np.where(filled & (filled - 1), window, filled)
    place = np.concatenate(([0], np.cumsum(whole)))
    offset = upto[:-1] - upto[first][at]
    every = {c: rows[c].combine_chunks() for c in ("ids", *_PARTS.values())}
    for a in range(0, len(first), AT_ONCE):
        b = min(a + AT_ONCE, len(first))
        mine = slice(ends[a], ends[b])
        some = pa.array(order[mine])
        flat = np.full(place[b] - place[a], pad_id, np.int32)
        held = every["ids"].take(some)
        bounds = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1]
        ids = np.frombuffer(held.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(f"<u{id_bytes}")
        flat[ranges(place[at[mine]] - place[a] + offset[mine], length[mine])] = ids
        lists = pa.array(ends[a : b + 1] - ends[a], pa.int32())
        parts = [pa.ListArray.from_arrays(lists, every[c].take(some)) for c in _PARTS.values()]
        offsets = pa.ListArray.from_arrays(lists, pa.array(offset[mine]))
        number = (group << 40) + np.arange(a, b)
        columns = [pa.array(number), pa.array(filled[a:b]), pa.ListArray.from_arrays(pa.array(place[a : b + 1] - place[a], pa.int32()), pa.array(flat)), *parts, offsets]
        yield pa.RecordBatch.from_arrays(columns, ["sequence_id", "length", "ids", *_PARTS, "offsets"])


def pack(cut: DataFrame, id_bytes: int, window: int = 1024, group_size: int = 8192, pad_id: int = 0) -> DataFrame:
    """(sequence_id, length, ids, doc_ids, starts, lengths, doc_tokens, offsets): the pieces `cut`
    (as of `pieces`, ids of `id_bytes` bytes) in sequences.

    ids ends in padding beyond `length`; the last five are lists with an item a piece, in their
    order in the sequence.
    """
    cut = materialise(cut, "pieces")
    groups = max(1, -(-cut.count() // group_size))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from group_sequences(key[0].as_py(), batches, id_bytes, window, pad_id)

    dealt = cut.withColumn("grp", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
    kind = cut.schema["doc_id"].dataType.simpleString()
    lists = "".join(f", {c} array<{kind if c == 'doc_ids' else 'bigint'}>" for c in [*_PARTS, "offsets"])
    return dealt.groupBy("grp").applyInArrow(run, f"sequence_id bigint, length bigint, ids array<int>{lists}")


def packed(docs: DataFrame, path: str, end_id: int, window: int = 1024) -> DataFrame:
    """The packed sequences of every document of `docs` (doc_id, text); see `pack`."""
    return pack(pieces(docs, path, end_id, window), _id_type(path).itemsize, window, pad_id=end_id)


def placed(sequences: DataFrame) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): a row a piece, with the
    CRC-32 of the ids that its sequence holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, AT_ONCE) for x in batches for i in range(0, x.num_rows, AT_ONCE)):
            lists = {c: b.column(c) for c in [*_PARTS, "offsets"]}
            n = pc.list_value_length(lists["starts"]).to_numpy(zero_copy_only=False)
            flat = b.column("ids").flatten().to_numpy().astype("<u4")
            base = np.concatenate(([0], np.cumsum(pc.list_value_length(b.column("ids")).to_numpy(zero_copy_only=False))))[:-1]
            offset, length = lists["offsets"].flatten(), lists["lengths"].flatten()
            begin = (np.repeat(base, n) + offset.to_numpy()).tolist()
            crc = [zlib.crc32(flat[x : x + k]) for x, k in zip(begin, length.to_pylist())]
            columns = [lists["doc_ids"].flatten(), lists["starts"].flatten(), length, pa.array(crc, pa.int64()), lists["doc_tokens"].flatten()]
            columns += [b.column("sequence_id").take(pa.array(np.repeat(np.arange(len(n)), n))), offset]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = sequences.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return sequences.select("sequence_id", "ids", *_PARTS, "offsets").mapInArrow(run, schema)
