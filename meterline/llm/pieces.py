"""Encoding and decoding with SentencePiece vocabularies of the merge type (BPE).

A text's white space becomes ▁, one more ▁ goes before it, and then an agenda of adjacent symbol pairs
is worked off: of all pairs that join to a piece, the one of the highest score is joined first, the
leftmost of equals, until none is left.  Characters that are no piece become byte pieces.

Two characters that stand side by side in no piece are never joined, so a text is cut between them and
each distinct segment goes through the agenda once.  Segments of up to `_WIDE` characters are worked
off together, those of one length as the rows of a matrix (a join a row and round); longer ones have a
heap each.  Every segment that a worker has not met is checked, a batch in one call, against the
library; `agrees` says of each text whether all its segments did.

Null and empty texts have no ids and decode to "".  Repeated rows, nulls in other columns and further
columns do not matter; rows keep their doc_id.  A text is one row's work, whatever its length.
"""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from .common import steps

_WIDE = 64
#: Text bytes that are encoded at a time.
ENCODE_BYTES = 2 << 20
#: Ids that one vectorised step decodes at a time.
DECODE_IDS = 1 << 19
_NONE = np.iinfo(np.int32).max
_models: dict[str, Pieces] = {}

codecs.register_error("piece_bytes", lambda e: ("�" * (e.end - e.start), e.end))


def _library(path: str):
    """The library without the ▁ before a text, so that it takes segments as they are."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    proto = ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    spec, kinds = proto.normalizer_spec, {p.type for p in proto.pieces}
    plain = spec.name == "identity" and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
    # piece kinds: 1 normal, 2 unknown, 3 control, 6 byte
    if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or not plain or kinds - {1, 2, 3, 6}:
        raise ValueError(f"{path}: not a merge-type vocabulary with byte pieces and plain normalisation")
    spec.add_dummy_prefix = False
    return SentencePieceProcessor(model_proto=proto.SerializeToString()), proto


class Pieces:
    """A vocabulary, and the segments that are known under it: about twice `most_known` at most."""

    def __init__(self, path: str, most_known: int = 200_000):
        self.library, proto = _library(path)
        self.most = most_known
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        normal = {p.piece.replace("▁", " "): i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.byte = np.array([self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        # symbols: pieces, and after them the characters that only occur inside pieces
        letters = sorted({c for p in normal for c in p})
        symbols = normal | {c: len(proto.pieces) + k for k, c in enumerate(c for c in letters if c not in normal)}
        self.of_code = np.full(0x110000, -1, np.int64)
        self.of_code[[ord(c) for c in letters]] = [symbols[c] for c in letters]
        self.size, self.span = len(proto.pieces), len(proto.pieces) + len(symbols)
        joins = [(symbols[p[:i]] * self.span + symbols[p[i:]], i_) for p, i_ in normal.items() for i in range(1, len(p)) if p[:i] in symbols and p[i:] in symbols]
        self.pairs, self.joined = np.array(sorted(joins), np.int64).reshape(-1, 2).T.copy()
        scores = np.array([p.score for p in proto.pieces], np.float32)
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.together = np.zeros((128, 128), bool)
        inside = {a + b for p in normal for a, b in pairwise(p)}
        for a, b in (pair for pair in inside if pair.isascii()):
            self.together[ord(a), ord(b)] = True
        self.split_spaces = not any(b == " " and a != " " for a, b in inside)
        shown = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else proto.trainer_spec.unk_surface.encode() if p.type == 2 else p.piece.replace("▁", " ").encode() for p in proto.pieces]
        self.shown = pa.array(shown, pa.large_binary())
        self.spaced = np.array([s[:1] == b" " and p.type == 1 for s, p in zip(shown, proto.pieces)])
        self.silent = np.array([p.type == 3 for p in proto.pieces])

    # ------------------------------------------------------------------ segments

    def segments(self, text: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The segments of every text, flat, with the space before it, and the texts' bounds in them."""
        text = pc.replace_substring(pc.fill_null(text, "").cast(pa.large_string()), "▁", " ")
        text = pc.if_else(pc.equal(text, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string())))
        bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        if not len(data):
            return pa.array([], pa.large_string()), np.zeros(len(bounds), np.int64)
        a, b = data[:-1], data[1:]
        cut = np.zeros(len(data), bool)
        cut[1:] = (a < 128) & (b < 128) & ~self.together[a & 127, b & 127]
        if self.split_spaces:
            cut[1:] |= (b == 32) & (a != 32)
        cut[bounds[:-1][bounds[:-1] < len(data)]] = True
        at = np.flatnonzero(cut)
        flat = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data))
        return flat, np.searchsorted(at, bounds)

    # ------------------------------------------------------------------ agenda

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that two symbols join to and its rank, _NONE where there is none."""
        key = np.where((left < 0) | (right < 0), -1, left * self.span + right)
        place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        piece = self.joined[place]
        return piece, np.where(self.pairs[place] == key, self.rank[piece], _NONE)

    def _rows(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of symbols, worked off together: (row numbers, their symbols) as they are done."""
        row = np.arange(len(symbols))
        piece, rank = self._pair(symbols[:, :-1], symbols[:, 1:])
        while len(row):
            n = symbols.shape[1]
            if n == 1:
                yield row, symbols
                return
            best = rank.argmin(axis=1)
            open_ = rank[np.arange(len(row)), best] < _NONE
            if not open_.all():
                yield row[~open_], symbols[~open_]
                row, symbols, piece, rank, best = row[open_], symbols[open_], piece[open_], rank[open_], best[open_]
            if not len(row):
                return
            each = np.arange(len(row))
            symbols[each, best] = piece[each, best]
            later = np.arange(n - 1)
            symbols = np.take_along_axis(symbols, later + (later > best[:, None]), axis=1)
            if n == 2:
                continue
            later = later[:-1]
            keep = later + (later >= best[:, None])
            piece, rank = np.take_along_axis(piece, keep, axis=1), np.take_along_axis(rank, keep, axis=1)
            for side in (-1, 0):  # the pairs on both sides of the new symbol
                ok = np.flatnonzero((best + side >= 0) & (best + side < n - 2))
                k = best[ok] + side
                piece[ok, k], rank[ok, k] = self._pair(symbols[ok, k], symbols[ok, k + 1])

    def _heap(self, symbols: np.ndarray) -> np.ndarray:
        """One long row of symbols, by a heap of (rank, place) with links between the symbols left."""
        s, n = symbols.tolist(), len(symbols)
        after, before, version = [*range(1, n), -1], [-1, *range(n - 1)], [0] * n
        piece, rank = self._pair(symbols[:-1], symbols[1:])
        agenda = [(r, i, i + 1, p, 0, 0) for i, (r, p) in enumerate(zip(rank.tolist(), piece.tolist())) if r < _NONE]
        heapq.heapify(agenda)
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def offer(i: int, j: int) -> None:
            if i < 0 or j < 0:
                return
            pair = s[i], s[j]
            if pair not in known:
                p, r = self._pair(np.array([s[i]]), np.array([s[j]]))
                known[pair] = int(r[0]), int(p[0])
            r, p = known[pair]
            if r < _NONE:
                heapq.heappush(agenda, (r, i, j, p, version[i], version[j]))

        while agenda:
            _, i, j, p, vi, vj = heapq.heappop(agenda)
            if version[i] != vi or version[j] != vj:
                continue
            s[i], after[i] = p, after[j]
            version[i] += 1
            version[j] = -1
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        out, i = [], 0
        while i >= 0:
            out.append(s[i])
            i = after[i]
        return np.array(out, np.int64)

    def agenda(self, segments: list[str]) -> list[bytes]:
        """Ids of segments, as the bytes of unsigned 32-bit numbers."""
        code = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        start = np.cumsum(size) - size
        symbols = self.of_code[code]
        symbols = np.where(symbols < 0, -1 - code.astype(np.int64), symbols)
        out: list[bytes] = [b""] * len(segments)
        for n in np.unique(size).tolist():
            of = np.flatnonzero(size == n)
            if n > _WIDE:
                for i in of.tolist():
                    out[i] = self._ids(self._heap(symbols[start[i] : start[i] + n]))
                continue
            for row, done in self._rows(symbols[start[of][:, None] + np.arange(n)]):
                odd = ((done < 0) | (done >= self.size)).any(axis=1)
                for i, s in zip(of[row[odd]].tolist(), done[odd]):
                    out[i] = self._ids(s)
                width, packed = done.shape[1] * 4, done[~odd].astype("<u4").tobytes()
                for k, i in enumerate(of[row[~odd]].tolist()):
                    out[i] = packed[k * width : (k + 1) * width]
        return out

    def _ids(self, symbols: np.ndarray) -> bytes:
        """Ids of symbols; what is no piece becomes its bytes."""
        out: list[int] = []
        for s in symbols.tolist():
            if 0 <= s < self.size:
                out.append(s)
            else:
                c = chr(-1 - s) if s < 0 else chr(int(np.flatnonzero(self.of_code == s)[0]))
                out.extend(self.byte[list(c.encode())].tolist())
        return np.array(out, "<u4").tobytes()

    # ------------------------------------------------------------------ texts

    def _unlike(self, segments: list[str], ids: list[bytes]) -> set[str]:
        """The segments of which the library gives other ids."""
        check = self.library.encode(segments, num_threads=1)
        size = np.fromiter(map(len, check), np.int64, len(check))
        flat = np.fromiter(chain.from_iterable(check), "<u4", size.sum())
        if flat.tobytes() == b"".join(ids) and (size * 4 == np.fromiter(map(len, ids), np.int64, len(ids))).all():
            return set()
        return {s for s, own, other in zip(segments, ids, check) if own != np.array(other, "<u4").tobytes()}

    def _looked_up(self, distinct: list[str]) -> tuple[list[bytes], np.ndarray]:
        """Ids of distinct segments, known or new, and whether the library gives the same."""
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        known, right = self.known, np.ones(len(distinct), bool)
        out = list(map(known.get, distinct))
        missing = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(missing, map(self.older.get, map(distinct.__getitem__, missing))):
            if ids is not None:
                out[i] = known[distinct[i]] = ids
        missing = [i for i in missing if out[i] is None]
        if missing:
            new = [distinct[i] for i in missing]
            ours = self.agenda(new)
            wrong = self._unlike(new, ours)
            for i, s, ids in zip(missing, new, ours):
                out[i] = ids
                if s in wrong:  # not kept, and so found again where it occurs again
                    right[i] = False
                else:
                    known[s] = ids
        return out, right

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All texts' ids, each text's bounds in them, and whether the library agrees."""
        flat, offsets = self.segments(text)
        coded = flat.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        held, right = self._looked_up(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, held), np.int64, len(held)) // 4
        bounds = np.concatenate(([0], np.cumsum(size)))
        lists = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(held), "<u4")))
        upto = np.concatenate(([0], np.cumsum(size[index])))
        ids = lists.take(pa.array(index)).flatten().to_numpy()
        wrong = np.concatenate(([0], np.cumsum(~right[index])))
        return ids, upto[offsets], wrong[offsets[1:]] == wrong[offsets[:-1]]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The texts of lists of ids: bytes joined, the space before a text taken off again, and one
        replacement character for each byte that is no UTF-8.  Control pieces are as if not there."""
        joined = self.shown.take(pa.array(ids))
        place = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
        data = joined.buffers()[2] or pa.py_buffer(b"")
        ends = place[bounds]
        first = np.minimum(bounds[:-1], max(0, len(ids) - 1))
        if len(ids):
            silent = np.concatenate((np.flatnonzero(~self.silent[ids]), [len(ids)]))
            first = silent[np.searchsorted(silent, bounds[:-1])]  # control pieces give no text
        full = first < bounds[1:]
        strip = np.zeros(len(full), bool)
        if len(ids):
            strip = full & self.spaced[ids[np.minimum(first, len(ids) - 1)]]
        view = memoryview(data)
        return pa.array([bytes(view[a + s : b]).decode("utf-8", "piece_bytes") for a, b, s in zip(ends[:-1].tolist(), ends[1:].tolist(), strip.tolist())], pa.string())


def pieces(path: str) -> Pieces:
    """The worker's vocabulary, which keeps what it knows from task to task."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def _slices(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` in sum, one row at least."""
    ends, at = np.cumsum(size), 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, upto
        at = upto


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, agrees) of every row of docs (doc_id, text): the whole text's ids, without begin or
    end ids.  `path` names the vocabulary on every node."""
    docs = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for b in steps(batches, most=ENCODE_BYTES):
            ids, bounds, agrees = model.encode(b.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, pa.array(agrees)], ["doc_id", "ids", "agrees"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, agrees boolean")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds `decoded` to rows with a column `ids` of whole numbers; null ids decode to ""."""
    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for whole in batches:
            size = pc.fill_null(pc.list_value_length(whole.column("ids")), 0).to_numpy().astype(np.int64)
            for at, upto in _slices(size, DECODE_IDS):
                b, n = whole.slice(at, upto - at), size[at:upto]
                ids = b.column("ids").flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*b.columns, model.decode(ids, np.concatenate(([0], np.cumsum(n))))], schema.names)

    return encoded.mapInArrow(run, schema)
