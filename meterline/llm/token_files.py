"""Token ids in Arrow's random-access file format: equal-length sequences and their masks.

`write` puts the documents in ascending doc_id order (ties by the text's hash), encodes them, and
writes one pair of files a partition:

* `*.tokens.arrow`: record batches of `batch_rows` rows, `ids` fixed_size_list<uint16 or uint32>
  [length] and `mask` fixed_size_list<bool>[length]; the stream of ids runs on from row to row and
  only the file's last row is padded (mask false).
* `*.docs.arrow`: doc_id, start (in the file's stream) and n_tokens.

The files are not compressed, so `TokenFile` reads any row or document from a memory map without a
copy.  The manifest lists the files of the successful tasks only, with the ids before each file; a
retried task writes new names.

A null text is empty and has its end id only; null ids come first; repeated rows and repeated ids
are documents of their own; an empty table gives an empty manifest; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, materialise, open_mapped, steps
from .tokens import ENCODE_BYTES, encoder, vocabulary_size


class _Writer:
    """One partition's pair of files."""

    def __init__(self, folder: str, stem: str, dtype: np.dtype, length: int, batch_rows: int, id_type: pa.DataType):
        self.system, path = filesystem(folder)
        self.system.create_dir(path, recursive=True)
        self.uri, self.length, self.rows, self.dtype = f"{folder}/{stem}", length, batch_rows, dtype
        item = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.system.open_output_stream(f"{path}/{stem}.tokens.arrow")
        self.tokens = pa.ipc.new_file(self.sink, self.schema)
        self.doc_sink = self.system.open_output_stream(f"{path}/{stem}.docs.arrow")
        self.doc_schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.docs = pa.ipc.new_file(self.doc_sink, self.doc_schema)
        self.waiting: list[np.ndarray] = []
        self.held = self.n_docs = self.n_tokens = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, upto: np.ndarray) -> None:
        sizes = np.diff(upto)
        starts = self.n_tokens + upto[:-1]
        self.docs.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(sizes)], schema=self.doc_schema))
        self.waiting.append(ids.astype(self.dtype))
        self.held += len(ids)
        self.n_docs, self.n_tokens = self.n_docs + len(sizes), self.n_tokens + len(ids)
        if self.held >= self.rows * self.length:
            self._flush(self.held // (self.rows * self.length) * self.rows)

    def _flush(self, rows: int) -> None:
        stream = np.concatenate(self.waiting) if self.waiting else np.empty(0, self.dtype)
        used, real = stream[: rows * self.length], min(len(stream), rows * self.length)
        self.waiting = [stream[real:]]
        self.held = len(stream) - real
        used = np.concatenate((used, np.zeros(rows * self.length - real, self.dtype)))
        for at in range(0, rows, self.rows):
            part = used[at * self.length : (at + self.rows) * self.length]
            mask = np.arange(at * self.length, at * self.length + len(part)) < real
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (part, mask)]
            self.tokens.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._flush(-(-self.held // self.length))
        for x in (self.tokens, self.sink, self.docs, self.doc_sink):
            x.close()


class TokenFile:
    """Random access to one pair of files."""

    def __init__(self, uri: str):
        self.file = pa.ipc.open_file(open_mapped(f"{uri}.tokens.arrow"))
        self.docs = pa.ipc.open_file(open_mapped(f"{uri}.docs.arrow")).read_all()
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0
        self.at, self.ids = -1, np.empty(0)

    def _batch(self, i: int) -> np.ndarray:
        """The ids of record batch i, a view of the map."""
        if i != self.at:
            self.at, self.ids = i, self.file.get_batch(i).column("ids").flatten().to_numpy(zero_copy_only=True)
        return self.ids

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view of the map) and mask of sequence i."""
        at = i % self.rows
        one = slice(at * self.length, (at + 1) * self.length)
        return self._batch(i // self.rows)[one], self.file.get_batch(i // self.rows).column("mask").flatten()[one]

    def tokens(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n of the file's stream; a view unless they cross a batch."""
        size, parts = self.rows * self.length, []
        while n > 0:
            ids = self._batch(start // size)
            parts.append(ids[start % size : start % size + n])
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def write(docs: DataFrame, folder: str, path: str, end_id: int, length: int = 1024, batch_rows: int = 256) -> DataFrame:
    """Write the files below `folder`; the manifest (part, uri, n_docs, n_tokens, first)."""
    spark = docs.sparkSession
    dtype = np.dtype("<u2" if vocabulary_size(path) <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer = encoder(path, end_id), None
        part = TaskContext.get().partitionId()
        for b in steps(batches, most=ENCODE_BYTES):
            doc_ids = b.column("doc_id")
            writer = writer or _Writer(folder, f"part-{part:06d}-{uuid.uuid4().hex}", dtype, length, batch_rows, doc_ids.type)
            writer.add(doc_ids, *encode(b.column("text")))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "uri": [writer.uri], "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens]})

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    written = materialise(ordered.mapInArrow(run, "part bigint, uri string, n_docs bigint, n_tokens bigint"), "manifest")
    files = written.orderBy("part").collect()  # a row a file
    first = accumulate((f.n_tokens for f in files), initial=0)
    return spark.createDataFrame([(*f, at) for f, at in zip(files, first)], "part bigint, uri string, n_docs bigint, n_tokens bigint, first bigint")


def read_documents(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, first in zip(b.column("uri").to_pylist(), b.column("first").to_pylist()):
                f = TokenFile(uri)
                for docs in f.docs.to_batches(max_chunksize=8192):
                    spans = zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist())
                    crc = pa.array([zlib.crc32(f.tokens(s, n).astype("<u4").tobytes()) for s, n in spans], pa.int64())
                    starts = pa.array(docs.column("start").to_numpy() + first)
                    yield pa.RecordBatch.from_arrays([docs.column("doc_id"), starts, docs.column("n_tokens"), crc], ["doc_id", "start", "n_tokens", "ids_crc32"])

    dealt = manifest.select("uri", "first").repartition(max(1, manifest.count()))
    return dealt.mapInArrow(run, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(spark: SparkSession, docs: DataFrame, folder: str, path: str, end_id: int, length: int = 1024) -> DataFrame:
    """Write and read back: one row a document."""
    return read_documents(write(docs, folder, path, end_id, length), docs.schema["doc_id"].dataType.simpleString())
