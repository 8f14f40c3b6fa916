"""Shared helpers: shared-folder intermediates, word splitting, memory-mapped arrays."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one vectorised step handles at a time.
STEP_BYTES = 4 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_scratch: dict[str, str] = {}


def scratch_base(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`; a temporary one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_scratch:
        _own_scratch[app] = "file://" + tempfile.mkdtemp(prefix="spark-meterline-")
    return _own_scratch[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{scratch_base(spark)}/meterline/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _shuffles_freed(spark: SparkSession):
    """Shuffle files of what is written inside go as soon as the write has ended."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back.

    This cuts the lineage, so a lost executor costs a re-read and not a recomputation, and it lets
    Spark drop the shuffle files behind it.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with _shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialised frames that no later step reads."""
    for df in frames:
        jvm = df.sparkSession._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/meterline/" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow file system and path of a URI; a bare path is local."""
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[5:])
    return fs.LocalFileSystem(), uri


def open_mapped(uri: str) -> pa.Buffer:
    """The bytes of a file: memory-mapped on a mounted folder, else fetched once."""
    if urlparse(uri).scheme in ("", "file"):
        return pa.memory_map(filesystem(uri)[1]).read_buffer()
    system, path = filesystem(uri)
    with system.open_input_file(path) as f:
        return f.read_buffer()


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in slices of about `most` bytes of `column` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < len(ends):
            base = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of every text, flat, and where each text's words begin and end.

    A null text has no words.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    upto = np.concatenate(([0], np.cumsum(full)))
    return flat.filter(pa.array(full)), upto[offsets - offsets[0]]


def encode_words(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, each word's index among them, and the texts' word offsets."""
    flat, offsets = split_words(text)
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets


def hash_words(distinct: pa.Array) -> np.ndarray:
    """XXH64 of each word's UTF-8 bytes."""
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, distinct.cast(pa.large_binary()).to_pylist()), np.uint64, len(distinct))


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """size[0] numbers from start[0] on, then size[1] from start[1] on, and so forth."""
    return np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64), size) + np.arange(size.sum()) if len(size) else np.empty(0, np.int64)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
