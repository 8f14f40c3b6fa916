"""Lines of parts of files, with their true byte offsets (SC1, W4, I4, I10, I11, ST1).

A part is (path, start, stop) in bytes, where `start` begins a line: the cursor of the last read, or 0.
Parts are cut into splits, and a line belongs to the split that holds its end.  Whoever reads a split
looks back from its first byte for the beginning of the line that ends there; so any cut will do,
a file's splits may go to different tasks, and no line is counted in order to place another.  A task
takes as many splits as make `SPLIT_BYTES` of work, so small files and small splits share one.

Batches take parts as a DataFrame, so the driver sees two sums and no list of files.  `GrowingLines` is
the streaming source of files that grow: its offset is the size up to which each file has been read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SPLIT_BYTES = 64 << 20
#: Bytes of one read, and of one step back in search of a line's beginning.
CHUNK, STEP_BACK = 4 << 20, 64 << 10
#: Bytes of lines that make a batch.
BATCH = 1 << 20
#: What a split costs besides its bytes, in bytes, and how many splits of a file stay together at most.
SPLIT_COST, TOGETHER = 64 << 10, 1024

LINES = "path string, byte_offset bigint, value string, ended boolean, valid boolean"
_FIELDS = pa.schema([("path", pa.string()), ("byte_offset", pa.int64()), ("value", pa.string()), ("ended", pa.bool_()), ("valid", pa.bool_())])


def opened(uri: str) -> pa.NativeFile:
    """A file for reading at any place; `file:` and bare paths are local ones."""
    if "://" not in uri or uri.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(_bare(uri))
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _bare(uri: str) -> str:
    path = uri.removeprefix("file:")
    return "/" + path.lstrip("/") if path != uri else uri


class _Reader:
    """One open file, and the number of bytes taken from it."""

    def __init__(self, uri: str):
        self.file, self.taken = opened(uri), 0

    def at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        data = self.file.read(n)
        self.taken += len(data)
        return data

    def line_start(self, place: int) -> int:
        """Where the line that goes on at `place` begins."""
        step = 256
        while place > 0:
            n = min(step, STEP_BACK, place)
            found = self.at(place - n, n).rfind(b"\n")
            if found >= 0:
                return place - n + found + 1
            place -= n
            step *= 4
        return 0

    def lines(self, start: int, stop: int, begins: bool, tail: bool) -> Iterator[tuple[int, bytes, bool]]:
        """(offset, lines, whether they end) for the lines that end in [start, stop), several at a time;
        with `tail` also for a last one that does not end."""
        first = start if begins else self.line_start(start)
        place, held, at = first, [], first
        while at < stop:
            data = self.at(at, min(CHUNK, stop - at))
            if not data:
                break  # the file has become shorter since it was listed
            at += len(data)
            cut = data.rfind(b"\n") + 1
            if cut:
                block = b"".join([*held, data[:cut]])
                yield place, block, True
                place, held = place + len(block), [data[cut:]]
            else:
                held.append(data)
        rest = b"".join(held)
        if tail and rest:
            yield place, rest, False

    def split_lines(self, start: int, stop: int, begins: bool, tail: bool, split_bytes: int) -> Iterator[tuple[int, bytes, bool]]:
        """The same for [start, stop) cut into splits, each read by itself; lines of neighbours that
        follow each other come together."""
        held, place, size = [], 0, 0
        for at in range(start, stop, split_bytes):
            upto = min(at + split_bytes, stop)
            for began, block, ended in self.lines(at, upto, begins and at == start, tail and upto == stop):
                if held and (not ended or began != place + size or size + len(block) > CHUNK):
                    yield place, b"".join(held), True
                    held, size = [], 0
                if not ended:
                    yield began, block, False
                    continue
                place = place if held else began
                held.append(block)
                size += len(block)
        if held:
            yield place, b"".join(held), True


def _together(split_bytes: int) -> int:
    """Bytes of a file's neighbouring splits that one task reads."""
    return split_bytes * max(1, min(TOGETHER, SPLIT_BYTES // split_bytes))


class _Blocks:
    """Blocks of lines that wait for a batch; small files share one, as it costs far more than few lines."""

    def __init__(self):
        self.held: list[tuple[int, str, int, bytes, bool]] = []
        self.size = 0

    def add(self, at: int, path: str, place: int, block: bytes, ended: bool) -> bool:
        """Hold a block of a file, `at` being the row it came from; whether it is time for a batch."""
        self.held.append((at, path, place, block, ended))
        self.size += len(block)
        return self.size >= BATCH

    def columns(self, keep: list[pa.Array] = ()) -> list[pa.Array]:
        """What is held as columns, with `keep` taken at the blocks' rows; lines that are no UTF-8 have
        their bad bytes replaced."""
        rows, paths, places, blocks, ended = zip(*self.held)
        self.held, self.size = [], 0
        blocks = [block if end else block + b"\n" for block, end in zip(blocks, ended)]
        values = pc.split_pattern(pa.array([b"".join(blocks)[:-1]], pa.large_binary()), pattern=b"\n").flatten()
        of = np.repeat(np.arange(len(blocks)), [block.count(b"\n") for block in blocks])
        stops = np.cumsum(pc.binary_length(values).to_numpy() + 1)
        began = np.cumsum([0, *map(len, blocks[:-1])])
        offsets = np.concatenate(([0], stops[:-1])) + (np.array(places, np.int64) - began)[of]
        try:
            text, valid = values.cast(pa.string()), pa.repeat(pa.scalar(True), len(values))
        except pa.ArrowInvalid:
            plain = [v.decode("utf-8", "replace") for v in values.to_pylist()]
            text, valid = pa.array(plain, pa.string()), pa.array([p.encode() == v for p, v in zip(plain, values.to_pylist())])
        taken = pa.array(np.array(rows)[of])
        return [pa.array(paths, pa.string()).take(pa.array(of)), pa.array(offsets, pa.int64()), text, pa.array(np.array(ended)[of]), valid, *(k.take(taken) for k in keep)]


def read_ranges(ranges: DataFrame, keep: tuple[str, ...] = (), split_bytes: int = SPLIT_BYTES, meter: Accumulator | None = None, aligned: bool = True) -> DataFrame:
    """(path, byte_offset, value, ended, valid) of the lines in `ranges` (path, start, stop), and the
    columns of `keep`, the same on all lines of a part.

    `ended` is false for a last line without an end, `valid` for one that is no UTF-8.  Only these bytes
    are read, and where a split begins up to one line more; `meter` adds them up.  An empty part has
    no lines.  Without `aligned` a part may begin anywhere, and has the line that ends in it.
    """
    spark = ranges.sparkSession
    full = ranges.where("stop > start")
    piece = _together(int(split_bytes))
    cuts = full.withColumn("at", F.explode(F.expr(f"sequence(start, stop - 1, {piece}L)")))
    splits = cuts.select("path", "at", F.least(F.col("at") + piece, F.col("stop")).alias("upto"), (F.col("at") == (F.col("start") if aligned else F.lit(0))).alias("begins"), (F.col("at") + piece >= F.col("stop")).alias("tail"), *keep)
    size = F.col("upto") - F.col("at")
    n, cost = splits.agg(F.count(F.lit(1)), F.coalesce(F.sum(size + F.ceil(size / int(split_bytes)) * SPLIT_COST), F.lit(0))).first()
    tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism, -(-cost // SPLIT_BYTES))))
    types = splits.select(*keep).schema
    schema = LINES + "".join(f", {f.name} {f.dataType.simpleString()}" for f in types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, held = [b.column(k) for k in keep], _Blocks()
            for i, (path, at, upto, begins, tail) in enumerate(zip(*(b.column(c).to_pylist() for c in ("path", "at", "upto", "begins", "tail")))):
                reader = _Reader(path)
                for place, block, ended in reader.split_lines(at, upto, begins, tail, int(split_bytes)):
                    if held.add(i, path, place, block, ended):
                        yield pa.RecordBatch.from_arrays(held.columns(kept), [*_FIELDS.names, *keep])
                if meter is not None:
                    meter.add(reader.taken)
            if held.held:
                yield pa.RecordBatch.from_arrays(held.columns(kept), [*_FIELDS.names, *keep])

    return splits.repartition(tasks).mapInArrow(run, schema)


def whole_files(listing: DataFrame) -> DataFrame:
    """`listing` (path, size) as parts that hold the whole files."""
    return listing.withColumns({"start": F.lit(0).cast("long"), "stop": F.col("size")})


def parsed_ends(lines: DataFrame) -> DataFrame:
    """(path, parsed_offset, valid) of files with a whole line, or with one that is no UTF-8: the end of
    the last whole line, from which the next read goes on, null where there is none."""
    end = F.when(F.col("ended"), F.col("byte_offset") + F.octet_length("value") + 1)
    return lines.groupBy("path").agg(F.max(end).alias("parsed_offset"), F.min("valid").alias("valid"))


def guards(files: DataFrame, width: int = 65536, meter: Accumulator | None = None) -> DataFrame:
    """Adds head and tail to files (path, upto): hashes of the first `width` bytes and the last `width`,
    both of those before `upto`; null where the file is shorter than that.  Equal guards tell an append
    from a rewrite."""
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*files.schema.fields, StructField("head", LongType()), StructField("tail", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        def digest(reader: _Reader, start: int, stop: int) -> int | None:
            data = reader.at(start, stop - start)
            return xxh64_intdigest(data) - 2**63 if len(data) == stop - start else None

        for b in batches:
            out = []
            for path, upto in zip(b.column("path").to_pylist(), b.column("upto").to_pylist()):
                reader = _Reader(path)
                out.append((digest(reader, 0, min(width, upto)), digest(reader, max(0, upto - width), upto)))
                if meter is not None:
                    meter.add(reader.taken)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([g[k] for g in out], pa.int64()) for k in (0, 1))], schema.names)

    return files.repartition(_tasks(files)).mapInArrow(run, schema)


def _tasks(files: DataFrame) -> int:
    return max(1, min(files.count(), files.sparkSession.sparkContext.defaultParallelism * 4))


# ---------------------------------------------------------------------- streaming


@dataclass
class _Part(InputPartition):
    """What one task reads: (path, start, stop, begins), a file's neighbouring splits each."""

    pieces: list[tuple[str, int, int, bool]]


class _GrowingReader(DataSourceStreamReader):
    def __init__(self, options):
        self.roots = json.loads(options["roots"])
        self.pattern = options.get("pattern", "*.jsonl")
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.tasks = int(options.get("tasks", 16))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Every file's size; names that begin with . or _ are left out, as Spark does."""
        sizes = {}
        for root in self.roots:
            local = "://" not in root or root.startswith("file:")
            system, base = (fs.LocalFileSystem(), _bare(root)) if local else fs.FileSystem.from_uri(root)
            for f in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
                name = f.path[len(base) :]
                hidden = any(part[:1] in ("_", ".") for part in name.split("/"))
                if f.is_file and not hidden and fnmatch(f.base_name, self.pattern):
                    sizes[f"file:{f.path}" if local else f"{system.type_name}://{f.path}"] = f.size
        return sizes

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        piece = _together(self.split)
        pieces = [(path, at, min(at + piece, stop), at == 0) for path, stop in end.items() for at in range(start.get(path, 0), stop, piece)]
        costs = [upto - at - (at - upto) // self.split * SPLIT_COST for _, at, upto, _ in pieces]
        room = min(SPLIT_BYTES, -(-sum(costs) // self.tasks))
        parts, left = [], 0
        for p, cost in zip(pieces, costs):
            if left <= 0:
                parts.append(_Part([]))
                left = room
            parts[-1].pieces.append(p)
            left -= cost
        return parts

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        held = _Blocks()
        for i, (path, start, stop, begins) in enumerate(partition.pieces):
            for place, block, ended in _Reader(path).split_lines(start, stop, begins, False, self.split):
                if held.add(i, path, place, block, ended):
                    yield pa.RecordBatch.from_arrays(held.columns(), schema=_FIELDS)
        if held.held:
            yield pa.RecordBatch.from_arrays(held.columns(), schema=_FIELDS)


class GrowingLines(DataSource):
    """Lines of files that grow, each once, when its end has been written.

    The offset holds each file's size at a trigger, so it grows with the number of files, not of lines.
    What stands below a file's size must not change: a file that was cut shorter goes on from its new
    size (the manifest's refresh finds rewritten files).  A trigger has about `tasks` tasks, more where
    these would read over `SPLIT_BYTES` each.  Options: `roots` (a JSON list), `pattern`, `split_bytes`,
    `tasks`.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _GrowingReader(self.options)


def stream_growing(spark: SparkSession, roots: list[str], pattern: str = "*.jsonl", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, byte_offset, value, ended, valid) of the lines that files below `roots` grow by."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("roots", json.dumps(roots)).option("pattern", pattern).option("split_bytes", split_bytes).option("tasks", spark.sparkContext.defaultParallelism).load()
