"""Lines of text files with their place and byte offset (SC1, SC12, SC13, F4, I1, I10, I11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def file_listing(spark: SparkSession, roots: list[str], pattern: str = "*.jsonl") -> DataFrame:
    """(path, size, modified) of the files below `roots`; no content is read, so a task takes many files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(roots)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).coalesce(spark.sparkContext.defaultParallelism)


def limit_files(listing: DataFrame, n: int) -> DataFrame:
    """The first n files by path."""
    return listing.orderBy("path").limit(n)


def read_lines(spark: SparkSession, roots: list[str], pattern: str = "*.jsonl") -> DataFrame:
    """(path, block, seq, value, modified) of every line below `roots` (live and archived folders alike).

    (block, seq) is the order of the lines inside a file, also where Spark splits it.
    """
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "\n").text(roots)
    meta = F.col("_metadata")
    return text.select(meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("seq"), "value", meta["file_modification_time"].alias("modified"))


def with_offsets(lines: DataFrame) -> DataFrame:
    """Adds byte_offset: the bytes of all lines before, with their ends.

    Lines are added up inside their block, a task a block, and the few blocks of a file before each
    other; `byte_ranges.read_ranges` has true offsets without any sum.
    """
    size = F.octet_length("value") + 1
    earlier = [Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1) for by, at in ((["path", "block"], "seq"), (["path"], "block"))]
    blocks = lines.groupBy("path", "block").agg(F.sum(size).alias("_size"))
    starts = blocks.select("path", "block", F.coalesce(F.sum("_size").over(earlier[1]), F.lit(0)).alias("_start"))
    inside = lines.withColumn("_inside", F.coalesce(F.sum(size).over(earlier[0]), F.lit(0)))
    return inside.join(starts, ["path", "block"]).select(*lines.columns, (F.col("_start") + F.col("_inside")).cast("long").alias("byte_offset"))


def candidates(lines: DataFrame, *markers: str) -> DataFrame:
    """Lines that hold a marker, before anything is parsed."""
    held = F.lit(False)
    for m in markers:
        held = held | F.contains("value", F.lit(m))
    return lines.where(held)


def parsed_offset(lines: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, parsed_offset): the end of the last whole line.  A last line without an end is used
    now and read again next time; the upsert by id makes that harmless."""
    ends = with_offsets(lines).groupBy("path").agg(F.max_by(F.struct("byte_offset", F.octet_length("value").alias("n")), "byte_offset").alias("l"))
    end = F.col("l.byte_offset") + F.col("l.n")
    return ends.join(listing.select("path", "size"), "path").select("path", F.when(end < F.col("size"), end + 1).otherwise(F.col("l.byte_offset")).alias("parsed_offset"))


def invalid_files(lines: DataFrame) -> DataFrame:
    """Files with a line that is no UTF-8: they are warned about and keep their old rows."""
    return lines.where(~F.is_valid_utf8("value")).select("path").distinct()
