"""Tables kept in buckets of a key, of which a commit writes only those that it touches (SK2, SK4, I5, ST3).

A table is partitioned by source and by a hash of its key.  A commit first writes the new content of
the touched partitions of all its tables below `pending`, then a mark with their names, and then puts
them in place by Spark's dynamic partition overwrite.  Up to the mark a run that dies has changed
nothing; after it the next one puts the same content in place again.  There is one writer at a time;
a reader that starts while a partition is put in place may miss it, and reads again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: (source_id, bucket) of a partition.
Part = tuple[str, int]
_BUCKET = StructField("bucket", IntegerType())


class Bucketed:
    """One table below `root`: its schema, the key that must not be null, and the columns whose hash
    gives the bucket."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, key: str, by: tuple[str, ...], buckets: int = 256):
        self.spark, self.root, self.schema, self.key, self.by, self.buckets = spark, root.rstrip("/"), schema, key, by, buckets
        self.stored = StructType([*(f if f.name == "source_id" else StructField(f.name, f.dataType) for f in schema), _BUCKET])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", self.bucket())

    def _all(self) -> DataFrame:
        if not exists(self.spark, self.root):
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(self.root)

    def read(self) -> DataFrame:
        """All rows."""
        return self._all().where(F.col(self.key).isNotNull()).select(self.schema.names)

    def parts_of(self, keys: DataFrame) -> list[Part]:
        """The partitions that rows with the columns of `by` and source_id fall into; there are at most
        as many as sources times buckets."""
        return sorted((r.source_id, r.bucket) for r in keys.select("source_id", self.bucket().alias("bucket")).distinct().collect())

    def parts(self, parts: list[Part]) -> DataFrame:
        """The rows of some partitions; the others' files are not opened."""
        held = F.lit(False)
        sources: dict[str, list[int]] = {}
        for source, bucket in parts:
            sources.setdefault(source, []).append(bucket)
        for source, buckets in sources.items():
            held = held | ((F.col("source_id") == source) & F.col("bucket").isin(buckets))
        return self._all().where(held & F.col(self.key).isNotNull()).select(self.schema.names)


def exists(spark: SparkSession, uri: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def delete(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _children(spark: SparkSession, uri: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f"{uri}/{s.getPath().getName()}" for s in system.listStatus(path)] if system.exists(path) else []


class BucketStore:
    """Tables that change together, below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables: dict[str, Bucketed] = {}

    def table(self, name: str, schema: StructType, key: str, by: tuple[str, ...], buckets: int = 256) -> Bucketed:
        self.tables[name] = Bucketed(self.spark, f"{self.root}/{name}", schema, key, by, buckets)
        return self.tables[name]

    def commit(self, new: dict[str, tuple[DataFrame, list[Part]]], note: dict | None = None) -> None:
        """Put rows in place of the partitions named beside them, in all tables of `new` or in none.
        Partitions that get no rows become empty.  `note` is kept as the last one of its kind."""
        folder = f"{self.root}/pending/{uuid.uuid4().hex}"
        for name, (rows, parts) in new.items():
            table = self.tables[name]
            marks = self.spark.createDataFrame(parts, StructType([StructField("source_id", StringType()), _BUCKET]))
            full = table.placed(rows.select(table.schema.names)).unionByName(marks, allowMissingColumns=True)
            # one file a partition where it is small, several where it is large
            full.select(table.stored.names).hint("rebalance", "source_id", "bucket").write.partitionBy("source_id", "bucket").parquet(f"{folder}/{name}")
        mark = json.dumps({"tables": list(new), "note": note or {}})
        self.spark.createDataFrame([(mark,)], "mark string").coalesce(1).write.text(f"{folder}/mark")
        self._apply(folder)

    def recover(self) -> None:
        """Finish what an earlier run had marked, and drop what it had not."""
        for folder in _children(self.spark, f"{self.root}/pending"):
            if exists(self.spark, f"{folder}/mark/_SUCCESS"):
                self._apply(folder)
            else:
                delete(self.spark, folder)

    def _apply(self, folder: str) -> None:
        mark = json.loads(self.spark.read.text(f"{folder}/mark").first()[0])
        for name in mark["tables"]:
            table = self.tables[name]
            rows = self.spark.read.schema(table.stored).parquet(f"{folder}/{name}")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id", "bucket").parquet(table.root)
        for kind, value in mark["note"].items():
            self.spark.createDataFrame([(value,)], "value bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/notes/{kind}")
        delete(self.spark, folder)

    def note(self, kind: str) -> int | None:
        """The last noted number of a kind."""
        folder = f"{self.root}/notes/{kind}"
        return self.spark.read.schema("value bigint").parquet(folder).first().value if exists(self.spark, f"{folder}/_SUCCESS") else None

    def upsert(self, name: str, incoming: DataFrame, stream: str | None = None, batch: int | None = None) -> bool:
        """Keep the latest row of each key; writes the touched partitions only.  A batch of a stream that
        is not newer than its last one changes nothing (False)."""
        from ..operators.changes import upsert_latest

        self.recover()
        if batch is not None and (last := self.note(stream)) is not None and batch <= last:
            return False
        table = self.tables[name]
        incoming = incoming.select(table.schema.names)
        parts = table.parts_of(incoming)
        if parts or batch is not None:
            merged = upsert_latest(table.parts(parts), incoming)
            self.commit({name: (merged, parts)} if parts else {}, {stream: batch} if batch is not None else None)
        return True
