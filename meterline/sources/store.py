"""The stored ledger, reports and snapshots (SC10, SK1, SK6, SK7, I5, I6)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.changes import replace_files, retained, upsert_latest
from ..operators.summary import anonymise


def write_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("source_id").parquet(path)


def read_ledger(spark: SparkSession, path: str, start=None, end=None, source_ids: list[str] | None = None) -> DataFrame:
    """Rows in time order; `source_ids` None is all sources, an empty list none."""
    df = spark.read.parquet(path)
    return filtered(df, start, end, source_ids).orderBy("ts")


def filtered(df: DataFrame, start=None, end=None, source_ids: list[str] | None = None) -> DataFrame:
    """Half-open in time, and by source."""
    if start is not None:
        df = df.where(F.col("ts") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("ts") < F.lit(end))
    if source_ids is not None:
        df = df.where(F.col("source_id").isin(*source_ids)) if source_ids else df.where(F.lit(False))
    return df


def enabled(df: DataFrame, sources: DataFrame) -> DataFrame:
    return df.join(sources.where("enabled").select("source_id"), "source_id", "left_semi")


class VersionedLedger:
    """A ledger kept as immutable version folders and a pointer to the current one.

    A refresh writes a whole new version and then appends a row that names it, so readers see the
    old or the new one, and a run that dies leaves the old one in place.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _current(self) -> tuple[int, str | None]:
        try:
            row = self.spark.read.schema("seq bigint, version string").json(f"{self.root}/versions").orderBy(F.desc("seq"), F.desc("version")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, None
        return (row.seq, row.version) if row else (0, None)

    def read(self) -> DataFrame | None:
        current = self._current()[1]
        return self.spark.read.parquet(f"{self.root}/{current}") if current else None

    def commit(self, df: DataFrame) -> str:
        seq, version = self._current()[0] + 1, f"v-{uuid.uuid4().hex}"
        df.write.partitionBy("source_id").parquet(f"{self.root}/{version}")
        self.spark.createDataFrame([(seq, version)], "seq bigint, version string").coalesce(1).write.mode("append").json(f"{self.root}/versions")
        return version

    def refresh(self, incoming: DataFrame, files: DataFrame, failed: DataFrame | None = None) -> str:
        """Replace the rows of `files` (source_path) by `incoming`; files of `failed` keep theirs.
        Running it again with the same input changes nothing."""
        old = self.read()
        if failed is not None:
            files = retained(incoming, failed, files)
            incoming = incoming.join(failed.select("source_path"), "source_path", "left_anti").select(*incoming.columns)
        if old is None:
            return self.commit(incoming)
        return self.commit(replace_files(old.select(*incoming.columns), incoming, files))

    def upsert(self, incoming: DataFrame) -> str:
        old = self.read()
        return self.commit(incoming if old is None else upsert_latest(old.select(*incoming.columns), incoming))


def export_report(accounts: DataFrame, models: DataFrame, path: str, version: int = 1) -> None:
    """A portable JSON report: a line a breakdown row, ids replaced by ordinals, no paths."""
    for column, prefix in (("source_id", "source"), ("account_id", "account"), ("current_auth_account_id", "current-auth")):
        accounts = anonymise(accounts, column, prefix, ["provider"])
    rows = [d.select(F.lit(version).alias("version"), F.lit(kind).alias("kind"), F.to_json(F.struct(*d.columns)).alias("row")) for kind, d in (("account", accounts), ("model", models))]
    rows[0].unionByName(rows[1]).write.mode("overwrite").json(path)


def export_document(path: str, head: dict[str, object], sources: DataFrame, totals: DataFrame, **breakdowns: DataFrame) -> None:
    """A portable report as one nested JSON document: schema_version, the fields of `head`, sources and
    a summary of totals and breakdowns.

    `sources` (source_id, provider, enabled, monthly_usd) are numbered by id; in every breakdown their
    numbers stand in place of ids, ordinals in order of first appearance in place of accounts, and no
    path is told.  Breakdowns are what a summary shows, a few rows each, and become arrays of one row.
    """
    numbered = sources.select("source_id", F.row_number().over(Window.orderBy("source_id")).alias("_n"), "provider", "enabled", "monthly_usd")
    alias = F.concat(F.lit("source-"), F.col("_n").cast("string"))
    doc = totals.limit(1).select(F.struct(*totals.columns).alias("totals"))
    shown = numbered.agg(F.sort_array(F.collect_list(F.struct("_n", F.struct(alias.alias("id"), "provider", "enabled", "monthly_usd").alias("s")))).alias("s"))
    doc = doc.crossJoin(shown.select(F.col("s.s").alias("sources")))  # one row each
    for name, rows in breakdowns.items():
        order = [c for c in rows.columns if c in ("provider", "source_id", "account_id", "current_auth_account_id", "attribution_confidence", "attribution_basis", "model", "day", "session_id")]
        placed = rows.withColumn("_order", F.struct(*order))
        for column, prefix in (("account_id", "account"), ("current_auth_account_id", "current-auth")):
            if column in rows.columns:
                placed = anonymise(placed, column, prefix, ["_order"])
        if "source_id" in rows.columns:
            placed = placed.join(numbered.select("source_id", "_n"), "source_id", "left").withColumn("source_id", F.coalesce(alias, F.lit("unknown-source")))
        listed = placed.agg(F.sort_array(F.collect_list(F.struct("_order", F.struct(*rows.columns).alias("r")))).alias("l"))
        doc = doc.crossJoin(listed.select(F.col("l.r").alias(name)))
    summary = F.struct("totals", *breakdowns)
    fields = [F.lit(1).alias("schema_version"), *[F.lit(v).alias(k) for k, v in head.items()], "sources", summary.alias("summary")]
    doc.select(*fields).coalesce(1).write.mode("overwrite").json(path)


def save_headline(totals: DataFrame, sources: list[str], priced_on: str, path: str) -> None:
    totals.withColumns({"sources": F.lit("|".join(sorted(sources))), "priced_on": F.lit(priced_on)}).write.mode("overwrite").parquet(path)


def load_headline(spark: SparkSession, sources: list[str], priced_on: str, path: str) -> DataFrame:
    """The snapshot, or no row where the sources or the card have changed."""
    return spark.read.parquet(path).where((F.col("sources") == "|".join(sorted(sources))) & (F.col("priced_on") == priced_on)).drop("sources", "priced_on")
