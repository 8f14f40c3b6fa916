"""Upserts, manifests and scopes: keeping a ledger up to date (SK2-SK5, I2-I10, U2, U3, F13-F15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import COUNTS
from .dedup import latest


def upsert_latest(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """By id; an incoming row replaces one that is not later."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return latest(both, ["id"], [F.desc("ts"), F.desc("_new")]).drop("_new")


def upsert_accumulate(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """By id; all counters and the event count add up, other columns keep the existing row's."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    sums = [c for c in ("event_count", *COUNTS) if c in existing.columns]
    rest = [c for c in existing.columns if c not in ("id", *sums)]
    return both.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("_new", "ts")).alias("_r"), *[F.sum(c).cast("long").alias(c) for c in sums]).select(*[F.col(f"_r.{c}").alias(c) if c in rest else F.col(c) for c in existing.columns])


def replace_files(existing: DataFrame, incoming: DataFrame, files: DataFrame, key: str = "source_path") -> DataFrame:
    """Rows of `files` (key) leave, the incoming rows enter; idempotent."""
    return existing.join(files.select(key).distinct(), key, "left_anti").select(*existing.columns).unionByName(incoming.select(*existing.columns))


def remove_sources(table: DataFrame, removed: DataFrame) -> DataFrame:
    return table.join(removed.select("source_id").distinct(), "source_id", "left_anti").select(*table.columns)


def diff_manifest(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, state) of both (path, size, modified): new, changed, unchanged or removed."""
    old = manifest.select("path", F.col("size").alias("_s"), F.col("modified").alias("_m"), F.lit(True).alias("_old"))
    joined = listing.select("path", "size", "modified", F.lit(True).alias("_new")).join(old, "path", "full_outer")
    same = F.col("size").eqNullSafe(F.col("_s")) & F.col("modified").eqNullSafe(F.col("_m"))
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return joined.select("path", state.alias("state"))


def known_paths(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    return manifest.select("path").union(ledger.select(F.col("source_path").alias("path"))).distinct()


def stale_paths(known: DataFrame, seen: DataFrame) -> DataFrame:
    return known.select("path").distinct().join(seen.select("path"), "path", "left_anti")


def retained(existing: DataFrame, failed: DataFrame, replaced: DataFrame) -> DataFrame:
    """Files to replace without those that failed to parse: their old rows stay."""
    return replaced.select("source_path").distinct().join(failed.select("source_path"), "source_path", "left_anti")


def _prefixes(path: Column, proper: bool = False) -> Column:
    """The folders that hold a path, the path itself among them unless `proper`."""
    parts = F.split(F.rtrim(path, F.lit("/")), "/")
    upto = F.size(parts) - int(proper)
    return F.transform(F.filter(F.sequence(F.lit(0), upto), lambda n: n > 0), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def narrow_scopes(scopes: DataFrame) -> DataFrame:
    """Without the scopes that hold another changed scope."""
    bare = F.rtrim("scope", F.lit("/"))
    holders = scopes.select(F.explode(_prefixes(F.col("scope"), proper=True)).alias("_p")).distinct()
    return scopes.select("scope").distinct().join(holders, bare == F.col("_p"), "left_anti")


def scope_filter(paths: DataFrame, scopes: DataFrame) -> DataFrame:
    """Paths inside a changed scope: each path's own prefixes joined with the scopes."""
    bare = scopes.select(F.rtrim("scope", F.lit("/")).alias("_p")).distinct()
    inside = paths.select("path", F.explode(_prefixes(F.col("path"))).alias("_p")).join(bare, "_p", "left_semi").select("path").distinct()
    return paths.join(inside, "path", "left_semi")


def reprice_selection(ledger: DataFrame, changes: list[Column], models: Column, coarse: Column) -> DataFrame:
    """Files with rows that a rate change touches: coarse rows, or rows of `models` within a day of a change."""
    near = F.lit(False)
    for change in changes:
        near = near | ((F.col("ts") >= change - F.expr("interval 1 day")) & (F.col("ts") < change + F.expr("interval 1 day")))
    return ledger.where((F.col("provider") == "counter") & (coarse | (models & near))).select("source_id", "source_path").distinct()


def appended(manifest: DataFrame) -> DataFrame:
    """Files whose cursor an append moved: they are parsed again before their totals are final."""
    return manifest.where("appended").select("path")


def content_guard(lines: DataFrame, upto: Column, width: int = 65536) -> DataFrame:
    """Per path a hash of the lines in the first `width` bytes and in the last `width`, both of those
    before the cursor `upto`: equal guards tell an append from a rewrite, in short files too."""

    def digest(inside: Column) -> Column:
        rows = F.sort_array(F.collect_list(F.when(inside, F.struct("byte_offset", F.xxhash64("value").alias("h")))))
        return F.xxhash64(F.to_json(rows))

    seen = F.col("byte_offset") < upto
    return lines.groupBy("path").agg(digest(seen & (F.col("byte_offset") < width)).alias("head"), digest(seen & (F.col("byte_offset") >= upto - width)).alias("tail"))


def metadata_fingerprint(listing: DataFrame) -> DataFrame:
    """One number of the dimension files' names, sizes and times, in any order of listing: the sum of 60
    bits of each entry's MD5."""
    entry = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in ("path", "size", "modified")]).cast("binary"))
    bits = F.conv(F.substring(entry, 1, 15), 16, 10).cast("decimal(38,0)")
    return listing.agg(F.coalesce(F.sum(bits), F.lit(0)).cast("string").alias("fingerprint"))


def append_seed(rows: DataFrame, saved: DataFrame) -> DataFrame:
    """Rows past the cursor, preceded by the saved snapshot and model of each file (`saved`: the
    same columns, with an offset before the new rows)."""
    return saved.select(*rows.columns).unionByName(rows)
