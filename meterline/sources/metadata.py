"""Dimension tables beside the transcripts (SC6-SC8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_threads(threads: DataFrame, edges: DataFrame) -> DataFrame:
    """Threads (id, rollout_path, model, agent_path) that have a path, with their parent of `edges`
    (parent_thread_id, child_thread_id); of several parents the greatest."""
    parents = edges.groupBy(F.col("child_thread_id").alias("id")).agg(F.max("parent_thread_id").alias("parent_id"))
    joined = threads.where("rollout_path is not null").join(parents, "id", "left")
    return joined.select("id", F.col("rollout_path").alias("path"), "model", "parent_id", (F.col("parent_id").isNotNull() | F.col("agent_path").isNotNull()).alias("is_subagent"))


def read_account_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, account_id) of JSON documents, nested below `event_data` or flat."""
    flat = "session_id string, auth struct<account_uuid:string>"
    docs = spark.read.schema(f"event_data struct<session_id:string,auth:struct<account_uuid:string>>, {flat}").json(path, multiLine=True)
    pairs = docs.select(F.coalesce("event_data.session_id", "session_id").alias("session_id"), F.coalesce("event_data.auth.account_uuid", "auth.account_uuid").alias("account_id"))
    return pairs.where("session_id is not null and account_id is not null").distinct()


def read_account_support(spark: SparkSession, path: str, pattern: str = r"/sessions/([^/]+)/") -> DataFrame:
    """(session_id, account_id) of JSON documents whose path names the account."""
    docs = spark.read.schema("sessionId string").option("recursiveFileLookup", True).json(path, multiLine=True)
    pairs = docs.select(F.col("sessionId").alias("session_id"), F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).alias("account_id"))
    return pairs.where("session_id is not null and account_id <> ''").distinct()
