"""Working folders below the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def working_folder(spark: SparkSession, name: str) -> str:
    """A new folder name; below a temporary folder only where the setting is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-meterline-"))
    return f"{base.rstrip('/')}/meterline/{name}-{uuid.uuid4().hex}"
