"""Folders that driver and executors share, for queries that land files and read them back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The temporary folder of an application for which no shared one is set, as in tests.
_OWN: dict[str, str] = {}


def shared_base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset, as in tests, a temporary folder, the same for the whole application."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-landing-")
        found = _OWN[app]
    return found.rstrip("/")


def landing(spark: SparkSession, kind: str) -> str:
    """A new folder name below the shared one."""
    return f"{shared_base(spark)}/{kind}-{uuid.uuid4().hex}"


def landed(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: what several branches use is worked out once, and survives lost executors."""
    path = landing(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
