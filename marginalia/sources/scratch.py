"""Intermediate tables in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder of the setting; where it is unset and all of Spark is one process, a temporary one that is set for the session."""
    found = spark.conf.get(_SETTING, None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set {_SETTING} to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="marginalia-tables-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set(_SETTING, found)
    return found if "://" in found or not found.startswith("/") else f"file://{found}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table written there and read again: what uses them more than once doesn't compute them again, and a lost executor costs a re-read."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
