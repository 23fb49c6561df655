"""What the operators of this subpackage share: the cluster's shared folder and tables cut from their lineage there."""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where it is unset and all of Spark is one process, a local one is set for the session."""
    found = spark.conf.get(_SETTING, None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set {_SETTING} to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="marginalia-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        found = f"file://{local}"
        spark.conf.set(_SETTING, found)
    return found if "://" in found or not found.startswith("/") else f"file://{found}"


class Scratch:
    """Tables and files of one operator call, in a folder of their own in the shared folder.

    ``save`` writes a DataFrame and reads it again, which cuts its lineage: a lost executor costs a re-read, and
    ids that were dealt out once stay as they are. ``drop`` removes a table that nothing will read any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.folder(name))
        return self.load(df, name)

    def load(self, df: DataFrame, name: str) -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(self.folder(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.folder(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(task: Task) -> Task:
    """The task, which hands memory that it has freed back to the system at its end: Spark's Python workers stay for the next tasks."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return run


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str):
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))
