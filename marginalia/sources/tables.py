"""Readers: tables, folders of page files, JSON documents, file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def page_files(spark: SparkSession, folder: str) -> DataFrame:
    """page, path, text of files named page-NNN.txt, wherever they lie below the folder. Other names are not read."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "page-*.txt").text(folder, wholetext=True)
    page = F.regexp_extract("_metadata.file_name", r"page-(\d+)\.txt", 1).try_cast("int")
    return files.select(page.alias("page"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).filter("page IS NOT NULL")


def json_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One row for each JSON document. Fields that the schema lacks are dropped; documents that don't parse give nulls."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, bytes, modified of files below a folder; lock files of office programs are left out. Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")).filter(~F.col("path").rlike(r"/~\$[^/]*$"))
