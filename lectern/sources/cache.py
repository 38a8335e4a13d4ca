"""Binary sources by id: checked lookups, digests, streaming ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE_ID = r"\A[0-9a-f]{32}\.(?:docx|epub|pdf)\z"


def binary_files(spark: SparkSession, folder: str) -> DataFrame:
    """(source_id, path, length, content); a listing that leaves out content reads no file."""
    return spark.read.format("binaryFile").load(folder).withColumn("source_id", F.regexp_extract("path", r"([^/]*)\z", 1))


def verified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of manifest (source_id, source_sha256, source_format) with their content and a state: ok, bad_id, missing, format, digest."""
    found = manifest.join(files.select("source_id", "content"), "source_id", "left")
    suffix = F.regexp_extract("source_id", r"\.([a-z]+)\z", 1)
    state = (
        F.when(~F.col("source_id").rlike(SOURCE_ID), "bad_id").when(F.col("content").isNull(), "missing").when(F.col("source_format") != suffix, "format")
        .when(F.sha2("content", 256) != F.col("source_sha256"), "digest").otherwise("ok")
    )
    return found.withColumn("state", state)


def arriving(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """The landing folder as a stream of (source_id, source_sha256, length, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    df = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return df.select(F.regexp_extract("path", r"([^/]*)\z", 1).alias("source_id"), F.sha2("content", 256).alias("source_sha256"), "length", "content")
