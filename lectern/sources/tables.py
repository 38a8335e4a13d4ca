"""Input tables in the forms that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension, normalized


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def balanced(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than two a core is spread over the cores, round robin; a large one is left as it is."""
    want = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def files(spark: SparkSession, sf_dir: str, *columns: str | Column) -> DataFrame:
    """Files, each once however often delivered: deliveries of one file differ in received_at only."""
    df = table(spark, sf_dir, "files")
    return df.select("file_id", *columns).dropDuplicates(["file_id"])


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, name, ext, content, t): files with their suffix and normalised text."""
    return files(spark, sf_dir, "name", "content").withColumn("ext", extension(F.col("name"))).withColumn("t", normalized(F.col("content")))


def lines(df: DataFrame, *keys: str, text: str = "t") -> DataFrame:
    """(keys, line_no, line): one row per physical line, blank ones too."""
    return df.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(texts(spark, sf_dir), "file_id", "ext")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, line) of all documents that have a text."""
    df = balanced(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"))
    return lines(df.select("doc_id", normalized(F.col("text")).alias("t")), "doc_id")
