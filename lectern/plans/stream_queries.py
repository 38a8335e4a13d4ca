"""Streaming forms of the event operators; their results equal those of the batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import events as E
from .job_queries import SQL as JOB_SQL


def _events(spark: SparkSession, d: str) -> DataFrame:
    return E.event_stream(spark, f"{d}/job_events.parquet*")


def q_stream_partials(spark: SparkSession, d: str) -> DataFrame:
    return E.run_available(E.latest_partials(_events(spark, d)), ["job_id", "file_id", "line_no"], ["seq"])


def q_stream_tail(spark: SparkSession, d: str) -> DataFrame:
    out = E.run_available(E.bounded_tail(_events(spark, d)), ["job_id"], [])
    return out.select("job_id", F.explode(F.arrays_zip(F.col("seqs").alias("seq"), F.col("kinds").alias("kind"))).alias("z")).select("job_id", "z.seq", "z.kind")


QUERIES = {f.__name__: f for f in (q_stream_partials, q_stream_tail)}
SQL = {"q_stream_partials": JOB_SQL["q_partials_latest"], "q_stream_tail": JOB_SQL["q_event_tail"]}
