"""The event stream: latest partial texts, bounded tails, checkpoints. Stateful operators over Structured Streaming.

State and output live in the folder of spark.checkpoint.dir, which all executors share; a query restarted with the same
location goes on where it was.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.jobs import latest

EVENTS = "job_id string, seq long, kind string, file_id long, file_name string, idx int, line_no int, text string, done int, total int, ts timestamp_ntz, arrived_at timestamp_ntz"
TAIL = 256


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def latest_partials(events: DataFrame) -> DataFrame:
    """The last text of every line in the making. Use update mode; a doubled event changes nothing."""
    chunks = events.where("kind = 'chunk' and text is not null")
    return chunks.groupBy("job_id", "file_id", "line_no").agg(F.max_by("text", "seq").alias("text"), F.max("seq").alias("seq"))


def _keep(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    held = dict(zip(*state.get)) if state.exists else {}
    for batch in batches:
        held.update(zip(batch.seq.tolist(), batch.kind.tolist()))
        for seq in sorted(held)[:-TAIL]:
            del held[seq]
    seqs = sorted(held)
    state.update((seqs, [held[s] for s in seqs]))
    yield pd.DataFrame({"job_id": [key[0]], "seqs": [seqs], "kinds": [[held[s] for s in seqs]]})


def bounded_tail(events: DataFrame) -> DataFrame:
    """Per job the newest TAIL events as one row; the state never holds more."""
    keyed = events.select("job_id", "seq", "kind").groupBy("job_id")
    return keyed.applyInPandasWithState(_keep, "job_id string, seqs array<long>, kinds array<string>", "seqs array<long>, kinds array<string>", "update", "NoTimeout")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a local master may leave it unset."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="lectern-")


def run_available(out: DataFrame, keys: list[str], order: list[str], location: str | None = None) -> DataFrame:
    """Runs a stateful query over what is there and gives the last row of each key of its updates."""
    spark = out.sparkSession
    location = location or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        # Overwriting the batch's own folder makes a repeated batch harmless.
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{location}/out/batch={number}")

    query = out.writeStream.outputMode("update").option("checkpointLocation", f"{location}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return latest(spark.read.parquet(f"{location}/out").drop("batch"), keys, ["_batch", *order]).drop("_batch")
