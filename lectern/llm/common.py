"""Shared pieces of the training-data operators.

Texts are *normalised* first: one leading BOM is dropped and CRLF and CR become LF, so lines, characters (code points)
and offsets always refer to that form. A null text stays null.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_EOL = re.compile(r"\r\n?")


def normal(text: str) -> str:
    if text.startswith("\ufeff"):
        text = text[1:]
    return _EOL.sub("\n", text) if "\r" in text else text


def normal_column(c: Column) -> Column:
    """The same on the JVM."""
    return F.regexp_replace(F.regexp_replace(c, "^\ufeff", ""), "\r\n?", "\n")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a small input that one task of a Python stage gets.
TASK_BYTES = 1_000_000


def spread(df: DataFrame) -> DataFrame:
    """Gives the Python stage at least two tasks a core and one per TASK_BYTES; few row groups would leave cores idle.

    Only an input with fewer splits than that is repartitioned (round robin, no key, so no skew), so at most some hundred
    megabytes a core are ever moved; at scale the scan itself has enough splits and nothing is shuffled.
    """
    spark = df.sparkSession
    want = 2 * spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(want, size // TASK_BYTES))


def tasks(df: DataFrame) -> int:
    """Tasks for a stage that computes much over few bytes, which Spark would otherwise merge into one or two."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def bounded(df: DataFrame, most: int, what: str) -> list:
    """The rows of a small table on the driver. A table above the bound is an error, never cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows")
    return rows


#: Bytes of values that become Python objects at once; a larger row stands alone.
SLICE_BYTES = 16_000_000


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `most` bytes by its average row, halved again where rows are uneven."""
    if batch.num_rows <= 1 or batch.nbytes <= most:
        yield batch
        return
    half = batch.num_rows // 2
    for part in (batch.slice(0, half), batch.slice(half)):
        yield from slices(part, most)


def map_rows(df: DataFrame, columns: list[str], each: Callable[..., list[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """Calls each(*values) for every row and makes rows of the tuples that it returns, some 16 MB of values at a time."""
    width = len(schema)

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], schema.field(i).type) for i in range(width)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                out: list[tuple] = []
                for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                    out += each(*row)
                    if len(out) >= 20_000:
                        yield made(out)
                        out = []
                yield made(out)

    return df.select(*columns).mapInArrow(run, ddl)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder of spark.checkpoint.dir. Only a local master may leave it unset."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lectern-"))
    return df.checkpoint()
