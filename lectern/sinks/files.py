"""Files written atomically: to a temporary name in the target folder, then renamed."""

from __future__ import annotations

import contextlib
import hashlib
import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import encoded
from ..operators.jobs import upserted
from ..operators.units import BINARY
from ..sources.cache import SOURCE_ID


def write_files(df: DataFrame, folder: str, name: str = "output_name", content: str = "content") -> None:
    """One file per row in a folder that all executors share. A repeated task replaces its own files with equal ones."""

    def publish(rows):
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            base = os.path.basename(row[0].replace("\\", "/"))
            held = os.path.join(folder, f".{base}.{uuid.uuid4().hex}")
            with open(held, "wb") as f:
                f.write(bytes(row[1]))
            os.replace(held, os.path.join(folder, base))

    df.select(name, content).foreachPartition(publish)


def text_outputs(df: DataFrame) -> DataFrame:
    """(output_name, content BINARY) of rows with output_name, content, text_eol, text_bom."""
    return df.select("output_name", F.encode(encoded(F.col("content"), F.col("text_eol"), F.col("text_bom")), "UTF-8").alias("content"))


def write_index(old: DataFrame, new: DataFrame, path: str) -> None:
    """The index with new entries put over the old ones, as a new snapshot. old may be read from path itself: the snapshot
    is written beside it and takes its name when it is whole."""
    aside = f"{path}.{uuid.uuid4().hex}"
    upserted(old.unionByName(new, allowMissingColumns=True)).write.parquet(aside)
    fs, at, held = _paths(old, path, aside)
    fs.delete(at, True)
    if not fs.rename(held, at):
        raise OSError(f"{aside} could not take the name {path}")


def clear_index(spark: SparkSession, path: str) -> int:
    """Deletes the index and tells how many entries it had; a missing one has none. Outputs stay."""
    fs, at = _paths(spark.range(0), path)
    if not fs.exists(at):
        return 0
    n = spark.read.parquet(path).count()
    fs.delete(at, True)
    return n


def _paths(df: DataFrame, *paths: str) -> tuple:
    spark = df.sparkSession
    made = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return made[0].getFileSystem(spark._jsc.hadoopConfiguration()), *made


def cache_source(folder: str, name: str, data: bytes, fail: Callable[[], None] | None = None) -> tuple[str, str]:
    """(source_id, digest) of a binary source put into the cache. If anything fails, nothing of it stays."""
    suffix = os.path.splitext(name)[1].lower()
    if suffix not in BINARY or not data:
        raise ValueError("not a binary document")
    os.makedirs(folder, exist_ok=True)
    source_id = uuid.uuid4().hex + suffix
    target = os.path.join(folder, source_id)
    try:
        with open(f"{target}.tmp", "wb") as f:
            f.write(data)
        os.replace(f"{target}.tmp", target)
        if fail:
            fail()
        return source_id, hashlib.sha256(data).hexdigest()
    except BaseException:
        delete_source(folder, source_id)
        raise


def delete_source(folder: str, source_id: str) -> bool:
    """Removes a source with its recognition cache; whether it was there."""
    if not re.fullmatch(SOURCE_ID.removeprefix(r"\A").removesuffix(r"\z"), source_id):
        raise ValueError("not a source id")
    path = os.path.join(folder, source_id)
    there = os.path.isfile(path)
    for extra in ("", ".tmp", ".ocr.json", ".ocr.json.tmp"):
        with contextlib.suppress(FileNotFoundError):
            os.remove(path + extra)
    return there


def finished(results: DataFrame, disk: DataFrame | None = None) -> DataFrame:
    """(job_id, output_name, content) of the results that came out well, with what lies on disk (output_name, content) where
    it does: an edit made later is there."""
    good = results.where("status = 'ok'").select("job_id", "output_name", "content")
    if disk is None:
        return good
    there = disk.select("output_name", F.col("content").alias("_disk"))
    return good.join(there, "output_name", "left").select("job_id", "output_name", F.coalesce("_disk", "content").alias("content"))


def write_archives(df: DataFrame, folder: str, key: str = "job_id") -> None:
    """One ZIP per key of rows (key, output_name, content) in a shared folder; `finished` chooses what goes in.

    Rows are clustered and sorted by key; a task writes one archive at a time, member by member, so an archive never
    has to fit into memory.
    """

    def publish(rows):
        import zipfile

        os.makedirs(folder, exist_ok=True)
        now, held, archive, seen = None, None, None, set()

        def close():
            if archive is not None:
                archive.close()
                os.replace(held, os.path.join(folder, f"{now}.zip"))

        for k, name, content in rows:
            if k != now or archive is None:
                close()
                now, seen = k, set()
                held = os.path.join(folder, f".{k}.{uuid.uuid4().hex}")
                archive = zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED)
            if name not in seen:
                seen.add(name)
                archive.writestr(name, bytes(content or b""))
        close()

    df.repartition(key).sortWithinPartitions(key, "output_name").select(key, "output_name", "content").foreachPartition(publish)
