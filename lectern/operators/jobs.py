"""Jobs, events and the output index as keyed tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def events_once(events: DataFrame) -> DataFrame:
    """Events logged twice differ in their arrival only; (job_id, seq) is their key and the first arrival stays.

    One aggregate per column, so that columns which nobody asks for are neither read nor shuffled.
    """
    rest = [c for c in events.columns if c not in ("job_id", "seq", "arrived_at")]
    return events.groupBy("job_id", "seq").agg(*(F.any_value(c).alias(c) for c in rest), F.min("arrived_at").alias("arrived_at"))


def latest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The last row of each key, as an aggregate, so that a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_r"))
    return picked.select(*keys, *(C(f"_r.{c}").alias(c) for c in rest))


def upserted(index: DataFrame) -> DataFrame:
    """The index after all writes: the last write of a name wins, ties by the source."""
    return latest(index, ["output_name"], ["written_at", "source_sha256", "source_name"])


def tail(events: DataFrame, most: int = 256) -> DataFrame:
    """What a bounded queue that drops its oldest entries still holds.

    Ranked densely, so doubled events share a rank and are dropped afterwards, inside the window's partitions: one
    shuffle, before which Spark prunes each task's rows to the first `most` ranks of a job.
    """
    order = Window.partitionBy("job_id").orderBy(F.desc("seq"))
    return events.withColumn("_n", F.dense_rank().over(order)).where(C("_n") <= most).drop("_n").distinct()


def turns(files: DataFrame, most: int = 1024) -> DataFrame:
    """Adds turn to (job_id, first, idx, file_id): priority files before the others, both in the order of idx.

    A job may hold a third of all files: ranks are made within buckets of idx, and only the buckets' counts are summed
    over a job.
    """
    order = ["rest", "bucket"]
    df = files.withColumn("rest", (~C("first")).cast("int")).withColumn("bucket", F.expr(f"coalesce(idx, -1) div {most}"))
    counts = df.groupBy("job_id", *order).agg(F.count("*").alias("n"))
    before = Window.partitionBy("job_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("job_id", *order).orderBy("idx", "file_id"))
    return df.withColumn("own", own).join(offsets, ["job_id", *order]).withColumn("turn", C("own") + C("offset")).drop("own", "offset", *order)


def retained(jobs: DataFrame, most: int, most_chars: int) -> DataFrame:
    """(job_id) of jobs (job_id, at, chars) that stay: from the newest while count and characters allow. A job too large is
    skipped, not a stop.

    What is kept depends on what was kept before, so one task streams over the sorted numbers; it holds three of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = chars = 0
        for batch in batches:
            kept = []
            for job, size in zip(*(c.to_pylist() for c in batch.columns)):
                if n < most and (not n or chars + size <= most_chars):
                    kept.append(job)
                    n, chars = n + 1, chars + size
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string())], names=["job_id"])
            if n == most:
                return

    return jobs.repartition(1).sortWithinPartitions(F.desc("at"), "job_id").select("job_id", "chars").mapInArrow(run, "job_id string")


def page_selection(selection: Column, count: Column) -> Column:
    """Pages named by a selection like 1,3-5 in order, null where it is not valid for the page count."""
    value = F.lower(F.regexp_replace(selection, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", ""))
    tokens = F.transform(F.split(value, ","), lambda t: F.regexp_replace(t, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", ""))
    pattern = r"(?U)\A([0-9]+)(?:\s*-\s*([0-9]+))?\z"

    def bounds(t: Column) -> Column:
        first = F.regexp_extract(t, pattern, 1).cast("int")
        last = F.regexp_extract(t, pattern, 2)
        return F.struct(first.alias("first"), F.when(last == "", first).otherwise(last.cast("int")).alias("last"))

    ranges = F.transform(tokens, bounds)
    valid = F.forall(tokens, lambda t: t.rlike(pattern)) & F.forall(ranges, lambda r: (r["first"] >= 1) & (r["last"] <= count) & (r["first"] <= r["last"]))
    pages = F.sort_array(F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.sequence(r["first"], r["last"])))))
    whole = F.sequence(F.lit(1), count)
    return F.when(count < 1, None).when(selection.isNull() | (selection == "") | (value == "all"), whole).when(valid, pages)


def page_ranges(pages: Column, count: Column) -> Column:
    """The canonical text of a set of pages: all, or runs like 1,3-5."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("first"), F.lit(-1).alias("last"))

    def closed(a: Column) -> Column:
        run = F.when(a["first"] == a["last"], a["first"].cast("string")).otherwise(F.concat(a["first"].cast("string"), F.lit("-"), a["last"].cast("string")))
        return F.when(a["last"] < 0, a["text"]).when(a["text"] == "", run).otherwise(F.concat(a["text"], F.lit(","), run))

    def step(a: Column, p: Column) -> Column:
        on = p == a["last"] + 1
        return F.struct(F.when(on, a["text"]).otherwise(closed(a)).alias("text"), F.when(on, a["first"]).otherwise(p).alias("first"), p.alias("last"))

    return F.when(F.size(pages) == count, "all").otherwise(F.aggregate(pages, start, step, closed))


def grown_budgets(first: Column, limit: Column, attempts: int) -> Column:
    """Token budgets of successive attempts after an output that was too long."""

    def step(a: Column, _: Column) -> Column:
        last = F.element_at(a, -1)
        grown = F.least(limit, F.greatest(last + 256, F.floor(last * F.lit(1.75)).cast("int")))
        return F.when(grown > last, F.concat(a, F.array(grown))).otherwise(a)

    return F.aggregate(F.sequence(F.lit(2), F.lit(attempts)), F.array(first), step)


def running(df: DataFrame, key: str, order: str, value: str, most: int = 1024) -> DataFrame:
    """Adds before, the sum of value over the rows of key that come earlier in order (0, 1, 2, …).

    Summed within buckets of `most` orders; only the buckets' sums are summed over a key, so a hot key is no hot task.
    """
    rows = df.withColumn("_b", F.expr(f"{order} div {most}"))
    sums = rows.groupBy(key, "_b").agg(F.sum(value).alias("_s"))
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(key, "_b", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_o"))
    own = F.sum(value).over(Window.partitionBy(key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_w", F.coalesce(own, F.lit(0))).join(offsets, [key, "_b"]).withColumn("before", C("_w") + C("_o")).drop("_b", "_w", "_o")


#: Version of the recognition caches that this engine reads.
CACHE_VERSION = 1


def cache_states(sources: DataFrame, caches: DataFrame) -> DataFrame:
    """(source_id, valid) of every cache (source_id, version, size, mtime): it counts only for the file as it is now."""
    now = sources.select("source_id", C("size").alias("_size"), C("mtime").alias("_mtime"))
    same = (C("version") == CACHE_VERSION) & (C("size") == C("_size")) & (C("mtime") == C("_mtime"))
    return caches.join(now, "source_id", "left").select(*caches.columns, F.coalesce(same, F.lit(False)).alias("valid"))


def rewritten(results: DataFrame, edits: DataFrame, deleted: DataFrame) -> DataFrame:
    """Job results (output_name, content, …) after edits (output_name, new) and without the outputs in deleted."""
    held = results.join(deleted.select("output_name").distinct(), "output_name", "left_anti")
    return held.join(edits.select("output_name", "new"), "output_name", "left").withColumn("edited", C("new").isNotNull()).withColumn("content", F.coalesce("new", "content")).drop("new")


def first_running(jobs: DataFrame) -> DataFrame:
    """(kind, job_id): the first job of each kind that runs."""
    return jobs.where("status = 'running'").groupBy(F.coalesce("kind", F.lit("document")).alias("kind")).agg(F.min_by("job_id", F.struct("created_at", "job_id")).alias("job_id"))
