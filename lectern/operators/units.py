"""Documents as units: one per physical line, either locked or prefix, text and suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

BINARY = [".docx", ".epub", ".pdf"]
SUBTITLES = [".srt", ".vtt"]


def _order(key: str) -> Window:
    return Window.partitionBy(key).orderBy("line_no")


def fence_state(lines: DataFrame, key: str = "file_id") -> DataFrame:
    """Adds is_fence and in_fence: the parity of the fences above a line."""
    before = _order(key).rowsBetween(Window.unboundedPreceding, -1)
    df = lines.withColumn("is_fence", F.col("line").rlike(T.FENCE))
    return df.withColumn("in_fence", F.coalesce(F.sum(F.col("is_fence").cast("int")).over(before) % 2, F.lit(0)) == 1)


def markdown_units(lines: DataFrame, key: str = "file_id") -> DataFrame:
    return fence_state(lines, key).withColumn("unit", T.markdown_unit(F.col("line"), F.col("in_fence"))).drop("is_fence", "in_fence")


def subtitle_locks(lines: DataFrame, key: str = "file_id") -> DataFrame:
    """Adds what locks a subtitle line: header, block, blank, timing, cue."""
    whole = Window.partitionBy(key)
    order = _order(key)
    s = T.strip(F.col("line"))
    vtt = F.col("ext") == ".vtt"
    df = lines.withColumn("blank", s == "").withColumn("timing", F.col("line").rlike(T.TIMING))
    opened = F.max(F.when((F.col("line_no") == 0) & T.strip(F.regexp_replace("line", r"\A\x{feff}+", "")).startswith("WEBVTT"), True)).over(whole)
    first_blank = F.min(F.when(F.col("blank") & (F.col("line_no") > 0), F.col("line_no"))).over(whole)
    df = df.withColumn("header", vtt & F.coalesce(opened, F.lit(False)) & F.coalesce(F.col("line_no") <= first_blank, F.lit(True)))
    # The last thing that opened or closed a control block decides; the blank line that closes one still belongs to it.
    event = F.when(s.rlike(rf"(?U)\A(?:NOTE(?:{T.WS}|\z)|STYLE\z|REGION\z)"), 1).when(F.col("blank"), 0)
    state = F.coalesce(F.last(event, True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    df = df.withColumn("block", vtt & ((state == 1) | (F.col("blank") & (F.coalesce(F.last(event, True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1))))
    following = F.lead(F.col("timing") & ~F.col("block"), 1, False).over(order)
    return df.withColumn("cue", following & ~F.col("blank") & (vtt | s.rlike(r"\A\p{Nd}+\z")))


def subtitle_units(lines: DataFrame, key: str = "file_id") -> DataFrame:
    df = subtitle_locks(lines, key).withColumn("unit", T.plain_unit(F.col("line")))
    locked = F.col("header") | F.col("block") | F.col("blank") | (F.col("timing") & ~F.col("block")) | F.col("cue")
    free = F.col("unit.translate") & ~locked
    unit = F.struct(free.alias("translate"), *(F.when(free, F.col(f"unit.{n}")).alias(n) for n in ("prefix", "text", "suffix")))
    return df.withColumn("unit", unit).drop("blank", "timing", "header", "block", "cue")


def document_units(lines: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, ext, line_no, line, unit) by format: subtitles, containers, everything else as Markdown.

    One window partitioning by file serves both line scans; every format goes through each file's own rows only.
    """
    plain = T.plain_unit(F.col("line"))
    plain = F.struct(plain["translate"].alias("translate"), *(F.when(plain["translate"], plain[n]).alias(n) for n in ("prefix", "text", "suffix")))
    return (
        subtitle_units(lines.where(F.col("ext").isin(SUBTITLES)), key)
        .unionByName(lines.where(F.col("ext").isin(BINARY)).withColumn("unit", plain))
        .unionByName(markdown_units(lines.where(~F.col("ext").isin(BINARY + SUBTITLES)), key))
    )


def translatable(units: DataFrame, key: str = "file_id") -> DataFrame:
    """Units to translate with their position among them."""
    return units.where("unit.translate").withColumn("position", F.row_number().over(_order(key)) - 1)


def rebuilt(lines: DataFrame, key: str, text: str) -> DataFrame:
    """(key, content): ordered lines joined again."""
    pairs = F.sort_array(F.collect_list(F.struct("line_no", F.col(text).alias("x"))))
    return lines.groupBy(key).agg(F.array_join(F.transform(pairs, lambda p: p["x"]), "\n").alias("content"))


def stub(text: Column) -> Column:
    """The deterministic stand-in for a model."""
    return F.concat(F.lit("译："), text)


def translated(units: DataFrame, key: str = "file_id") -> DataFrame:
    """Adds out: the line with its text translated by the stub, or as it was."""
    return units.withColumn("out", F.when(F.col("unit.translate"), F.concat("unit.prefix", stub(F.col("unit.text")), "unit.suffix")).otherwise(F.col("line")))
