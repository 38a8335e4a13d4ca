"""Round trips of DOCX and EPUB containers made from the files' lines."""

from __future__ import annotations

import io
import warnings
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import containers as K
from ..sources.tables import files
from . import sql as S

QUERIES: dict = {}
SQL: dict = {}
C = F.col
_BAD = r"[^\x09\x0a\x0d\x20-\x{d7ff}\x{e000}-\x{fffd}\x{10000}-\x{10ffff}]"
_ROWS = rf"""p AS (SELECT file_id, list_filter(list_transform(string_split(regexp_replace(t, '{_BAD}', '', 'g'), chr(10)), lambda x: {S.collapsed("x")}), lambda x: x <> '') AS p FROM nf),
    r AS (SELECT file_id, p, unnest(range(len(p))) AS unit_no, unnest(p) AS text FROM p)"""


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    clean = F.split(F.regexp_replace(T.normalized(C("content")), _BAD, ""), "\n")
    return files(spark, d, "content").select("file_id", F.filter(F.transform(clean, T.collapsed), lambda x: x != "").alias("p")).where(F.size("p") > 0)


def _trip(spark: SparkSession, d: str, form: str) -> DataFrame:
    made = K.packed_containers(_paragraphs(spark, d), "file_id", "p", form)
    return K.container_units(made, "key", "content", form).select(C("key").alias("file_id"), "unit_no", "text", "error")


def _rebuilt(spark: SparkSession, d: str, form: str) -> DataFrame:
    """Pack, translate with the stub, write back, read again."""
    paragraphs = _paragraphs(spark, d)
    made = K.packed_containers(paragraphs, "file_id", "p", form).withColumnRenamed("key", "file_id")
    stubbed = made.join(paragraphs, "file_id").withColumn("q", F.transform("p", lambda x: F.concat(F.lit("译："), x)))
    return K.container_units(K.built_containers(stubbed, "file_id", "content", "q", form), "key", "content", form).select(C("key").alias("file_id"), "unit_no", "text", "error")


_SAME = f"WITH {S.FILES}, {_ROWS} SELECT file_id, unit_no::INT AS unit_no, text, NULL::VARCHAR AS error FROM r"
_STUB = f"WITH {S.FILES}, {_ROWS} SELECT file_id, unit_no::INT AS unit_no, '译：' || text AS text, NULL::VARCHAR AS error FROM r"


def q_docx_units(spark: SparkSession, d: str) -> DataFrame:
    return _trip(spark, d, "docx")


def q_epub_units(spark: SparkSession, d: str) -> DataFrame:
    return _trip(spark, d, "epub")


def q_docx_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _rebuilt(spark, d, "docx")


def q_epub_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _rebuilt(spark, d, "epub")


QUERIES.update({f.__name__: f for f in (q_docx_units, q_epub_units, q_docx_round_trip, q_epub_round_trip)})
SQL.update({"q_docx_units": _SAME, "q_epub_units": _SAME, "q_docx_round_trip": _STUB, "q_epub_round_trip": _STUB})


# What is done to a container before it is read, and what its reader says (the part before a colon).
SPOILED = {
    "": None, "cut": "not a readable container", "empty": "the container is empty", "twice": "a path occurs twice", "bomb": "absurd compression ratio", "flag": "encrypted members",
    "other": "not an EPUB container", "locked": "encrypted text", "free": None, "crc": "damaged member",
}


def spoiled(data: bytes, how: str) -> bytes:
    """A container with one fault."""
    if how == "cut":
        return data[:-40]
    if how == "empty":
        return b""
    if how == "flag":
        at = data.index(b"PK\x01\x02") + 8
        return data[:at] + bytes([data[at] | 1]) + data[at + 1 :]
    if how == "crc":
        at = data.rindex(b"PK\x01\x02") + 16
        return data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :]
    held = io.BytesIO(data)
    names = {"twice": "OPS/a.xhtml", "bomb": "OPS/zero.bin", "locked": "META-INF/encryption.xml", "free": "META-INF/encryption.xml"}
    if how in names:
        uri = {"locked": "OPS/a.xhtml", "free": "OPS/font.otf"}.get(how, "")
        body = bytes(4_000_000) if how == "bomb" else f'<encryption><EncryptedData><CipherReference URI="{uri}"/></EncryptedData></encryption>'
        with warnings.catch_warnings(), zipfile.ZipFile(held, "a", zipfile.ZIP_DEFLATED) as z:
            warnings.simplefilter("ignore")
            z.writestr(names[how], body)
        return held.getvalue()
    if how == "other":
        return K.packed(["x"], "docx")
    return data


_HOW = list(SPOILED)
_STATES = " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(SPOILED.values()))


def q_zip_guard(spark: SparkSession, d: str) -> DataFrame:
    """Containers, most of them with one fault, and what the guards of the archive say."""

    @F.pandas_udf("binary")
    def fault(content: pd.Series, how: pd.Series) -> pd.Series:
        return pd.Series([spoiled(bytes(c), h) for c, h in zip(content, how)])

    made = K.packed_containers(_paragraphs(spark, d), "file_id", "p", "epub")
    how = F.element_at(F.array(*map(F.lit, _HOW)), (F.pmod("key", F.lit(len(_HOW))) + 1).cast("int"))
    read = K.container_units(made.select("key", fault("content", how).alias("content")), "key", "content", "epub")
    return read.groupBy(C("key").alias("file_id")).agg(F.split_part(F.regexp_replace(F.max("error"), "damaged member .*", "damaged member"), F.lit(":"), F.lit(1)).alias("error"), F.count("unit_no").alias("n_units"))


def q_format_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Containers read as their suffixes say: DOCX, EPUB, and one that nothing reads."""
    rows = _paragraphs(spark, d)
    docx, epub = (K.packed_containers(rows.where(F.pmod("file_id", F.lit(3)) == i), "file_id", "p", form) for i, form in ((0, "docx"), (1, "epub")))
    other = rows.where(F.pmod("file_id", F.lit(3)) == 2).select(C("file_id").alias("key"), F.lit("x").cast("binary").alias("content"))
    named = docx.withColumn("name", F.lit("A.DOCX")).unionByName(epub.withColumn("name", F.lit("b.epub"))).unionByName(other.withColumn("name", F.lit("c.odt")))
    return K.units_by_format(named, "key", "name", "content").select(C("key").alias("file_id"), "unit_no", "text", "error")


def q_pages_xhtml_reject(spark: SparkSession, d: str) -> DataFrame:
    """Files as XHTML parts: well formed, well formed once named entities are spelled out, or rejected."""

    @F.pandas_udf("string")
    def state(content: pd.Series) -> pd.Series:
        return content.map(lambda t: K.xhtml_state(f"<html><body>{t or ''}</body></html>".encode("utf-8", "replace")))

    return files(spark, d, "content").select("file_id", state(T.normalized(C("content"))).alias("state"))


QUERIES.update({f.__name__: f for f in (q_zip_guard, q_format_dispatch, q_pages_xhtml_reject)})
SQL.update(
    {
        "q_zip_guard": f"WITH {S.FILES}, {_ROWS}, g AS (SELECT file_id, CASE file_id % {len(_HOW)} {_STATES} END AS error, len(p) AS n FROM p WHERE len(p) > 0) SELECT file_id, error, CASE WHEN error IS NULL THEN n ELSE 0 END AS n_units FROM g",
        "q_format_dispatch": f"""WITH {S.FILES}, {_ROWS} SELECT file_id, unit_no::INT AS unit_no, text, NULL::VARCHAR AS error FROM r WHERE file_id % 3 < 2
            UNION ALL SELECT file_id, NULL, NULL, 'no reader for .odt' FROM p WHERE len(p) > 0 AND file_id % 3 = 2""",
    }
)
