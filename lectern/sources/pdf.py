"""PDF source. It needs pypdf, which is optional; without it every call says so instead of returning made-up text."""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized
from ..operators import jobs as J

try:
    import pypdf
except ImportError:
    pypdf = None

MOST_PAGES = 1000


def _needed() -> None:
    if pypdf is None:
        raise RuntimeError("reading PDF needs the library pypdf, which is not installed")


# Fixed value: signs that no text holds.
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def pdf_pages(df: DataFrame, key: str, content: str, selection: str = "all") -> DataFrame:
    """(key, page, text, error) of the selected pages. Only they are extracted; a file that cannot be read gives one row
    with its error."""
    _needed()

    def count(batches):
        for batch in batches:
            found = []
            for data in batch.column(1).to_pylist():
                try:
                    reader = pypdf.PdfReader(io.BytesIO(data or b""))
                    n = 0 if reader.is_encrypted else len(reader.pages)
                    found.append((n, "encrypted" if reader.is_encrypted else None if 1 <= n <= MOST_PAGES else "no pages or too many"))
                except Exception as e:
                    found.append((0, f"not a readable PDF: {e}"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([n for n, _ in found], pa.int32()), pa.array([e for _, e in found], pa.string())], names=["key", "content", "n", "error"])

    def read(batches):
        for batch in batches:
            for k, data, pages in zip(*(c.to_pylist() for c in batch.columns)):
                reader = pypdf.PdfReader(io.BytesIO(data))
                texts = [reader.pages[p - 1].extract_text(extraction_mode="layout") for p in pages]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(pages), pa.int64()), pa.array(pages, pa.int32()), pa.array(texts, pa.string())], names=["key", "page", "text"])

    seen = df.select(F.col(key).cast("long").alias("key"), F.col(content).alias("content")).mapInArrow(count, "key long, content binary, n int, error string")
    wanted = seen.where("error is null").withColumn("pages", J.page_selection(F.lit(selection), F.col("n")))
    text = F.regexp_replace(normalized(F.col("text")), _CONTROL, "")
    pages = wanted.where("size(pages) > 0").select("key", "content", "pages").mapInArrow(read, "key long, page int, text string").select("key", "page", text.alias("text"), F.lit(None).cast("string").alias("error"))
    bad = seen.where("error is not null").select("key", F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("text"), "error")
    return pages.unionByName(bad)
