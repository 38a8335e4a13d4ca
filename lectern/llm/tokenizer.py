"""Problem 6: token ids of the whole corpus by a public tokenizer, and their decoding.

Method: overlapping chunk encoding. A long text is cut into chunks of CHUNK characters that overlap by OVERLAP; the
chunks are pre-tokenised in parallel. Pre-tokenisation reads from left to right, so two neighbours that share a boundary
inside their overlap agree from there on: the first such boundary stitches them. The stitched pieces are encoded on their
own (byte-pair merges never cross a pre-token) and their ids concatenated in order. Neighbours without a common boundary
(one pre-token longer than the overlap) are joined and encoded as one piece, so the result is always the ids of the whole
text. Texts of one chunk are encoded where they lie. The chunks of longer texts are spread over the cluster once, by
(row, chunk); from there on only boundaries and ids move, except for the rare pieces that span chunks.

Decoding concatenates the raw bytes of the ids and reads them as UTF-8 once per document.

Defined results: null and empty texts give the empty list; strings of special tokens are ordinary text; rows with one key
are texts of their own. The vocabulary's
path is a parameter (TOKENIZERS in the environment, else /opt/tokenizers) and must exist on every executor.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, spread, table, tasks

FOLDER = os.environ.get("TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k"
CHUNK = 4096
OVERLAP = 256
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def _pretokens() -> regex.Pattern:
    return regex.compile(PATTERN)


def _encode(texts: list[str | None], path: str) -> pa.Array:
    """A list array of ids made without Python integers."""
    coder = encoding(path)
    ids = [coder.encode_to_numpy(t) if t else None for t in texts]
    sizes = [0 if x is None else len(x) for x in ids]
    offsets = pa.array([0, *_sums(sizes)], pa.int32())
    flat = [x for x in ids if x is not None]
    import numpy as np

    values = np.concatenate(flat).astype(np.int32) if flat else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(values))


def _sums(sizes: list[int]) -> list[int]:
    out, n = [], 0
    for s in sizes:
        out.append(n := n + s)
    return out


def _slices(texts: list, most: int = 4_000_000):
    """Ranges of rows of at most about `most` characters, so that one batch of ids stays small."""
    start = n = 0
    for i, t in enumerate(texts):
        if n and n + len(t or "") > most:
            yield start, i
            start, n = i, 0
        n += len(t or "")
    if start < len(texts) or not texts:
        yield start, len(texts)


def _encoded(df: DataFrame, keys: str, path: str) -> DataFrame:
    """Encodes the last column, text; the keys pass through."""

    def run(batches):
        for batch in batches:
            last = batch.num_columns - 1
            texts = batch.column(last).to_pylist()
            for a, b in _slices(texts):
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(last)), _encode(texts[a:b], path)], names=[*batch.schema.names[:last], "ids"])

    return df.mapInArrow(run, f"{keys}, ids array<int>")


def _counted(df: DataFrame, keys: str, path: str) -> DataFrame:
    """As _encoded, but the number of ids only."""

    def run(batches):
        coder = encoding(path)
        for batch in batches:
            last = batch.num_columns - 1
            n = [len(coder.encode_to_numpy(t)) if t else 0 for part in slices(batch) for t in part.column(last).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(n, pa.int32())], names=[*batch.schema.names[:last], "tokens"])

    return df.mapInArrow(run, f"{keys}, tokens int")


def _boundaries(df: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Pre-tokenises chunks: boundaries (absolute) in the first and in the last `overlap` characters of each."""

    def run(batches):
        find = _pretokens().finditer
        for batch in batches:
            head, tail = [], []
            for n, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                base, whole = n * chunk, len(text) < chunk + overlap
                starts = [m.start() for m in find(text)]
                head.append([base + p for p in starts if p < overlap] if n else [])
                # A pre-token that touches the chunk's end may go on beyond it, and \s+(?!\S) looks one sign ahead.
                tail.append([base + p for p in starts[:-1] if p >= chunk] if not whole else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))], names=["row", "chunk", "head", "tail"])

    # All columns are taken, so that both readers of the chunks share one exchange.
    return df.select("row", "key", "chunk", "text").mapInArrow(run, "row long, chunk int, head array<long>, tail array<long>")


def _pieces(long: DataFrame, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(row, key, piece, text) of the pieces within one chunk, and of those joined from several."""
    # One pass cuts the text; every chunk takes its overlap from the next.
    cut = long.withColumn("c", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)))
    parts = F.expr(f"transform(c, (x, i) -> struct(i as chunk, concat(x, coalesce(left(get(c, i + 1), {overlap}), '')) as text))")
    chunks = cut.select("row", "key", F.explode(parts).alias("p")).select("row", "key", "p.chunk", "p.text").repartition(tasks(long), "row", "chunk")
    order = Window.partitionBy("row").orderBy("chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # `at` ends a piece inside a chunk's overlap; chunks without one stay joined with their followers.
    places = _boundaries(chunks, chunk, overlap).withColumn("at", F.array_min(F.array_intersect("tail", F.lead("head").over(order))))
    places = places.select("row", "chunk", "at", F.coalesce(F.count("at").over(before), F.lit(0)).cast("int").alias("piece"), F.coalesce(F.last("at", True).over(before), F.lit(0)).alias("start"), F.lead("chunk").over(order).isNull().alias("end"))
    base = F.col("chunk") * F.lit(chunk).cast("long")
    first = F.greatest(F.col("start") - base, F.lit(0))
    # What a chunk adds to its piece: from where the piece starts to where it ends, else to the next chunk.
    stop = F.when(F.col("at").isNotNull(), F.col("at") - base).otherwise(F.lit(chunk))
    own = chunks.join(places, ["row", "chunk"]).select("row", "key", "piece", "chunk", F.substr("text", (first + 1).cast("int"), (stop - first).cast("int")).alias("text"), (F.col("start") >= base).alias("opens"), (F.col("at").isNotNull() | F.col("end")).alias("closes"))
    # start >= base also where the piece opened in the chunk before, inside its overlap with this one.
    alone = F.col("opens") & F.col("closes")
    joined = own.where(~alone).groupBy("row", "key", "piece").agg(F.sort_array(F.collect_list(F.struct("chunk", "text"))).alias("l"))
    return own.where(alone).select("row", "key", "piece", "text"), joined.select("row", "key", "piece", F.array_join(F.transform("l", lambda x: x["text"]), "").alias("text"))


def encode(df: DataFrame, key: str, text: str, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, ids) for every row of df."""
    short, pieces, path = _parts(df, key, text, path, chunk, overlap)
    ids = [_encoded(p, "row long, key long, piece int", path) for p in pieces]
    joined = ids[0].unionByName(ids[1]).groupBy("row", "key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"])).alias("ids"))
    return _encoded(short, "key long", path).unionByName(joined.select("key", "ids")).withColumnRenamed("key", key)


def _parts(df: DataFrame, key: str, text: str, path: str | None, chunk: int, overlap: int) -> tuple[DataFrame, tuple[DataFrame, DataFrame], str]:
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    long = rows.where(F.length("text") > chunk).select(F.monotonically_increasing_id().alias("row"), "key", "text")
    return rows.where(F.col("text").isNull() | (F.length("text") <= chunk)), _pieces(long, chunk, overlap), path or f"{FOLDER}/{NAME}.tiktoken"


def decode(df: DataFrame, key: str, ids: str, path: str | None = None) -> DataFrame:
    """(key, text): the ids' raw bytes concatenated, then read as UTF-8. The empty list gives the empty text."""
    path = path or f"{FOLDER}/{NAME}.tiktoken"

    def run(batches):
        coder = encoding(path)
        for batch in batches:
            texts = [None if x is None else coder.decode_bytes(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    return df.select(F.col(key).cast("long").alias("key"), F.col(ids).alias("ids")).mapInArrow(run, "key long, text string").withColumnRenamed("key", key)


def sizes(df: DataFrame, key: str, text: str, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, tokens): the number of ids of each text."""
    short, pieces, path = _parts(df, key, text, path, chunk, overlap)
    counts = [_counted(p, "row long, key long, piece int", path) for p in pieces]
    joined = counts[0].unionByName(counts[1]).groupBy("row", "key").agg(F.sum("tokens").cast("int").alias("tokens"))
    return _counted(short, "key long", path).unionByName(joined.select("key", "tokens")).withColumnRenamed("key", key)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document."""
    return encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")
